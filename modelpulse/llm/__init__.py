"""Operators for text corpora: cleaning, near-duplicates, mixing, tokens, scores.

Functions of this package that run in tasks travel with them, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
