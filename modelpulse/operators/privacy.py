"""Privacy vital: share of rows whose quasi-identifiers are not unique in the batch."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelpulse.functions.scalars import missing


def privacy_score(
    df: DataFrame, quasi: Sequence[str], by: Sequence[str], name: str = "privacy_score"
) -> DataFrame:
    """1 - (quasi-identifier groups of size one) / rows, per batch.

    A row with a missing quasi-identifier is in no group but still counts as a row.
    """
    by = list(by)
    whole = reduce(lambda a, b: a & b, [~missing(df, c) for c in quasi])
    # The group number column keeps a quasi-identifier that is also a batch key apart.
    parts = [F.col(c).alias(f"_q{i}") for i, c in enumerate(quasi)]
    groups = (
        df.select(*by, *parts, whole.alias("_whole"))
        .groupBy(*by, *[f"_q{i}" for i in range(len(quasi))], "_whole")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    unique = F.count_if(F.col("_whole") & (F.col("_c") == 1))
    return groups.groupBy(*by).agg((1 - unique / F.sum("_c")).alias(name))
