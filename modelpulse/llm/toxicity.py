"""Toxicity by compression distance: which of two dictionaries shortens a window of text more.

One zstandard dictionary is trained on ordinary text, one on toxic text. Most of a toxic document
is ordinary prose, so only the words far more usual in toxic documents than in others are what the
toxic dictionary is trained on; a stretch of ordinary text that both dictionaries begin with keeps
prose equally short in either. A document is cut into windows of a few words; each is compressed
with either dictionary, and the bytes that the toxic one saves are its distance. How many windows
lie beyond each of a few distances is what a document is judged by: a logistic curve over these
counts is fitted to the labelled documents and gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelpulse.llm.common import WORD, Shared, fresh, with_arrow_columns

#: Labelled documents of either kind that the model is fitted on, at most.
SAMPLE = 2_000
WINDOW = 3
#: Bytes of the common stretch and of each dictionary's own.
COMMON_BYTES, OWN_BYTES, LEVEL = 12_000, 2_000, 7
DISTANCES = (-2, 0, 1, 2, 3, 4, 5, 6, 8)
PREDICTED_FROM = 0.3
A_WORD = re.compile(WORD)
PUNCTUATION = ".,;:!?#"


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """Stretches of `size` words of the whole text, in small letters; the last may be shorter."""
    words = A_WORD.findall(text.lower())
    return [(" " + " ".join(words[i : i + size]) + " ").encode() for i in range(0, len(words), size)]


#: Both dictionaries begin with this and so does what is compressed; without it the format would
#: store so short a window as it is, whatever the dictionary.
LEAD = bytes(range(128, 192))


#: Letters of the shortest stem.
STEM = 4


def stems(text: str) -> Counter:
    """How often each beginning of a word, of STEM letters or the whole word at least, stands in the text."""
    out = Counter()
    for word, n in Counter(w.strip(PUNCTUATION) for w in A_WORD.findall(text.lower())).items():
        for size in range(min(STEM, len(word)), min(len(word), 24) + 1):
            out[word[:size]] += n
    return out


def telling_stems(toxic: list[str], ordinary: list[str], odds: float = 12.0) -> set[str]:
    """Beginnings of words at `odds` times their ordinary rate a document.

    A beginning counts three times a document at most, so that a long one doesn't decide. It must stand in
    a fiftieth of the toxic documents. Of those that begin alike the shortest stays.
    """
    least = max(5, len(toxic) // 50)
    often: list[Counter] = []
    held: Counter = Counter()
    for texts in (toxic, ordinary):
        total: Counter = Counter()
        for text in texts:
            own = stems(text)
            total.update({k: min(n, 3) for k, n in own.items()})
            if texts is toxic:
                held.update(own.keys())
        often.append(total)
    a, b = often
    rate = lambda n, of: (n + 0.5) / (of + 1)
    found = {w for w, n in held.items() if w and n >= least and rate(a[w], len(toxic)) >= odds * rate(b[w], len(ordinary))}
    return {w for w in found if not any(w[:k] in found for k in range(1, len(w)))}


class Model:
    """Two dictionaries and the calibrated curve. Its size is that of the dictionaries."""

    def __init__(self, toxic: list[str], ordinary: list[str], labels_share: float | None = None):
        telling = telling_stems(toxic, ordinary)
        plain = [w for t in ordinary for w in windows(t, 3)]
        begins = tuple(telling)
        marked = [w for t in toxic for w in windows(t, 1) if begins and w.decode().strip().startswith(begins)]
        common = self._trained(plain, COMMON_BYTES)
        spread = max(1, len(plain) // max(len(marked), 1_000))
        own = [self._trained(plain[::spread], OWN_BYTES), self._trained(marked, OWN_BYTES)]
        self.dictionaries = [LEAD + common + x for x in own]
        self.tools = None
        if not toxic or not ordinary:
            # One score for all: the share of toxic labels, 0 without labels.
            base = min(max(labels_share or 0.0, 1e-6), 1 - 1e-6)
            self.centre, self.spread = 0.0, 1.0
            self.slope = np.append(np.zeros(len(self.features(""))), math.log(base / (1 - base)))
            self.tools = None
            return
        features = np.array([self.features(t) for t in [*toxic, *ordinary]])
        wanted = np.repeat([1.0, 0.0], [len(toxic), len(ordinary)])
        self.centre, self.spread = features.mean(axis=0), features.std(axis=0) + 1e-9
        # Documents of either kind count as often as they are among the labelled ones.
        share = labels_share if labels_share is not None else len(toxic) / max(len(features), 1)
        weight = np.where(wanted == 1, share / max(len(toxic), 1), (1 - share) / max(len(ordinary), 1))
        self.slope = self._fitted((features - self.centre) / self.spread, wanted, weight / weight.sum())
        self.tools = None

    @staticmethod
    def _trained(samples: list[bytes], size: int) -> bytes:
        """What the trainer picks from the samples, without its tables, which suit longer texts.

        Of too few samples for the trainer, the distinct ones themselves.
        """
        step = max(1, len(samples) // 200_000)
        try:
            return zstandard.train_dictionary(size + 1_000, samples[::step], level=LEVEL).as_bytes()[-size:]
        except zstandard.ZstdError:
            return b"".join(sorted(set(samples)))[-size:] or b" " * 16

    @staticmethod
    def _fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
        x = np.hstack([x, np.ones((len(x), 1))])
        slope = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ slope, -30, 30)))
            grad = x.T @ (weight * (p - y)) + ridge * slope
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(slope))
            move = np.linalg.solve(hess, grad)
            slope -= move
            if np.abs(move).max() < 1e-8:
                break
        return slope

    def _compressors(self):
        if self.tools is None:
            self.tools = []
            for raw in self.dictionaries:
                held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=LEVEL)
                self.tools.append(
                    zstandard.ZstdCompressor(
                        level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
                    ).compress
                )
        return self.tools

    def features(self, text: str) -> list[float]:
        plain, toxic = self._compressors()
        apart = [len(plain(LEAD + w)) - len(toxic(LEAD + w)) for w in windows(text)]
        counts = np.bincount(np.clip(np.array(apart, np.int64), -8, 24) + 8, minlength=33)
        above = counts[::-1].cumsum()[::-1]
        n = max(len(apart), 1)
        return [*(math.log1p(above[d + 8]) for d in DISTANCES), above[3 + 8] / n, min(max(apart, default=-8), 24), math.log(n)]

    def score(self, text: str) -> float:
        x = (np.array(self.features(text)) - self.centre) / self.spread
        return round(float(1 / (1 + math.exp(-max(-30.0, min(30.0, x @ self.slope[:-1] + self.slope[-1]))))), 6)


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents of either kind, none of them held out.

    Null labels and null texts aren't learned from. Without documents of both kinds the model
    knows no difference and gives every text the share of toxic labels, 0 without labels.
    """
    usable = labels.where(F.col(label).isNotNull() & ~held_out(doc_id)).select(doc_id, F.col(label).cast("int").alias("y"))
    shares = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    texts, name = {}, fresh(docs.columns, "labelled_id")
    for kind in (1, 0):
        # The ids are few whatever the size of the labels, and so are their texts.
        chosen = usable.where(F.col("y") == kind).orderBy(F.xxhash64(doc_id, F.lit(29)), doc_id).limit(sample).select(F.col(doc_id).alias(name))
        found = docs.join(F.broadcast(chosen), F.col(doc_id) == F.col(name)).where(F.col(text).isNotNull())
        texts[kind] = [r[0] for r in found.orderBy(doc_id, text).select(text).collect()]
    total = shares.get(1, 0) + shares.get(0, 0)
    return Model(texts[1], texts[0], shares.get(1, 0) / total if total else None)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of every whole text; null texts count as empty ones. Rows stay."""
    shared = Shared(docs.sparkSession, model)

    def work(texts: list[str]) -> list[list]:
        return [[shared.value.score(t) for t in texts]]

    return with_arrow_columns(docs, text, {out: T.DoubleType()}, work)
