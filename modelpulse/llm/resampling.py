"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and pairs of words fall into buckets. Counts of the buckets over the target documents and
over all documents give two models; the weight of a document is the logarithm of how much likelier
its n-grams are under the first, taken over a stretch of a fixed number of n-grams so that length
alone decides nothing. Adding Gumbel noise, fixed by the id, and taking the largest k draws k
documents without return in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelpulse.functions.storage import settle_rows
from modelpulse.llm.common import Shared, text_chunks, with_arrow_columns
from modelpulse.llm.shingles import mixed, word_hashes

BUCKETS = 1 << 15
#: N-grams that a weight stands for.
STRETCH = 64
#: Target documents that the target model is counted over, at most.
TARGETS = 20_000


def buckets(texts: list[str], size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and pair of neighbours of the texts, and the text each is from."""
    words, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    together = owner[1:] == owner[:-1]
    pairs = mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])[together]
    hashed = np.concatenate([words, pairs]) % np.uint64(size)
    return hashed.astype(np.int64), np.concatenate([owner, owner[1:][together]])


def bucket_counts(docs: DataFrame, text: str, target: str, size: int = BUCKETS) -> np.ndarray:
    """Counts of the buckets: over all documents, and over those marked as target."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            marks = np.array([bool(x) for x in batch.column(1).to_pylist()])
            for start, held in text_chunks(batch.column(0)):
                at, owner = buckets(held, size)
                total[0] += np.bincount(at, minlength=size)
                total[1] += np.bincount(at[marks[start : start + len(held)][owner]], minlength=size)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(total[0][seen]), pa.array(total[1][seen])], names=["bucket", "raw", "wanted"]
        )

    made = docs.select(text, target).mapInArrow(run, "bucket bigint, raw bigint, wanted bigint")
    out = np.zeros((2, size))
    # As many rows as buckets, whatever the input.
    for r in made.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("wanted").alias("wanted")).collect():
        out[0, r["bucket"]], out[1, r["bucket"]] = r["raw"], r["wanted"]
    return out


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Logarithm of target over raw probability of each bucket, smoothed by one count in each."""
    raw, wanted = counts + 1.0
    return np.log(wanted / wanted.sum()) - np.log(raw / raw.sum())


def largest(df: DataFrame, key: str, tie: str, k: int, few: int = 10_000) -> DataFrame:
    """Add `kept`: whether the row is among the k of largest key, ties to the smaller `tie`.

    The bound is narrowed by counts in 1,024 spans of the range of keys that still holds it; what
    is ranked in the end is one narrow span, or rows of the very same key.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    above = 0
    while low is not None and low < high:
        width = (high - low) / 1024
        if low + width <= low or high - width >= high:
            break
        span = F.least(F.floor((F.col(key) - low) / width), F.lit(1023)).cast("int")
        inside = df.where((F.col(key) >= low) & (F.col(key) <= high))
        tally = sorted(
            (r for r in inside.groupBy(span.alias("s")).agg(
                F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()),
            key=lambda r: -r["s"],
        )
        for r in tally:
            if above + r["n"] > k:
                break
            above += r["n"]
        else:
            return df.withColumn("kept", F.lit(True))
        low, high, count = r["lo"], r["hi"], r["n"]
        if count <= few:
            break
    if low is None:
        return df.withColumn("kept", F.lit(False))
    edge = df.where(F.col(key).between(low, high)).select(key, tie)
    last = edge.orderBy(F.desc(key), tie).limit(k - above).agg(
        F.min(key).alias("lo"), F.max_by(tie, F.struct(-F.col(key), tie)).alias("at")
    ).first() if k > above else None
    if last is None or last["lo"] is None:
        return df.withColumn("kept", F.col(key) > high)
    return df.withColumn("kept", (F.col(key) > last["lo"]) | ((F.col(key) == last["lo"]) & (F.col(tie) <= last["at"])))


def resample(
    docs: DataFrame, targets: DataFrame, share: float, doc_id: str = "doc_id", text: str = "text", seed: int = 41
) -> DataFrame:
    """(id, log_weight, key, kept): `share` of the documents drawn by their weight.

    `targets` are ids of target documents; of more than TARGETS the first by hash. Null and empty
    texts have weight 0 as a logarithm; null ids are never kept. Repeated rows are drawn alike.
    """
    chosen = targets.select(F.col(doc_id).alias("_id")).distinct().orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(TARGETS)
    named = docs.select(doc_id, text)
    marked = named.join(F.broadcast(chosen), F.col(doc_id) == F.col("_id"), "left")
    ratio = Shared(docs.sparkSession, log_ratio(bucket_counts(marked.withColumn("_t", F.col("_id").isNotNull()), text, "_t")))

    def work(texts: list[str]) -> list[list]:
        at, owner = buckets(texts)
        total = np.bincount(owner, ratio.value[at], len(texts))
        count = np.bincount(owner, minlength=len(texts))
        return [np.round(total / np.maximum(count, 1) * STRETCH, 9).tolist()]

    weighed = with_arrow_columns(named, text, {"log_weight": T.DoubleType()}, work).drop(text)
    even = (F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    keyed = settle_rows(weighed.withColumn("key", F.round(F.col("log_weight") - F.log(-F.log(even)), 9)))
    given = keyed.where(F.col(doc_id).isNotNull())
    return largest(given, "key", doc_id, round(share * given.count())).unionByName(
        keyed.where(F.col(doc_id).isNull()).withColumn("kept", F.lit(False))
    )
