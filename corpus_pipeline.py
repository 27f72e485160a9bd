"""A corpus from raw documents to tokens, one stage of the llm operators after the other.

Each stage gets the rows the one before kept, as Parquet, and its decisions take effect. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelpulse.functions.joins import lookup_join
from modelpulse.functions.storage import scratch_path, settle_rows
from modelpulse.llm import bpe_automaton, line_dedup, minhash, mixing, quality_rules
from modelpulse.llm.common import fresh, read, words_of


def _rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules; a null, empty or short text passes none of them.

    Rows are judged one by one, repeated ones alike. The verdict goes through a row of its own
    before it filters: a filter on it directly would be worked out below, from copies of all counts.
    """
    row = fresh(docs.columns, "judged")
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("doc")
    judged = quality_rules.apply_rules(docs.withColumn(row, whole)).select(F.struct(F.col(row).alias("doc"), "kept").alias("r"))
    kept = judged.select(F.explode_outer(F.array("r")).alias("r")).where("r.kept")
    return kept.select(*[F.col(f"r.doc.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier too; those left without a word go."""
    had, left = mixing.word_count("text"), fresh(docs.columns, "had_words")
    out = line_dedup.dedup_lines(docs.withColumn(left, had > 0))
    kept = out.where(~F.col(left) | (had > 0))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint"))
    return kept.select(docs.columns)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Rows are judged, not ids: rows of a null id, or of an id that repeats, go by a negative key of
    their own made from id and words. Rows of one id and the same words are copies, of which the
    one with the smallest hash of all its columns stays. Texts without words are copies of nothing
    but rows of their own id; an empty table stays empty.
    """
    key, times = fresh(docs.columns, "near_key"), fresh(docs.columns, "near_times")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias(times)).where(F.col(times) > 1)
    counted = lookup_join(docs, settle_rows(repeated), ["doc_id"], "left", spread_by=docs.columns)
    words = F.array_join(words_of("text"), " ")
    own = F.xxhash64("doc_id", F.sha2(words, 256)).bitwiseOR(F.lit(-(2**63)))
    unusual = F.col("doc_id").isNull() | F.col(times).isNotNull()
    keyed = counted.select(F.when(unusual, own).otherwise(F.col("doc_id")).alias(key), *[F.col(f"`{c}`") for c in docs.columns])
    kept = minhash.near_duplicates(keyed, doc_id=key).where("kept").select(key)
    left = keyed.join(kept, key, "left_semi")
    whole = F.struct(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    single = left.groupBy(key).agg(F.min(whole).alias("doc"))
    return single.select(*[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    taken, _, _ = mixing.mix(docs, F.array("source"), mixing.word_count("text"))
    copied = taken.where("copies > 0").withColumn("copies", F.array_repeat("copies", F.col("copies").cast("int")))
    return copied.withColumn("copies", F.explode("copies")).select(docs.columns)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to the labels they are."""
    machine = bpe_automaton.compiled(spark, public_tokenizers.path("word_bpe_49k.json"))
    encoded = bpe_automaton.round_trip(docs.select("doc_id", "source", "text"), "text", machine)
    return encoded.select("doc_id", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "decoded")


STAGES = [
    ("quality rules", _rules),
    ("line dedup", _lines),
    ("near-duplicates", _near),
    ("source mix", _mix),
    ("tokens", _tokens),
]
#: Merging by rank can't be said in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
