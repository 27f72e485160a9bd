"""What operators leave in the shared folder and shuffle, and that the mix stays right without it."""

import os
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from modelpulse.functions.storage import CLEANUP, Passing, scratch_path, settle_rows
from modelpulse.llm import line_dedup, minhash, mixing
from modelpulse.llm.components import components

PASSAGE = "\n".join(f"line {i} of a passage that is long enough to count as one" for i in range(8))


@pytest.fixture
def scratch(spark):
    """The columns of the tables that have come into the shared folder since the start of a test."""
    root = os.path.dirname(scratch_path(spark, "x"))
    listed = lambda: set(os.listdir(root)) if os.path.isdir(root) else set()
    before = listed()
    return lambda: [set(spark.read.parquet(f"{root}/{n}").columns) for n in listed() - before]


def documents(spark):
    rows = [(i, f"own words {i}\n{PASSAGE}\n{'more ' * (i % 5)}{i}", "abc"[i % 3]) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_passing_keeps_the_newest(spark, scratch):
    on_way = Passing(spark)
    for name in ("a", "b"):
        last = on_way.settle_rows(spark.range(3).withColumnRenamed("id", name))
    on_way.remove(keep=1)
    assert scratch() == [{"b"}] and last.count() == 3
    on_way.remove()
    assert scratch() == []


def test_line_dedup_leaves_no_windows(spark, scratch):
    assert line_dedup.dedup_lines(documents(spark)).where("n_removed > 0").count() == 39
    assert not any("covers" in c for c in scratch())


def test_near_duplicates_leave_no_texts(spark, scratch):
    out = minhash.near_duplicates(documents(spark))
    left = scratch()
    assert left and not any(c & {"t", "bands", "value", "bucket"} for c in left)
    assert out.count() == 40 and out.where("kept").count() == 1


def test_components_leave_one_round(spark, scratch):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)], "a int, b int")
    assert {r["component"] for r in components(links, "a", "b").collect()} == {0}
    assert len(scratch()) == 1


def test_settling_leaves_no_shuffle_files(spark):
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = store.getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {n for n in names if n.startswith("shuffle_")}

    before, was = shuffled(), spark.conf.get(CLEANUP)
    settled = settle_rows(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # they go in the background
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and spark.conf.get(CLEANUP) == was
    assert settled.count() == 7


def test_mix_shuffles_no_texts_and_takes_the_same_rows(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (1 + i * 7 % 23), "aab"[i % 3] if i % 10 else None) for i in range(300)] + [(7, None, "a"), (8, "w " * 11, "b")] * 3,
        "doc_id bigint, text string, source string",
    )
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        taken, sizes, targets = mixing.mix(docs, F.array("source"), mixing.word_count("text"))
        plan = taken._jdf.queryExecution().executedPlan().toString()
        found = [(r["doc_id"], r["size"], r["source"], r["copies"]) for r in taken.collect()]
        stage = corpus_pipeline._mix(spark, docs, "").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert stage == sum(c for *_, c in found)
    sent = mixing.flow({(s,): n for s, n in sizes.items()}, targets)
    rows = docs.select("doc_id", "source", mixing.word_count("text").alias("n"))
    rows = rows.withColumn("at", F.xxhash64(F.lit(17), "doc_id", "n")).collect()
    wanted = []
    for s, n in sizes.items():
        kept, rest = divmod(sent[(s,), s], n)
        before = 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: (r["at"], r["doc_id"], r["n"])):
            more = r["n"] > 0 and before < rest and 2 * (rest - before) >= r["n"]
            wanted.append((r["doc_id"], r["n"], s, kept + more))
            before += r["n"]
    by = lambda x: (x[0], x[1], x[2] or "", x[3])
    assert sorted(found, key=by) == sorted(wanted, key=by)
