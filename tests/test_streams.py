"""Streams against their batch twins."""

import dataclasses
import random

from pyspark.sql import functions as F

from modelpulse.operators import batching, grading, graph
from modelpulse.sources.tables import EVENTS_SPEC
from modelpulse.streaming import batches as st
from modelpulse.streaming.heartbeat import outages

SCHEMA = "model string, chunk int, at int, id int"


def files(spark, tmp_path, rows, parts):
    """The rows in `parts` files by chunk, named so that they are read in that order."""
    last = max(r[1] for r in rows) + 1
    for i in range(parts):
        own = [r for r in rows if i * last // parts <= r[1] < (i + 1) * last // parts]
        df = spark.createDataFrame(own, SCHEMA).withColumn("ts", F.timestamp_seconds("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def sample_rows():
    random.seed(9)
    rows, n = [], 0
    for model in "ab":
        now = 0
        for chunk in range(60):
            now += random.choice([1, 1, 5, 40])
            for _ in range(random.choice([1, 3, 8])):
                rows.append((model, chunk, now, n))
                n += 1
    return rows


def test_stream_batches_equal_batch(spark, tmp_path):
    rows = sample_rows()
    path = files(spark, tmp_path, rows, 4)
    how = st.Gathering(("model",), "chunk", "ts", str(tmp_path / "state"), 20, 8, 30)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    seen = []
    query = st.stream_batches(
        stream, how, str(tmp_path / "out"), str(tmp_path / "ck"), lambda df, e: seen.append((e, df.count()))
    )
    query.awaitTermination()
    got = {r.id: r.batch for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("at"))
    whole = batching.assign_batches(df, ["model"], "chunk", "ts", 20, 8, 30, keep_partial=False)
    assert got == {r.id: r.batch for r in whole.collect()}
    assert len(seen) == 4 and sum(n for _, n in seen) == len(got)


def test_repeated_epoch_gives_the_same(spark, tmp_path):
    rows = sample_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("at"))
    how = st.Gathering(("model",), "chunk", "ts", str(tmp_path / "state"), 20, 8, 30)
    st.gather_epoch(df.where("chunk < 30"), 0, how)
    once = st.gather_epoch(df.where("chunk >= 30"), 1, how).collect()
    again = st.gather_epoch(df.where("chunk >= 30"), 1, how).collect()
    assert sorted(once) == sorted(again) and once


def test_epoch_grading_equals_batch(spark, tmp_path):
    random.seed(4)
    rows = [(m, b, "psi", random.choice([0.0, 0.3, 0.4, 0.9])) for m in "ab" for b in range(20)]
    metrics = spark.createDataFrame(rows, "model_id string, batch int, metric string, value double")
    summary = spark.createDataFrame([(m, "psi", 0.1, 0.1) for m in "ab"], "model_id string, metric string, mean double, std double")
    spec = dataclasses.replace(EVENTS_SPEC, domain="standard")
    got = {}
    for epoch, (lo, hi) in enumerate([(0, 5), (5, 6), (6, 20)]):
        part = metrics.where(f"batch >= {lo} and batch < {hi}")
        out = st.grade_epoch(part, summary, spec, str(tmp_path / "grades"), epoch)
        got.update({(r.model_id, r.batch): r.status for r in out.collect()})
    whole = grading.grade(metrics, summary, "standard", ["model_id", "batch"])
    assert got == {(r.model_id, r.batch): r.status for r in whole.collect()}


def test_stream_outages_equal_batch(spark, tmp_path):
    rows = [("a", 0, 0, 0), ("a", 1, 50, 1), ("b", 1, 55, 2), ("a", 2, 300, 3), ("b", 3, 900, 4)]
    path = files(spark, tmp_path, rows, 2)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    beats = stream.withColumnRenamed("model", "node")
    out = str(tmp_path / "grey")
    (
        outages(beats, 100, watermark="0 seconds").writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    )
    got = {(r.node, r.last_seen) for r in spark.read.parquet(out).collect()}
    whole = graph.activity_periods(spark.read.parquet(path).withColumnRenamed("model", "node"), 100)
    closed = whole.where(F.col("grey_at") <= F.timestamp_seconds(F.lit(900)))
    assert got == {(r.node, r.last_seen) for r in closed.collect()} and len(got) == 3
