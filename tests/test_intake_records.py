"""Envelopes record by record, repeated appends, sketches and splits."""

import random

import pytest
from pyspark.sql import functions as F

from modelpulse.operators import reporting
from modelpulse.sources import intake, store
from modelpulse.spec import BatchSpec

GOOD = '{"modelId":"m","timestamp":"2024-01-01T00:00:00Z","latency":1.5,"input":{"f":2,"g":"x"},"output":{"p":0.25}}'
SENT = [
    f'{{"batchId":"a","payload":[{GOOD},7,{{"timestamp":"2024-01-01T00:00:00Z"}},{GOOD.replace("1.5", chr(34) + "slow" + chr(34))},'
    f'{GOOD.replace("2024-01-01T00:00:00Z", "later")},{GOOD.replace("1.5", "null")}]}}',
    f'{{"batchId":"a","payload":[{GOOD}]}}',
    '{"batchId":"b","payload":[]}', '{"batchId":"c"}', '{"payload":[1]}', "[1, 2]", "no json", None, '{"batchId":"d","payload":{"x":1}}',
]


def test_every_envelope_and_record_is_used_or_set_aside(spark):
    raw = spark.createDataFrame([(s,) for s in SENT], "value string")
    used = {(r.batch_id, r.pos): r for r in intake.records(raw).collect()}
    assert set(used) == {("a", 0), ("a", 5)} and used["a", 0].latency == 1.5 and used["a", 5].latency is None
    aside = sorted(((r.batch_id or "", r.pos if r.pos is not None else -1, r.reason) for r in intake.quarantined(raw).collect()))
    assert aside == [
        ("", -1, "batchId missing"), ("", -1, "no JSON object"), ("", -1, "no JSON object"), ("", -1, "no JSON object"),
        ("a", 1, "record is no object"), ("a", 2, "modelId missing"), ("a", 3, "latency is no number"),
        ("a", 4, "timestamp missing or invalid"), ("b", -1, "payload empty"), ("c", -1, "payload missing"), ("d", -1, "payload missing"),
    ]


def test_records_become_scored_rows(spark):
    raw = spark.createDataFrame([(SENT[1],)], "value string")
    spec = BatchSpec(numerical=("f",), prediction="p", quasi=("g",), keys=("model_id", "batch"))
    row = intake.scored(intake.records(raw), spec, {"f": "double", "g": "string", "p": "double", "other": "int"}).first()
    assert (row.model_id, row.f, row.g, row.p, row.other) == ("m", 2.0, "x", 0.25, None)


def test_a_stream_takes_repeats_once(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (SENT[:1], SENT[1:], SENT[:2]):
        spark.createDataFrame([(s,) for s in part], "value string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(path)
    query = intake.stream_records(stream).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.batch_id, r.pos) for r in spark.read.parquet(out).collect()) == [("a", 0), ("a", 5)]


def test_a_repeated_run_and_a_stopped_one(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i, f"2024-01-0{i % 3 + 1}") for i in range(9)], "id int, d string").withColumn("time", F.to_timestamp("d"))
    ids = lambda: sorted(r.id for r in store.read_committed(spark, path).collect())
    store.append_once(df.where("id < 5"), path, "one")
    store.append_once(df.where("id < 4"), path, "one")
    store.append_once(df.where("id >= 4"), path, "two")
    df.write.parquet(f"{path}/data/run=stopped")
    assert ids() == list(range(9)) and store.committed_runs(spark, path) == ["one", "two"]
    store.compact(spark, path, "all")
    assert ids() == list(range(9)) and store.committed_runs(spark, path) == ["all"]
    assert store.remove_replaced(spark, path) == ["one", "two"]
    store.append_once(df.where("id = 0"), path, "three")
    assert ids() == [0, *range(9)] and not (tmp_path / "t/data/run=one").exists()
    with pytest.raises(ValueError):
        store.append_once(df, path, "../x")
    with pytest.raises(ValueError):
        store.compact(spark, path, "all")


def test_merged_sketches_are_near_the_exact_ranks(spark):
    rng = random.Random(2)
    values = [(f"b{i % 30}", rng.expovariate(0.01)) for i in range(20_000)]
    df = spark.createDataFrame([("m", b, v) for b, v in values], "m string, b string, ms double")
    found = reporting.quantiles_of_sketches(reporting.latency_sketches(df, "ms", ["m", "b"]), ["m"], (0.1, 0.5, 0.95)).collect()
    assert len(found) == 3
    for r in found:
        assert r.records == 20_000
        assert abs(sum(v <= r.value for _, v in values) / len(values) - r.quantile) < 0.02


def test_split_follows_the_seed(spark):
    df = spark.range(5_000).withColumnRenamed("id", "row")
    part = lambda seed: {r.row for r in reporting.train_test_split(df, "row", 0.2, seed).where("split = 'test'").collect()}
    assert part(1) == part(1) and part(1) != part(2) and 850 < len(part(1)) < 1_150
