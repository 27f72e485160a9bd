"""Streams with timers over several micro-batches, idle gaps and a restart, against their batch twins."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from modelpulse.operators import batching, graph
from modelpulse.streaming import timers

START = datetime(2024, 1, 1)


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drain(stream, out, checkpoint):
    with timers.options(stream.sparkSession):
        query = (
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    query.awaitTermination()


ROW = "model string, salt int, id int, ts timestamp"


def rows_of(files, seed=3):
    rng, rows, n = random.Random(seed), [], 0
    for part in range(files):
        now = START + timedelta(minutes=part)
        for _ in range(120):
            # Four minutes apart from each other, with an idle gap inside the second.
            now += timedelta(milliseconds=rng.choice([1, 20, 300]) + (9_000 if part == 1 and n % 60 == 0 else 0))
            rows.append((part, ("a" if rng.random() < 0.8 else "b", n % 2, n, now)))
            n += 1
    return rows


def test_rows_or_tick_with_idle_gaps_and_a_restart(spark, tmp_path):
    tagged = rows_of(4)
    path, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = spark.createDataFrame([], ROW).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        drain(timers.stream_rows_or_tick(stream, ["model", "salt"], "ts", ["ts", "id"], "0 seconds", 10, 5), out, ck)

    for part in range(3):
        write(spark, path, [r for p, r in tagged if p == part], ROW)
    run()
    before = spark.read.parquet(out).count()
    run()  # a restart with nothing new
    assert spark.read.parquet(out).count() == before
    write(spark, path, [r for p, r in tagged if p == 3], ROW)
    run()
    got = {r.id: (r.tick, r.part) for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == len(got)
    whole = batching.batch_rows_or_tick(
        spark.createDataFrame([r for _, r in tagged], ROW), ["model", "salt"], "ts", ["ts", "id"], 10, 5
    ).withColumn("_n", F.count("*").over(__import__("pyspark").sql.Window.partitionBy("model", "salt", "tick", "part")))
    last = max(r[3] for _, r in tagged)
    closed = {r.id: (r.tick, r.part) for r in whole.collect() if r._n == 10 or r.tick + timedelta(seconds=5) <= last}
    assert got == closed and len(got) > 300
    # What the first three files left open was sent off by its timer, before the fourth came.
    assert before >= sum(p < 2 for p, _ in tagged)


def test_alerts_equal_periods_and_timeouts(spark, tmp_path):
    rng, rows = random.Random(5), []
    for node in "abcdef":
        now = START
        for _ in range(40):
            now += timedelta(seconds=rng.choice([1, 30, 99, 100, 101, 400]), microseconds=rng.randrange(3))
            rows.append((node, now))
    rows += [("once", START), ("hot", START)] + [("hot", START + timedelta(milliseconds=k)) for k in range(500)]
    asof = max(r[1] for r in rows) + timedelta(seconds=150)
    rows.sort(key=lambda r: r[1])
    path, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "node string, ts timestamp"
    for i in range(4):
        write(spark, path, rows[i * len(rows) // 4 : (i + 1) * len(rows) // 4], schema)
    write(spark, path, [("marker", asof)], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    drain(timers.silence_alerts(stream, 100, "0 seconds"), out, ck)
    alerts = spark.read.parquet(out).collect()
    events = spark.createDataFrame(rows, schema)
    periods = graph.activity_periods(events, 100).where(F.col("grey_at") <= F.lit(asof)).collect()
    grey = {(r.node, r.first_seen, r.last_seen, r.events, r.at) for r in alerts if r.event == "grey"}
    assert grey == {(r.node, r.first_seen, r.last_seen, r.events, r.grey_at) for r in periods}
    assert len(grey) == sum(r.event == "grey" for r in alerts)
    back = {(r.node, r.at) for r in alerts if r.event == "seen"}
    assert back == {(r.node, r.seen_again) for r in graph.heartbeat_gaps(events, 100).collect()}
    # Nodes whose last alert stands are those that are silent at the end.
    latest = {}
    for r in sorted(alerts, key=lambda r: r.at):
        latest[r.node] = r.event
    nodes = events.select("node").distinct()
    late = graph.heartbeat_timeouts(nodes, events, F.lit(asof).cast("timestamp"), 100).collect()
    assert {n for n, e in latest.items() if e == "grey"} == {r.node for r in late} and "once" in latest


def test_options_are_put_back(spark):
    key = next(iter(timers.ROCKSDB))
    before = spark.conf.get(key, None)
    with timers.options(spark):
        assert spark.conf.get(key).endswith("RocksDBStateStoreProvider")
    assert spark.conf.get(key, None) == before


class Handle:
    """State of one key in memory, with a count of the calls to it."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        handle = self

        class Value:
            def exists(self):
                handle.calls += 1
                return name in handle.values

            def get(self):
                handle.calls += 1
                return handle.values[name]

            def update(self, value):
                handle.calls += 1
                handle.values[name] = value

            def clear(self):
                handle.values.pop(name, None)

        return Value()

    getListState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)


def test_full_batches_of_a_tick_are_sent_in_one_frame():
    import pandas as pd
    from pyspark.sql import types as T

    held = T.StructType().add("id", "long").add("at_us", "long")
    batch, handle = timers.OpenBatch(["model"], held, "at_us", ["at_us", "id"], 5, 1_000_000), Handle()
    batch.init(handle)
    batch.rows.put = batch.rows.update
    rows = pd.DataFrame({"id": range(1_003), "at_us": range(1_003)})
    frames = list(batch.handleInputRows(("a",), iter([rows]), None))
    assert len(frames) == 1 and frames[0]["part"].tolist() == [i // 5 for i in range(1_000)]
    assert [r[0] for r in handle.values["rows"]] == [1_000, 1_001, 1_002]


def test_many_nodes_are_watched_with_few_calls():
    import pandas as pd

    watch, handle = timers.Silence(100_000), Handle()
    watch.init(handle)
    names = [f"n{i:03d}" for i in range(200)]

    def slots(at):
        return pd.DataFrame({"node": names, "first": at, "last": at + 5, "events": 2})

    assert not list(watch.handleInputRows((0,), iter([slots(1_000)]), None)) and handle.timers == {102}
    told = pd.concat(watch.handleInputRows((0,), iter([slots(50_000), slots(500_000)]), None))
    assert told.groupby("event").size().to_dict() == {"grey": 200, "seen": 200}
    grey = told[told["event"] == "grey"]
    assert set(zip(grey["at"], grey["first_seen"], grey["last_seen"], grey["events"])) == {(150_006, 1_000, 50_005, 4)}
    assert handle.timers == {601} and handle.calls < 20
