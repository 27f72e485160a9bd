"""Positions, lookups and batch formation against sequential versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modelpulse.functions.joins import lookup_join
from modelpulse.functions.ordering import number_rows, overlapped, own_rows, running_totals
from modelpulse.operators import batching


def test_number_rows_with_hot_key(spark):
    random.seed(1)
    rows = [("hot" if i % 3 else f"k{i % 5}", random.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, id int").repartition(7)
    out = number_rows(df, ["k"], ["t", "id"]).collect()
    wanted, count = {}, {}
    for key, t, i in sorted(rows):
        wanted[i] = count.get(key, 0)
        count[key] = wanted[i] + 1
    assert {r.id: r.row_no for r in out} == wanted


def test_running_totals_with_null_key(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("a", 1, 3)], "k string, t int, v int")
    out = running_totals(df, ["k"], ["t"], {"before": F.col("v").cast("bigint")}).collect()
    assert {(r.k, r.t): r.before for r in out} == {(None, 1): 0, (None, 2): 5, ("a", 1): 0}


def test_overlapped_blocks_hold_rows_before(spark):
    df = spark.range(20).withColumnRenamed("id", "seq")
    blocks = overlapped(df, "seq", back=2, block=5)
    held = {}
    for r in blocks.collect():
        held.setdefault(r["_block"], set()).add(r.seq)
    assert held[1] == {3, 4, 5, 6, 7, 8, 9}
    assert own_rows(blocks).count() == 20


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_is_the_same_beyond_the_limit(spark, how):
    left = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 1), ("c", 1)], "k string, id int")
    right = spark.createDataFrame([("a", 10), ("b", 20), ("d", 30)], "k string, v int")
    small = lookup_join(left, right, ["k"], how).collect()
    large = lookup_join(left, right, ["k"], how, spread_by=["id"], limit=1, salts=4).collect()
    assert sorted(map(tuple, small), key=str) == sorted(map(tuple, large), key=str)


def gather(chunks, size, min_rows, timeout):
    """(batch, complete) of every chunk, one chunk after the other."""
    out, batch, held, last = [], 0, [], chunks[0][1]
    for rows, at in chunks:
        held.append(rows)
        out.append(batch)
        late = timeout is not None and at - last >= timeout and sum(held) >= min_rows
        if sum(held) >= size or late:
            batch, held, last = batch + 1, [], at
    return [(b, b < batch) for b in out]


@pytest.mark.parametrize("timeout", [None, 5, 30])
@pytest.mark.parametrize("block, fan", [(20_000, 4096), (20, 4096), (20, 2)])
def test_gathering_equals_fold(spark, timeout, block, fan):
    random.seed(f"{timeout}{block}{fan}")
    data, wanted = [], {}
    for model in range(3):
        now, chunks = 0, []
        for _ in range([1, 150, 400][model]):
            now += random.choice([0, 1, 1, 2, 9, 40])
            chunks.append((random.choice([1, 1, 2, 3, 7, 25]), now))
        for no, (found, (rows, at)) in enumerate(zip(gather(chunks, 20, 8, timeout), chunks)):
            wanted[(model, no)] = found
            data += [(model, no, at)] * rows
    df = spark.createDataFrame(data, "model int, chunk int, at long").withColumn("ts", F.timestamp_seconds("at"))
    out = batching.assign_batches(
        df, ["model"], "chunk", "ts", 20, 8, timeout, dense=True, block=block, fan=fan
    )
    assert out.count() == len(data)
    got = {(r.model, r.chunk): (r.batch, r.complete) for r in out.distinct().collect()}
    assert got == wanted


@pytest.mark.parametrize("timeout", [None, 40])
def test_gathering_into_very_large_batches(spark, timeout):
    random.seed(f"large{timeout}")
    now, chunks = 0, []
    for _ in range(260_000):
        now += random.choice([0, 0, 0, 1, 45])
        chunks.append((random.choice([1, 2, 3]), now))
    held, batch, last, wanted = 0, 0, chunks[0][1], []
    for rows, at in chunks:
        held += rows
        wanted.append(batch)
        if held >= 100_000 or (timeout is not None and at - last >= timeout and held >= 8):
            batch, held, last = batch + 1, 0, at
    table = pd.DataFrame(
        [(1, no, rows, at * 1_000_000) for no, (rows, at) in enumerate(chunks)],
        columns=["model", "chunk_no", "rows", "at_us"],
    )
    out = batching.accumulate_chunks(spark.createDataFrame(table), ["model"], 100_000, 8, timeout)
    got = out.orderBy("chunk_no").toPandas()
    assert got["batch"].tolist() == wanted
    assert got["complete"].tolist() == [b < batch for b in wanted]


def test_maps_of_blocks_keep_stretches_only():
    rows = np.tile([1, 2, 3], 40_000)
    block = pd.DataFrame({
        "model": 1, "chunk_no": np.arange(1, len(rows) + 1), "rows": rows,
        "at_us": np.arange(len(rows)) * 1_000_000, "_home": 1, "_block": 1,
    })
    block.loc[:99_999, "_home"] = 0
    found = batching._block_map(100_000, 8, 30_000_000, ["model"])(block)
    assert len(found["first"][0]) == len(found["leave"][0]) == len(found["done"][0]) < 100
    walks = batching._last_beginnings(np.array([3, 2, 4, 3, 4]))
    assert walks[0].tolist() == [3, 4, 4, 3, 4] and walks[1].tolist() == [1, 2, 1, 0, 0]


@pytest.mark.parametrize(
    "sizes, wanted", [([10] * 12, [50, 50, 20]), ([30, 30, 10], [60, 10])]
)
def test_gathering_examples(spark, sizes, wanted):
    data = [(1, no) for no, rows in enumerate(sizes) for _ in range(rows)]
    df = spark.createDataFrame(data, "model int, chunk int").withColumn("ts", F.timestamp_seconds("chunk"))
    out = batching.assign_batches(df, ["model"], "chunk", "ts", timeout_seconds=None)
    counts = out.groupBy("batch", "complete").count().orderBy("batch").collect()
    assert [r["count"] for r in counts] == wanted
    assert [r.complete for r in counts] == [True] * (len(wanted) - 1) + [False]


def test_tick_starts_count_anew(spark):
    rows = [(i, i // 7) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, sec int").withColumn("ts", F.timestamp_seconds(F.col("sec") * 5))
    df = df.withColumn("m", F.lit("m"))
    out = batching.batch_rows_or_tick(df, ["m"], "ts", ["ts", "id"], size=3)
    assert out.groupBy("tick", "part").count().agg(F.max("count")).first()[0] == 3
    assert out.where("part = 2").groupBy("tick").count().where("count <> 1").count() == 0


def test_keep_latest(spark):
    rows = [("hot", i) for i in range(500)] + [("cold", 1)]
    df = spark.createDataFrame(rows, "k string, t int")
    out = batching.keep_latest(df, ["k"], ["t"], 10, ["t"]).collect()
    assert {r.t for r in out if r.k == "hot"} == set(range(490, 500))
    assert [r.t for r in out if r.k == "cold"] == [1]
