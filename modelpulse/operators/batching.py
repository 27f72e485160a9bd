"""Forming batches from rows or chunks: by count, by accumulated size, by time."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelpulse.functions.ordering import number_rows, overlapped
from modelpulse.functions.storage import settle, settle_rows
from modelpulse.spec import BATCH_ROWS, BATCH_TIMEOUT_SECONDS, CAPTURE_TICK_SECONDS, MIN_BATCH_ROWS

CHUNK_BLOCK = 20_000
FAN = 4_096
#: Entries of all maps that one task may hold at the worst, where no two walks meet.
HELD_ENTRIES = 8_000_000

# The functions below that run in tasks travel with them, so executors need no copy of the
# package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def batch_by_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: int = BATCH_ROWS,
    name: str = "batch",
) -> DataFrame:
    """Batches of `size` rows in arrival order."""
    numbered = number_rows(df, keys, order, "_pos")
    return numbered.select(
        *df.columns, F.floor(F.col("_pos") / F.lit(size)).cast("bigint").alias(name)
    )


def batch_tumbling(
    df: DataFrame, ts: str, seconds: int = CAPTURE_TICK_SECONDS, name: str = "batch"
) -> DataFrame:
    """Batch = start of the tick of `seconds` that holds the row; no minimum, no shuffle."""
    moment = F.col(ts).cast("timestamp")
    return df.withColumn(name, F.window(moment, f"{seconds} seconds")["start"])


def batch_rows_or_tick(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    size: int = BATCH_ROWS,
    seconds: int = CAPTURE_TICK_SECONDS,
) -> DataFrame:
    """Flush at `size` rows or at the next tick, whichever comes first.

    A tick empties the buffer, so every tick starts its count anew.
    """
    ticked = batch_tumbling(df, ts, seconds, "tick")
    return batch_by_rows(ticked, [*keys, "tick"], order, size, "part")


def keep_latest(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
    row_id: Sequence[str],
    salts: int = 64,
) -> DataFrame:
    """The newest n rows of each key.

    The newest n of every salt are kept first, which always contain the newest n of the key;
    a hot key is sorted in `salts` tasks and the last sort sees at most salts * n rows.
    """
    newest = [F.desc(c) for c in order]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*row_id), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*newest)
    final = Window.partitionBy(*keys).orderBy(*newest)
    kept = salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n)
    return (
        kept.withColumn("_rn", F.row_number().over(final))
        .where(F.col("_rn") <= n)
        .select(*df.columns)
    )


# --- accumulate until full, then start again --------------------------------------------
#
# Where a batch ends depends on where it began, so the series of one model looks sequential.
# But an open batch never spans `size` chunks (each chunk has a row), hence the whole past of
# a position is one number: how many chunks ago the open batch began. A block of chunks is
# then a map from that number at its start to the number at its end. Only beginnings whose
# batch reaches the block can occur, and walks from neighbouring beginnings soon meet, so the
# map is kept as stretches of entries with one result and hardly depends on `size`. The maps
# are built for all blocks at once by doubling the pointers to the next beginning, chained (a
# few numbers per block), and each block is labelled by itself once its entry is known.


def _flush_points(
    rows: np.ndarray, at: np.ndarray, size: int, min_rows: int, timeout_us: int | None, first: bool
) -> np.ndarray:
    """For a batch that begins at position i: position of the chunk that completes it.

    len(rows) stands for 'not inside this block'. `first` says that position 0 is the first
    chunk of the model, whose time is also the start of the clock.
    """
    count = len(rows)
    total = np.concatenate(([0], np.cumsum(rows)))
    full = np.searchsorted(total[1:], total[:-1] + size, side="left")
    if timeout_us is None:
        return full
    last_flush = np.concatenate(([at[0]], at[:-1]))
    if not first:
        # The flush before the oldest context chunk is unknown, and no batch of this block
        # begins there.
        last_flush[0] = np.iinfo(np.int64).max - timeout_us
    enough = np.searchsorted(total[1:], total[:-1] + min_rows, side="left")
    waited = np.searchsorted(at, last_flush + timeout_us, side="left")
    late = np.maximum(np.maximum(enough, waited), np.arange(count))
    return np.minimum(full, late)


def _sorted_block(pdf: pd.DataFrame) -> tuple[pd.DataFrame, int, bool]:
    """Chunks in order, the position of the first own chunk, whether the series starts here."""
    pdf = pdf.sort_values("chunk_no", kind="stable", ignore_index=True)
    start = int((pdf["_home"] < pdf["_block"]).sum())
    return pdf, start, bool(pdf["chunk_no"].iloc[0] == 0)


def _next_beginnings(flush: np.ndarray) -> np.ndarray:
    """Where the batch after one that begins at i begins; a batch left open points to itself.

    Position len(flush) is the end of the block.
    """
    end = len(flush)
    here = np.arange(end + 1)
    after = here.copy()
    after[:end] = np.where(flush < end, flush + 1, here[:end])
    return after


def _last_beginnings(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginning of the batch open at the end of the block, and batches completed until then,
    for a batch that begins at i. Pointers double, so rounds are the logarithm of the batches."""
    done = (after != np.arange(len(after))).astype(np.int64)
    while True:
        further = after[after]
        if np.array_equal(further, after):
            return after, done
        done = done + done[after]
        after = further


def _visited(after: np.ndarray, begin: int) -> np.ndarray:
    """Which positions are beginnings on the walk from `begin`; pointers double."""
    seen = np.zeros(len(after), bool)
    seen[begin] = True
    while True:
        seen[after[seen]] = True
        further = after[after]
        if np.array_equal(further, after):
            return seen
        after = further


def _stretches(first: np.ndarray, leave: np.ndarray, done: np.ndarray) -> dict[str, list]:
    """Neighbouring entries with the same result as one, named by its first entry."""
    new = np.ones(len(first), bool)
    new[1:] = (leave[1:] != leave[:-1]) | (done[1:] != done[:-1])
    return {"first": first[new].tolist(), "leave": leave[new].tolist(), "done": done[new].tolist()}


def _block_map(size: int, min_rows: int, timeout_us: int | None, keys: list[str]):
    def block_map(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, start, first = _sorted_block(pdf)
        rows, at = pdf["rows"].to_numpy(np.int64), pdf["at_us"].to_numpy(np.int64)
        flush = _flush_points(rows, at, size, min_rows, timeout_us, first)
        begun, done = _last_beginnings(_next_beginnings(flush))
        # The batch open at the start of the block began where its last chunk is not before it.
        oldest = int(np.argmax(flush[: start + 1] >= start))
        began = np.arange(start, oldest - 1, -1)
        out = pdf.loc[[0], keys].copy()
        out["unit"] = pdf["_block"].iloc[0]
        for name, cells in _stretches(start - began, len(rows) - begun[began], done[began]).items():
            out[name] = [cells]
        return out

    return block_map


def _label_block(size: int, min_rows: int, timeout_us: int | None, keys: list[str]):
    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, start, first = _sorted_block(pdf)
        rows, at = pdf["rows"].to_numpy(np.int64), pdf["at_us"].to_numpy(np.int64)
        flush = _flush_points(rows, at, size, min_rows, timeout_us, first)
        begins = _visited(_next_beginnings(flush), start - int(pdf["entry"].iloc[0]))
        batch = int(pdf["before"].iloc[0]) - 1 + np.cumsum(begins[:-1])
        out = pdf.loc[start:, [*keys, "chunk_no"]].copy()
        out["batch"] = batch[start:]
        out["complete"] = out["batch"] < pdf["closed"].iloc[start]
        return out

    return label


def _chain(keys: list[str]):
    """Maps of consecutive units joined into one: every stretch of the first is followed."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit", ignore_index=True)
        head = pdf.iloc[0]
        state, total = np.asarray(head["leave"]), np.asarray(head["done"])
        for first, leave, done in zip(pdf["first"][1:], pdf["leave"][1:], pdf["done"][1:]):
            at = np.searchsorted(first, state, side="right") - 1
            state, total = np.asarray(leave)[at], total + np.asarray(done)[at]
        out = pdf.loc[[0], [*keys, "parent"]].rename(columns={"parent": "unit"})
        for name, cells in _stretches(np.asarray(head["first"]), state, total).items():
            out[name] = [cells]
        return out

    return chain


def _follow(keys: list[str]):
    """Entry of every unit, from the entry of the first one."""

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit", ignore_index=True)
        state, before = int(pdf["entry0"].iloc[0]), int(pdf["before0"].iloc[0])
        entries, earlier = [], []
        for first, leave, done in zip(pdf["first"], pdf["leave"], pdf["done"]):
            entries.append(state)
            earlier.append(before)
            at = int(np.searchsorted(first, state, side="right")) - 1
            before += int(done[at])
            state = int(leave[at])
        out = pdf[[*keys, "unit"]].copy()
        out["entry"], out["before"], out["after"] = entries, earlier, before
        return out

    return follow


def _entries(units: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """(keys, unit, entry, before, closed) from the settled maps of the units.

    Up to `fan` units of a key are followed in one group. Where a key has more, runs of
    `fan` units are joined into parents first and the entries handed down again.
    """
    fields = [units.schema[k] for k in keys]
    entry_schema = T.StructType(
        [*fields, T.StructField("unit", T.LongType()), T.StructField("entry", T.LongType()),
         T.StructField("before", T.LongType()), T.StructField("after", T.LongType())]
    )
    last = units.agg(F.max("unit")).first()[0]
    if last is None or last < fan:
        start = units.withColumn("entry0", F.lit(0)).withColumn("before0", F.lit(0))
        found = start.groupBy(*keys).applyInPandas(_follow(keys), entry_schema)
        return found.withColumnRenamed("after", "closed")
    grouped = units.withColumn("parent", F.floor(F.col("unit") / F.lit(fan)).cast("bigint"))
    parents = grouped.groupBy(*keys, "parent").applyInPandas(_chain(keys), units.schema)
    above = _entries(settle(parents), keys, fan).select(
        *keys,
        F.col("unit").alias("parent"),
        F.col("entry").alias("entry0"),
        F.col("before").alias("before0"),
        "closed",
    )
    below = grouped.join(above, [*keys, "parent"])
    found = below.groupBy(*keys, "parent").applyInPandas(_follow(keys), entry_schema)
    return found.join(
        above.select(*keys, "parent", "closed"),
        [*[found[k] == above[k] for k in keys],
         F.floor(found["unit"] / F.lit(fan)) == above["parent"]],
    ).select(*[found[k] for k in keys], "unit", "entry", "before", "closed")


def accumulate_chunks(
    chunks: DataFrame,
    keys: Sequence[str],
    size: int = BATCH_ROWS,
    min_rows: int = MIN_BATCH_ROWS,
    timeout_seconds: float | None = BATCH_TIMEOUT_SECONDS,
    block: int = CHUNK_BLOCK,
    fan: int = FAN,
) -> DataFrame:
    """Batch of every chunk: whole chunks gather until they hold `size` rows, or at least
    `min_rows` once `timeout_seconds` have passed since the last flush.

    `chunks` is settled and has the keys, chunk_no (0, 1, 2, ... per key, in arrival order),
    rows (at least 1) and at_us (arrival in microseconds, not falling along chunk_no).
    Returns keys, chunk_no, batch and complete (false for the batch left open at the end).

    A block holds at most `block` chunks, or `size` if that is more, and the `size` before them; a task that
    chains maps holds at most `fan` of them and HELD_ENTRIES entries.
    """
    keys = list(keys)
    fan = max(2, min(fan, HELD_ENTRIES // size))
    block = max(block, size)
    timeout_us = None if timeout_seconds is None else int(timeout_seconds * 1_000_000)
    blocks = overlapped(chunks.select(*keys, "chunk_no", "rows", "at_us"), "chunk_no", size, block)
    # Context behind the last chunk of a series opens a block without chunks of its own.
    own = F.max("_home").over(Window.partitionBy(*keys, "_block"))
    blocks = blocks.withColumn("_own", own).where(F.col("_own") == F.col("_block")).drop("_own")
    fields = [chunks.schema[k] for k in keys]
    unit_schema = T.StructType(
        [*fields, T.StructField("unit", T.LongType()),
         T.StructField("first", T.ArrayType(T.LongType())),
         T.StructField("leave", T.ArrayType(T.LongType())),
         T.StructField("done", T.ArrayType(T.LongType()))]
    )
    make_map = _block_map(size, min_rows, timeout_us, keys)
    units = settle(blocks.groupBy(*keys, "_block").applyInPandas(make_map, unit_schema))
    entries = _entries(units, keys, fan).withColumnRenamed("unit", "_block")
    label_schema = T.StructType(
        [*fields, T.StructField("chunk_no", T.LongType()), T.StructField("batch", T.LongType()),
         T.StructField("complete", T.BooleanType())]
    )
    known = blocks.join(entries, [*keys, "_block"])
    labels = _label_block(size, min_rows, timeout_us, keys)
    return known.groupBy(*keys, "_block").applyInPandas(labels, label_schema)


def summarize_chunks(
    df: DataFrame, keys: Sequence[str], chunk: str, ts: str, dense: bool = False
) -> DataFrame:
    """(keys, _chunk, chunk_no, rows, at_us) of rows that carry an ascending chunk number.

    `dense` says that the numbers already run 0, 1, 2, ... per key. Settled.
    """
    counted = df.groupBy(*keys, F.col(chunk).cast("bigint").alias("_chunk")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("at_us"),
    )
    if dense:
        return settle_rows(counted.withColumn("chunk_no", F.col("_chunk")))
    return settle_rows(number_rows(counted, keys, ["_chunk"], "chunk_no"))


def assign_batches(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    ts: str,
    size: int = BATCH_ROWS,
    min_rows: int = MIN_BATCH_ROWS,
    timeout_seconds: float | None = BATCH_TIMEOUT_SECONDS,
    keep_partial: bool = True,
    name: str = "batch",
    dense: bool = False,
    **tuning: int,
) -> DataFrame:
    """Give every row the batch its chunk falls into.

    Only the chunk sizes go through the gathering; rows are joined back by (key, chunk).
    `keep_partial` keeps the batch that is still open at the end, whatever its size.
    """
    chunks = summarize_chunks(df, keys, chunk, ts, dense)
    labels = accumulate_chunks(chunks, keys, size, min_rows, timeout_seconds, **tuning)
    if not keep_partial:
        labels = labels.where("complete")
    if not dense:
        labels = labels.join(chunks.select(*keys, "chunk_no", "_chunk"), [*keys, "chunk_no"])
    found = labels.select(
        *keys,
        F.col("chunk_no" if dense else "_chunk").alias(chunk),
        F.col("batch").alias(name),
        "complete",
    )
    return df.withColumn(chunk, F.col(chunk).cast("bigint")).join(found, [*keys, chunk])
