"""Scored rows as a stream: gather batches across micro-batches, grade, append.

A micro-batch runs the same distributed operators as a batch job, so a hot model does not
become one state entry that one task works through. What a model carries from one epoch to
the next is small: the rows of its open batch and a few counters. Both are tables in the
shared folder, one folder per epoch, and epoch n reads what epoch n-1 wrote; a repeated
epoch writes the same folders again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from modelpulse.functions.ordering import running_totals
from modelpulse.functions.storage import settle_rows
from modelpulse.operators.batching import accumulate_chunks
from modelpulse.operators.grading import grade_raw, persist_filter, regrade_late
from modelpulse.sources.store import append_epoch
from modelpulse.spec import BATCH_ROWS, BATCH_TIMEOUT_SECONDS, DOMAINS, MIN_BATCH_ROWS, BatchSpec


@dataclass(frozen=True)
class Gathering:
    """How chunks gather into batches, and where the state of the gathering is kept."""

    keys: tuple[str, ...]
    chunk: str
    ts: str
    root: str
    size: int = BATCH_ROWS
    min_rows: int = MIN_BATCH_ROWS
    timeout_seconds: float | None = BATCH_TIMEOUT_SECONDS


def _read_epoch(spark: SparkSession, path: str, epoch_id: int, schema) -> DataFrame:
    """The table an earlier epoch left, or an empty one before the first."""
    if epoch_id < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/epoch={epoch_id}")


def gather_epoch(rows: DataFrame, epoch_id: int, how: Gathering) -> DataFrame:
    """Complete batches of one micro-batch, the open remainder stored for the next one.

    Chunks arrive in the order of their epoch, then of their number. The position of the
    last flush is a chunk of its own in the carried table: its time starts the clock.
    """
    spark = rows.sparkSession
    keys = list(how.keys)
    open_path, count_path = f"{how.root}/open", f"{how.root}/counts"
    row_type = rows.schema
    held = _read_epoch(spark, open_path, epoch_id - 1, row_type)
    count_type = ", ".join(
        [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
        + ["batches bigint", "clock_us bigint"]
    )
    counts = _read_epoch(spark, count_path, epoch_id - 1, count_type)

    tagged = held.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    chunk = F.col(how.chunk).cast("bigint")
    at_us = F.unix_micros(F.col(how.ts).cast("timestamp"))
    sizes = tagged.groupBy(*keys, "_new", chunk.alias("_chunk")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(at_us).alias("at_us")
    )
    # A clock row ahead of the chunks: as many rows as fill a batch, at the time of the last
    # flush. It completes a batch of its own, which starts the clock for the next one.
    clock = counts.select(
        *keys,
        F.lit(-1).alias("_new"),
        F.lit(-1).cast("bigint").alias("_chunk"),
        F.lit(how.size).cast("bigint").alias("rows"),
        F.col("clock_us").alias("at_us"),
    )
    seen = settle_rows(sizes.join(clock.select(*keys), keys, "left_semi").unionByName(clock))
    fresh = sizes.join(clock.select(*keys), keys, "left_anti")
    starts = fresh.groupBy(*keys).agg(F.min("at_us").alias("clock_us"))
    first_clock = starts.select(
        *keys, F.lit(-1).alias("_new"), F.lit(-1).cast("bigint").alias("_chunk"),
        F.lit(how.size).cast("bigint").alias("rows"), F.col("clock_us").alias("at_us"),
    )
    series = seen.unionByName(fresh).unionByName(first_clock)
    one = F.lit(1).cast("bigint")
    numbered = settle_rows(running_totals(series, keys, ["_new", "_chunk"], {"chunk_no": one}))
    labels = settle_rows(
        accumulate_chunks(numbered, keys, how.size, how.min_rows, how.timeout_seconds)
        .join(numbered.select(*keys, "chunk_no", "_new", "_chunk", "at_us"), [*keys, "chunk_no"])
    )

    done = labels.where("complete")
    after = done.groupBy(*keys).agg(
        F.max("batch").alias("_made"), F.max("at_us").alias("clock_us")
    )
    new_counts = after.join(counts.select(*keys, "batches"), keys, "left").select(
        *keys, (F.coalesce("batches", F.lit(0)) + F.col("_made")).alias("batches"), "clock_us"
    )
    match = labels.where(F.col("_new") >= 0).select(*keys, "_new", "_chunk", "batch", "complete")
    joined = tagged.withColumn("_chunk", chunk).join(match, [*keys, "_new", "_chunk"])
    append_epoch(joined.where(~F.col("complete")).select(*rows.columns), open_path, epoch_id)
    append_epoch(new_counts, count_path, epoch_id)
    before = counts.select(*keys, F.col("batches").alias("_before"))
    # The clock row took the first number of this epoch.
    number = F.coalesce("_before", F.lit(0)) + F.col("batch") - 1
    closed = joined.where("complete").join(before, keys, "left")
    return closed.select(*rows.columns, number.cast("bigint").alias("batch"))


def stream_batches(
    stream: DataFrame,
    how: Gathering,
    out: str,
    checkpoint: str,
    then: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Write the rows of complete batches to `out`, one folder per epoch, until the input ends.

    `then` is called with the complete batches of each epoch, e.g. to grade them. The rows
    still open at the end are in the `open` table of the last epoch.
    """

    def epoch(rows: DataFrame, epoch_id: int) -> None:
        closed = gather_epoch(settle_rows(rows), epoch_id, how)
        append_epoch(closed, out, epoch_id)
        if then is not None:
            then(rows.sparkSession.read.parquet(f"{out}/epoch={epoch_id}"), epoch_id)

    return (
        stream.writeStream.foreachBatch(epoch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def grade_epoch(
    metrics: DataFrame,
    summary: DataFrame,
    spec: BatchSpec,
    root: str,
    epoch_id: int,
    domain: str | None = None,
) -> DataFrame:
    """Grade the batches of one epoch with the statuses stored by earlier ones.

    The last statuses per (model, metric) are all the persistence rule looks at; they are
    carried from epoch to epoch next to the appended `evaluated` table.
    """
    spark = metrics.sparkSession
    model, order = spec.model, spec.by[-1]
    series = [model, "metric"]
    graded = grade_raw(metrics, summary, domain or spec.domain, model=model)
    tail_path = f"{root}/tail"
    old = _read_epoch(spark, tail_path, epoch_id - 1, graded.schema)
    both = old.withColumn("_new", F.lit(0)).unionByName(graded.withColumn("_new", F.lit(1)))
    final = settle_rows(persist_filter(both, series, ["_new", order]))
    append_epoch(final.where("_new = 1").drop("_new"), f"{root}/evaluated", epoch_id)
    depth = max(c["persistence"] for c in DOMAINS.values())
    newest = Window.partitionBy(*series).orderBy(F.desc("_new"), F.desc(order))
    tail = final.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= depth)
    append_epoch(tail.select(*graded.columns), tail_path, epoch_id)
    return spark.read.parquet(f"{root}/evaluated/epoch={epoch_id}")


def grade_epoch_late(
    metrics: DataFrame,
    summary: DataFrame,
    spec: BatchSpec,
    root: str,
    epoch_id: int,
    order: Sequence[str],
    domain: str | None = None,
) -> DataFrame:
    """Grade the batches of one epoch at their place in time, which may lie before graded ones.

    `metrics` has the columns of `order`, which tell when a batch was and end with its key. An epoch
    writes its batches and those it gave another look; `current_grades` reads the newest of each.
    A repeated epoch reads what the epochs before it wrote and replaces its own folder.
    """
    spark = metrics.sparkSession
    series = [spec.model, "metric"]
    raw = settle_rows(grade_raw(metrics, summary, domain or spec.domain, model=spec.model))
    path = f"{root}/evaluated"
    if epoch_id == 0:
        changed = persist_filter(raw, series, order).withColumn("late", F.lit(True))
    else:
        stored = current_grades(spark, root, series, order, epoch_id)
        changed = regrade_late(stored, raw, series, order)
    append_epoch(changed, path, epoch_id)
    return spark.read.parquet(f"{path}/epoch={epoch_id}")


def current_grades(
    spark: SparkSession, root: str, series: Sequence[str], order: Sequence[str], before: int | None = None
) -> DataFrame:
    """The newest grade of every batch, from the epochs below `before` if that is given."""
    stored = spark.read.parquet(f"{root}/evaluated")
    if before is not None:
        stored = stored.where(F.col("epoch") < before)
    columns = [c for c in stored.columns if c not in (*series, *order, "epoch", "late")]
    newest = stored.groupBy(*series, *order).agg(F.max_by(F.struct(*columns), "epoch").alias("_row"))
    return newest.select(*series, *order, "_row.*")
