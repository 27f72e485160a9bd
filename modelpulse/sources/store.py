"""The vitals table: append, idempotent append of a stream, latest row."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_vitals(record: DataFrame, path: str, time: str = "time") -> None:
    """Append records to a table partitioned by date.

    The rebalance hint gathers the rows of a date into few files and splits a date that is
    much larger than the others.
    """
    dated = record.withColumn("date", F.to_date(time))
    dated.hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(path)


def append_epoch(df: DataFrame, path: str, epoch_id: int) -> None:
    """Write one micro-batch to its own folder; a repeated epoch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")


def append_jdbc(record: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Append records to a relational table through a JDBC driver on the class path."""
    record.write.mode("append").jdbc(url, table, properties=properties)


def latest_vitals(vitals: DataFrame, time: str = "time", model: str = "model_id") -> DataFrame:
    """The newest row of all; a row with status 'no_data' if there is none."""
    newest = F.max_by(F.struct(*vitals.columns), F.struct(time, model)).alias("_v")
    row = vitals.agg(newest).select("_v.*")
    return row.withColumn("status", F.coalesce("status", F.lit("no_data")))


def latest_per_model(vitals: DataFrame, time: str = "time", model: str = "model_id") -> DataFrame:
    newest = F.max_by(F.struct(*vitals.columns), time).alias("_v")
    return vitals.groupBy(model).agg(newest).select("_v.*")


# --- append that can be repeated --------------------------------------------------------------
#
# <path>/data/run=<id>/date=... holds what one run wrote, <path>/commits/run=<id> one row that is
# written after it. Rows count once their run is committed; a run that is repeated writes its own
# folders again, and one that stops between the two writes leaves nothing that is read.

COMMIT = "run string, replaces array<string>"


def append_once(record: DataFrame, path: str, run_id: str, time: str = "time", replaces: list[str] | None = None) -> None:
    """Append the records of one run; the same run again replaces what it wrote before."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run_id):
        raise ValueError(f"not a name of a run: {run_id!r}")
    dated = record.withColumn("date", F.to_date(time))
    dated.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(f"{path}/data/run={run_id}")
    done = record.sparkSession.createDataFrame([(run_id, replaces or [])], COMMIT)
    done.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/run={run_id}")


def committed_runs(spark: SparkSession, path: str) -> list[str]:
    """Runs whose rows count, in order of name; a run that a later one has taken in doesn't.

    One name per run since the table was last compacted.
    """
    commits = spark.read.schema(COMMIT).parquet(f"{path}/commits/run=*")
    taken = commits.select(F.explode("replaces").alias("run")).distinct()
    return sorted(r.run for r in commits.join(taken, "run", "left_anti").collect())


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed runs, without the folders' columns."""
    folders = [f"{path}/data/run={r}" for r in committed_runs(spark, path)]
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("run", "date")


def compact(spark: SparkSession, path: str, run_id: str, time: str = "time") -> None:
    """Take all committed runs into one. They are read until it is committed, and left out after."""
    runs = committed_runs(spark, path)
    if run_id in runs:
        raise ValueError(f"the run {run_id} is there already")
    append_once(read_committed(spark, path), path, run_id, time, replaces=runs)


def remove_replaced(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders of runs that a committed one has taken in; returns their names.

    Their commits stay, so that a reader that listed them before finds the newer one on its next try.
    """
    commits = spark.read.schema(COMMIT).parquet(f"{path}/commits/run=*")
    old = sorted(r.run for r in commits.select(F.explode("replaces").alias("run")).distinct().collect())
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for run in old:
        folder = hadoop(f"{path}/data/run={run}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return old
