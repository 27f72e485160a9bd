"""Places that outlive an executor: checkpoints and scratch tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Remove the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or current
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="modelpulse-")
    if current is None:
        context.setCheckpointDir(root)
    return root


def settle(df: DataFrame) -> DataFrame:
    """Compute a small table once and cut the lineage there."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_rows(df: DataFrame) -> DataFrame:
    """The same for a table that grows with the scored rows.

    It is written as files of the shared folder: compressed, unlike a checkpoint, and later
    steps read only the columns they use. The tables of an application share one folder, to
    be removed after it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "settled")
    _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


class Passing:
    """Tables that a call settles on the way to a settled result and removes behind it.

    Only what no later step reads may be removed: a result that still reads one of them fails.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def settle_rows(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "passing")
        _write(df, path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, keep: int = 0) -> None:
        """Remove all but the newest `keep` tables."""
        gone = self.paths[: len(self.paths) - keep]
        self.paths = self.paths[len(gone) :]
        for path in gone:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def _write(df: DataFrame, path: str) -> None:
    """Write files that replace all that was shuffled for them; else shuffles pile up until
    the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def settle_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`settle`, with the number of rows counted on the way instead of by a second job."""
    seen = Observation()
    settled = settle(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return settled, int(seen.get["n"])


def settle_rows_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`settle_rows`, with the number of rows counted on the way."""
    seen = Observation()
    settled = settle_rows(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return settled, int(seen.get["n"])


def settle_observed(df: DataFrame, **seen: Column) -> tuple[DataFrame, dict]:
    """`settle`, with totals of the rows taken on the way: an aggregate per name."""
    note = Observation()
    settled = settle(df.observe(note, *[c.alias(n) for n, c in seen.items()]))
    return settled, note.get


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name for a table that one call writes and reads back."""
    application = f"modelpulse-{spark.sparkContext.applicationId}"
    return f"{shared_root(spark).rstrip('/')}/{application}/{label}-{uuid.uuid4().hex}"
