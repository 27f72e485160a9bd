"""Joins of a large table with a lookup table whose size is not known beforehand.

Spark judges a settled table by its compressed files and takes no account of copies made by
`explode`, so a table of millions of rows may pass for one that fits the driver. Tables that were not
counted, and copies, therefore carry the hint `merge`, which keeps them from being broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelpulse.functions.storage import settle

BROADCAST_ROWS = 200_000
SALTS = 32
#: Rows of one key that a task may hold.
HOT_ROWS = 10_000


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `limit` rows; stops reading one row past the limit."""
    return df.limit(limit + 1).count() <= limit


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] = (),
    limit: int = BROADCAST_ROWS,
    salts: int = SALTS,
    rows: int | None = None,
) -> DataFrame:
    """Join `left` with a narrow, settled lookup table on equal columns.

    A table of at most `limit` rows is broadcast. A larger one is shuffled, with every
    lookup row repeated for `salts` salts, so that the rows of one hot key on the left go
    to many tasks; the salt of a left row is a hash of its `spread_by` columns and stays
    the same when a task is run again. `rows` is the size of the lookup table where it
    was counted before; else it is counted here, up to the limit.
    """
    on = list(on)
    if is_small(right, limit) if rows is None else rows <= limit:
        return left.join(F.broadcast(right), on, how)
    spread = [c for c in spread_by if c in left.columns] or left.columns
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def even_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", hot: int = HOT_ROWS
) -> DataFrame:
    """Join `left`, which is settled, with a lookup table that may be as large.

    Only keys with more than `hot` rows on the left are salted, so the lookup table is not repeated
    for all others. There is at most one hot key to `hot` rows.
    """
    on = list(on)
    keys = left.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / F.lit(hot)).cast("int").alias("_salts")).where("_salts > 1")
    salts = settle(keys)
    dealt = left.join(F.broadcast(salts), on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*left.columns), F.coalesce("_salts", F.lit(1))).cast("int")
    )
    copies = right.join(F.broadcast(salts), on, "left").withColumn(
        "_salt", F.explode(F.expr("sequence(0, coalesce(_salts, 1) - 1)"))
    )
    return dealt.drop("_salts").join(copies.drop("_salts").hint("merge"), [*on, "_salt"], how).drop("_salt")
