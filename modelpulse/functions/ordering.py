"""Positions and running totals inside a key, without one task per key.

A plain window sorts all rows of a key in one task. Here the rows are range-partitioned by
(key, order), so a key with a third of the table spreads over a third of the slices; each
slice is summed by itself and the totals of the slices before it are added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelpulse.functions.storage import settle_rows

BLOCK = 100_000


def into_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition by (keys, order) and note the slice number, ascending in that order.

    No number of slices is given, so adaptive execution merges neighbouring small ones.
    """
    return df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    amounts: Mapping[str, Column],
) -> DataFrame:
    """Add, per entry of `amounts`, the total of that amount over the earlier rows of the key.

    `order` must be a total order inside a key. The carried totals have at most one row per
    slice (only the first key of a slice can have begun in an earlier one), which bounds
    the broadcast by the number of shuffle partitions.
    """
    keys, order, names = list(keys), list(order), list(amounts)
    cells = [amounts[c].alias(f"_in_{c}") for c in names]
    sliced = settle_rows(into_slices(df.select("*", *cells), keys, order))

    key, rank = ", ".join(f"`{k}`" for k in keys), ", ".join(f"`{c}`" for c in order)
    earlier = "rows between unbounded preceding and 1 preceding"
    per_slice = sliced.groupBy(*keys, "_slice").agg(
        *[F.expr(f"sum(`_in_{c}`) as `_sum_{c}`") for c in names]
    )
    carried = per_slice.selectExpr(
        *[f"`{k}` as `_k_{k}`" for k in keys],
        "_slice as _k_slice",
        *[
            f"sum(`_sum_{c}`) over (partition by {key} order by _slice {earlier}) as `_carry_{c}`"
            for c in names
        ],
    ).where(f"`_carry_{names[0]}` is not null")
    local = sliced.selectExpr(
        *[f"`{c}`" for c in df.columns],
        "_slice",
        *[
            f"sum(`_in_{c}`) over (partition by {key}, _slice order by {rank} {earlier})"
            f" as `_here_{c}`"
            for c in names
        ],
    )
    match = " and ".join(["_slice = _k_slice", *[f"`{k}` <=> `_k_{k}`" for k in keys]])
    joined = local.join(F.broadcast(carried), F.expr(match), "left")
    return joined.selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[f"coalesce(`_here_{c}`, 0) + coalesce(`_carry_{c}`, 0) as `{c}`" for c in names],
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_no"
) -> DataFrame:
    """Position of every row inside its key, from 0, in the given total order."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")})


def overlapped(df: DataFrame, seq: str, back: int, block: int = BLOCK) -> DataFrame:
    """Cut the positions of a key into blocks that each also hold the `back` rows before them.

    A window over (key, _block) with a frame of at most `back` preceding rows then sees all
    it needs, in groups of bounded size. Rows with `_home` other than `_block` are context:
    drop them after the window with `own_rows`.
    """
    block = max(block, back)
    home = f"cast(floor(`{seq}` / {block}) as bigint)"
    reaches_next = f"pmod(`{seq}`, {block}) >= {block - back}"
    blocks = f"explode(if({reaches_next}, array({home}, {home} + 1), array({home}))) as _block"
    return df.selectExpr("*", f"{home} as _home", blocks)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("_home") == F.col("_block")).drop("_home", "_block")
