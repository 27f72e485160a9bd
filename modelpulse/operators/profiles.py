"""Baseline profiles that grow: counted into a fixed grid per part, merged, cut into bins later.

The range of a feature, and so its bins, is known only once all rows are. A part (a day, a run) is
therefore counted into cells that depend on nothing but the value: CELLS to each power of two. A
cell keeps its row count, moments and the smallest and largest value in it. Cells of any number
of parts add up to the cells of all their rows, without a look at the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelpulse.functions.joins import lookup_join
from modelpulse.functions.storage import settle, settle_counted, settle_rows
from modelpulse.operators.drift import FINITE, long_features, with_bin
from modelpulse.spec import PSI_BINS

CELLS = 128
#: Below this all values share the cell of 0, as the width of a cell would be no number.
SMALLEST = "1e-290D"


def _cell() -> str:
    """Lower end of the cell of x (the upper one below 0 is nearer to 0); NULL for what is no number."""
    width = f"pow(2D, floor(log2(abs(x))) - {CELLS.bit_length() - 1})"
    return f"case when not ({FINITE}) then null when abs(x) < {SMALLEST} then 0D else floor(x / {width}) * {width} end"


def profile_cells(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, feature, cell, n, filled, mean, m2, lo, hi) of one scan, partly combined before the shuffle.

    `keys` are the model and the part. `n` counts rows and `filled` those with a value; m2 is the sum
    of squared distances from the mean. Missing and infinite values are in the cell NULL.
    """
    long = long_features(df, features, list(keys)).withColumn("cell", F.expr(_cell()))
    return long.groupBy(*keys, "feature", "cell").agg(
        F.expr("count(*) as n"),
        F.expr("count(x) as filled"),
        F.expr("avg(x) as mean"),
        F.expr("var_pop(x) * count(x) as m2"),
        F.expr("min(x) as lo"),
        F.expr("max(x) as hi"),
    )


def merge_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of several parts as cells of all of them; `keys` without the part.

    Squared distances are moved from the means of the parts to the common one, which is found first, so
    values far from 0 and close together lose no digits. How often parts were merged before
    doesn't matter. The common mean and the sums take one shuffle.
    """
    cell = Window.partitionBy(*keys, "feature", "cell")
    off = "filled * (mean - coalesce(cell, 0D))"
    found = cells.withColumn("_mean", F.sum(F.expr(off)).over(cell) / F.nullif(F.sum("filled").over(cell), F.lit(0)))
    shifted = found.withColumn("_mean", F.expr("coalesce(cell, 0D) + _mean"))
    return (
        shifted.groupBy(*keys, "feature", "cell")
        .agg(
            F.expr("sum(n) as n"),
            F.expr("sum(filled) as filled"),
            F.expr("any_value(_mean) as mean"),
            F.expr("sum(m2 + filled * (mean - _mean) * (mean - _mean)) as m2"),
            F.expr("min(lo) as lo"),
            F.expr("max(hi) as hi"),
        )
        .withColumn("mean", F.expr("if(lo = hi, lo, mean)"))
    )


def profile_from_cells(cells: DataFrame, model: str = "model_id", bins: int = PSI_BINS) -> DataFrame:
    """The columns of `baseline_profile`, and `slack`: by how much a share may be off.

    Count, mean, deviation and range are those of all rows. A cell whose smallest and largest value
    lie in one bin is counted exactly; a cell that an edge cuts goes to the bin of its mean, and its
    share of the rows is part of `slack`. Where no edge cuts a cell, as with whole numbers
    below CELLS, `slack` is 0. An edge cuts one cell at most. Settled.
    """
    merged = settle_rows(merge_cells(cells, [model]))
    stats = merged.groupBy(model, "feature").agg(
        F.expr("sum(n) as n"),
        F.expr("sum(filled) as _filled"),
        F.expr("sum(filled * mean) / nullif(sum(filled), 0) as mean"),
        F.expr("min(lo) as lo"),
        F.expr("max(hi) as hi"),
        F.expr("bool_and(cell is not null) as usable"),
    )
    stats, rows = settle_counted(
        stats.selectExpr(
            model, "feature", "n", "_filled", "if(lo = hi, lo, mean) as mean", "lo", "hi",
            "if(lo = hi, lo - 0.5D, lo) as edge_lo", "if(lo = hi, hi + 0.5D, hi) as edge_hi", "usable",
        )
    )
    total = stats.select(model, "feature", "edge_lo", "edge_hi", F.col("mean").alias("_mean"))
    placed = lookup_join(merged, total, [model, "feature"], spread_by=["cell"], rows=rows)
    for name in ("lo", "hi", "mean"):
        placed = with_bin(placed.withColumn("x", F.col(name)), bins).withColumnRenamed("_bin", f"_bin_{name}")
        placed = placed.drop("_guess", "x")
    counted = placed.groupBy(model, "feature").agg(
        F.expr("sum(m2 + filled * (mean - _mean) * (mean - _mean)) as _m2"),
        F.expr("coalesce(sum(n) filter (where _bin_lo <> _bin_hi), 0) as _cut"),
        *[F.expr(f"coalesce(sum(n) filter (where _bin_mean = {i}), 0) as _b{i}") for i in range(bins)],
    )
    shares = "array(" + ", ".join(f"_b{i} / n" for i in range(bins)) + ")"
    joined = lookup_join(counted, stats, [model, "feature"], rows=rows)
    return settle(
        joined.selectExpr(
            model, "feature", "n", "mean", "if(lo = hi, 0D, sqrt(_m2 / nullif(_filled, 0))) as std", "lo", "hi",
            "edge_lo", "edge_hi", "usable", f"{shares} as p", "_cut / n as slack",
        )
    )
