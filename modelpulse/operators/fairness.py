"""Fairness vitals: statistical parity and the Gini coefficient of the predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelpulse.functions.joins import lookup_join
from modelpulse.functions.ordering import into_slices
from modelpulse.functions.scalars import missing, plain_double, zero_one
from modelpulse.functions.storage import settle_counted
from modelpulse.spec import PARITY, BatchSpec, SpecError


def parity_categorical(
    df: DataFrame, prediction: str, group: str, by: Sequence[str], name: str = PARITY
) -> DataFrame:
    """Largest difference between the mean predictions of two groups; 0 below two groups.

    The first aggregation is partial on the map side and leaves one row per group, so a hot
    batch or group costs a few rows per task. Rows without a group do not count.
    """
    by = list(by)
    # A batch must keep its row when none of its rows has a group, so those rows stay as one
    # group of their own with no rate.
    label = F.when(~missing(df, group), F.col(group))
    rates = (
        df.select(*by, label.alias("_group"), F.col(prediction).cast("double").alias("_x"))
        .groupBy(*by, "_group")
        .agg(F.avg("_x").alias("_mean"))
    )
    rate = F.when(F.col("_group").isNotNull(), F.col("_mean"))
    spread = F.max(rate) - F.min(rate)
    return rates.groupBy(*by).agg(
        F.when(F.count("_group") < 2, F.lit(0.0)).otherwise(spread).alias(name)
    )


def parity_one_hot(
    df: DataFrame, prediction: str, columns: Sequence[str], by: Sequence[str], name: str = PARITY
) -> DataFrame:
    """The same over 0/1 columns: a column's group is its rows with 1; empty columns are left out."""
    facts = [c.alias(n) for n, c in one_hot_facts(df, prediction, columns).items()]
    return df.groupBy(*by).agg(*facts).select(*by, one_hot_spread(len(columns)).alias(name))


def one_hot_facts(df: DataFrame, prediction: str, columns: Sequence[str]) -> dict[str, Column]:
    """Aggregates of a batch that its one-hot parity follows from."""
    facts = {}
    for i, c in enumerate(columns):
        member = zero_one(df, c) == 1
        facts[f"_g{i}"] = F.avg(F.when(member, F.col(prediction).cast("double")))
        facts[f"_n{i}"] = F.count_if(member)
    return facts


def one_hot_spread(n: int) -> Column:
    """Parity of `n` columns from their facts."""
    groups = sum([F.when(F.col(f"_n{i}") > 0, 1).otherwise(0) for i in range(n)], F.lit(0))
    rates = F.array(*[F.col(f"_g{i}") for i in range(n)])
    spread = F.array_max(rates) - F.array_min(rates)
    return F.when(groups < 2, F.lit(0.0)).otherwise(spread)


def statistical_parity(df: DataFrame, spec: BatchSpec, name: str = PARITY) -> DataFrame:
    protected = spec.protected
    if protected is None:
        raise SpecError("no protected attributes given")
    if protected.kind == "categorical":
        return parity_categorical(df, spec.prediction, protected.columns[0], spec.by, name)
    if protected.kind == "one_hot":
        return parity_one_hot(df, spec.prediction, protected.columns, spec.by, name)
    raise SpecError("protected attribute type must be 'categorical' or 'one_hot'")


def gini(df: DataFrame, prediction: str, by: Sequence[str], name: str = "gini") -> DataFrame:
    """Mean absolute difference of all pairs over twice the mean, without forming a pair.

    With the distinct values in ascending order, c copies of x and `before` smaller rows,
    the sum over pairs is  2 * sum of x*c*(2*before + c - n). Values are counted first;
    `before` is split into a part inside a slice of the value range and the total of the
    slices below, which enters only as a factor of the slice sums, so no row is joined.
    An ARRAY prediction (class probabilities) counts with its largest entry.
    """
    by = list(by)
    dtype = df.schema[prediction].dataType
    value = F.array_max(prediction) if dtype.typeName() == "array" else F.col(prediction)
    counted = (
        df.select(*by, value.cast("double").alias("_x"))
        .groupBy(*by, "_x")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    below = (
        Window.partitionBy(*by, "_slice")
        .orderBy("_x")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sliced = into_slices(counted, by, ["_x"]).withColumn("_below", F.sum("_c").over(below))
    per_slice = sliced.groupBy(*by, "_slice").agg(
        F.expr("sum(_c) as _n"),
        F.expr("sum(_x * _c) as _s"),
        F.expr("sum(_x * _c * (2 * coalesce(_below, 0) + _c)) as _g"),
        F.expr("max(_x is null or isnan(_x)) as _bad"),
    )
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifted = per_slice.withColumn("_off", F.sum("_n").over(earlier))
    total = shifted.groupBy(*by).agg(
        F.expr("max(_bad) as _bad"),
        F.expr("sum(_n) as _n"),
        F.expr("sum(_s) as _s"),
        F.expr("sum(_g + 2 * coalesce(_off, 0) * _s) as _g"),
    )
    value = "case when _bad then double('nan') when _s = 0 then 0D else (_g - _n * _s) / (_n * _s) end"
    return total.selectExpr(*by, f"{value} as {name}")


def minmax_normalize(
    df: DataFrame, column: str, by: Sequence[str], name: str, row_id: Sequence[str] = ()
) -> DataFrame:
    """(x - min) / (max - min) inside each set; NULL where the set is constant."""
    by = list(by)
    ranges, rows = settle_counted(
        df.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    )
    joined = lookup_join(df, ranges, by, spread_by=row_id, rows=rows)
    span = F.col("_hi") - F.col("_lo")
    return joined.select(
        *df.columns, F.try_divide(plain_double(column) - F.col("_lo"), span).alias(name)
    )
