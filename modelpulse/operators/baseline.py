"""Baseline of a model: expected mean and deviation per vital, and checks of that table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelpulse.spec import BASELINE_DEFAULTS, PARITY, REQUIRED_METRICS, BatchSpec


def baseline_pred_stats(df: DataFrame, spec: BatchSpec) -> DataFrame:
    """The 'gini' baseline: mean and population deviation of the predictions themselves."""
    x = F.col(spec.prediction).cast("double")
    stats = df.groupBy(spec.model).agg(
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("_std"),
        F.min(x).alias("_lo"),
        F.max(x).alias("_hi"),
    )
    # Equal predictions have no deviation; rounding would leave a tiny one.
    std = F.when(F.col("_lo") == F.col("_hi"), F.lit(0.0)).otherwise(F.col("_std"))
    return stats.select(spec.model, F.lit("gini").alias("metric"), "mean", std.alias("std"))


def _fixed(fairness: bool) -> str:
    """The fixed expectations as SQL structs; parity only with fairness on."""
    return ", ".join(
        f"struct('{m}' as metric, {mean}D as mean, {std}D as std)"
        for m, (mean, std) in BASELINE_DEFAULTS.items()
        if fairness or m != PARITY
    )


def baseline_defaults(models: DataFrame, fairness: bool, model: str = "model_id") -> DataFrame:
    """The fixed expectations of the other vitals for every model; parity only with fairness on."""
    return models.selectExpr(model, f"inline(array({_fixed(fairness)}))")


def baseline_summary(df: DataFrame, spec: BatchSpec) -> DataFrame:
    """Long table (model, metric, mean, std); one scan of the baseline rows."""
    stats = baseline_pred_stats(df, spec)
    own = "struct(metric, mean, std)"
    return stats.selectExpr(spec.model, f"inline(array({own}, {_fixed(spec.protected is not None)}))")


def summary_from_profile(profile: DataFrame, spec: BatchSpec) -> DataFrame:
    """The same table from a profile that also covers the prediction column; no scan."""
    own = profile.where(F.col("feature") == spec.prediction).select(
        spec.model, F.lit("gini").alias("metric"), "mean", "std"
    )
    fixed = baseline_defaults(own, spec.protected is not None, spec.model)
    return own.unionByName(fixed)


def check_baseline(
    summary: DataFrame, models: DataFrame, fairness: bool, model: str = "model_id"
) -> DataFrame:
    """Violations (model, metric, problem): a required metric missing or unusable numbers.

    mean and std may come as text, as in a hand-written baseline file; text that is no
    number is a violation of its own.
    """
    required = [*REQUIRED_METRICS, *([PARITY] if fairness else [])]
    wanted = models.select(model).distinct().select(
        model, F.explode(F.array(*[F.lit(m) for m in required])).alias("metric")
    )
    mean, std = F.col("mean").cast("string"), F.col("std").cast("string")
    rows = summary.select(
        model, "metric", mean.alias("_mean"), std.alias("_std"), F.lit(True).alias("_there")
    )
    joined = wanted.join(rows, [model, "metric"], "left")
    mean_no = F.expr("try_cast(_mean as double)")
    std_no = F.expr("try_cast(_std as double)")
    problem = (
        F.when(F.col("_there").isNull(), "missing metric")
        .when(F.col("_mean").isNull() | F.col("_std").isNull(), "missing mean or std")
        .when(mean_no.isNull(), "mean not numeric")
        .when(std_no.isNull(), "std not numeric")
        .when(std_no < 0, "negative std")
    )
    return joined.select(model, "metric", problem.alias("problem")).where("problem is not null")
