"""Transparency vital from attribution values: peak-relative mean times normalized entropy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelpulse.functions.joins import BROADCAST_ROWS, lookup_join
from modelpulse.functions.storage import settle_counted
from modelpulse.spec import EPSILON, LOG_EPSILON, TOP_FEATURES


# Value from the totals of a batch and its entropy sum; 0 where nothing was attributed.
SCORE = f"""
    case when _given = 0 then 0D
         when _given < _cells then double('nan')
         when _total = 0 then 0D
         else _total / _cells / (_peak + {EPSILON}D) * (-_entropy / ln(_rows + {LOG_EPSILON}D))
    end"""


def shap_score(
    df: DataFrame, shap: str, by: Sequence[str], name: str = "shap_importance"
) -> DataFrame:
    """Score per batch for a numeric column, or for an ARRAY column (rows x features).

    With an array the sums run over all cells but the entropy is divided by the logarithm
    of the number of rows. A batch without any attribution scores 0.

    The entropy needs the batch total, hence two passes: totals are settled and looked up.
    While they are few they are broadcast and no row is shuffled. Beyond that the equal
    values of a batch are counted first, so copies do not travel, and the join is salted by
    the value.
    """
    by = list(by)
    is_array = df.schema[shap].dataType.typeName() == "array"
    if is_array:
        exploded = df.selectExpr(*by, f"posexplode_outer({shap}) as (_pos, _v)")
        value, first = "abs(cast(_v as double)) as _v", "if(coalesce(_pos, 0) = 0, 1, 0) as _first"
        cells = exploded.selectExpr(*by, value, first)
    else:
        cells = df.selectExpr(*by, f"abs(cast({shap} as double)) as _v", "1 as _first")
    given = "_v is not null and not isnan(_v)"
    totals, rows = settle_counted(
        cells.groupBy(*by).agg(
            F.expr("sum(_first) as _rows"),
            F.expr("count(*) as _cells"),
            F.expr(f"count_if({given}) as _given"),
            F.expr(f"coalesce(sum(if({given}, _v, null)), 0D) as _total"),
            F.expr(f"coalesce(max(if({given}, _v, null)), 0D) as _peak"),
        )
    )
    valued = cells.where(f"{given} and _v > 0")
    if rows <= BROADCAST_ROWS:
        counted = valued.withColumn("_c", F.lit(1))
    else:
        counted = valued.groupBy(*by, "_v").agg(F.expr("count(*) as _c"))
    sums = totals.where("_total > 0").select(*by, "_total")
    entropy = (
        lookup_join(counted, sums, by, spread_by=["_v"], rows=rows)
        .groupBy(*by)
        .agg(F.expr(f"sum(_c * _v / _total * ln(_v / _total + {LOG_EPSILON}D)) as _entropy"))
    )
    return totals.join(entropy, by, "left").selectExpr(*by, f"{SCORE} as {name}")


def feature_importance_topk(
    df: DataFrame, shap: str, by: Sequence[str], k: int = TOP_FEATURES
) -> DataFrame:
    """The k features with the largest mean absolute attribution, as shares of their sum.

    The windows run over one row per feature of the array.
    """
    by = list(by)
    means = (
        df.select(*by, F.posexplode(shap).alias("feature", "_v"))
        .groupBy(*by, "feature")
        .agg(F.avg(F.abs(F.col("_v").cast("double"))).alias("mean_abs"))
    )
    best = Window.partitionBy(*by).orderBy(F.desc("mean_abs"), "feature")
    whole = Window.partitionBy(*by)
    ranked = means.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(
        *by,
        "rank",
        "feature",
        "mean_abs",
        F.try_divide(F.col("mean_abs"), F.sum("mean_abs").over(whole)).alias("weight"),
    )
