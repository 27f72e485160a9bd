"""Shaping of vitals for storage and display."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelpulse.operators.graph import status_score
from modelpulse.spec import LATENCY_LIMIT_MS, PARITY

# What a record shows where a metric is absent, and the two security levels.
DEFAULT_FAIRNESS, DEFAULT_PSI, DEFAULT_PRIVACY, DEFAULT_GINI = 0.85, 0.08, 0.90, 0.45
SECURITY_NORMAL, SECURITY_ALARM = 0.95, 0.68
POINTS = 15
SCORES = ("fairness", "stability", "security", "privacy", "transparency")


def vitals_record(evaluated: DataFrame, by: Sequence[str]) -> DataFrame:
    """One composite row per batch from the long table of graded vitals.

    Status and scores come from the same aggregation. Transparency shows the Gini value.
    """
    def of(name: str, default: float) -> str:
        return f"coalesce(max(if(metric = '{name}', value, null)), {default}D)"

    worst = "max(case status when 'critical' then 2 when 'warning' then 1 else 0 end)"
    pivoted = evaluated.groupBy(*by).agg(
        F.expr(f"{of(PARITY, DEFAULT_FAIRNESS)} as fairness"),
        F.expr(f"1 - {of('psi', DEFAULT_PSI)} as stability"),
        F.expr(f"{of('privacy_score', DEFAULT_PRIVACY)} as privacy"),
        F.expr(f"{of('gini', DEFAULT_GINI)} as transparency"),
        F.expr(f"{worst} as _worst"),
    )
    return pivoted.selectExpr(
        *by, "fairness", "stability",
        f"if(_worst = 0, {SECURITY_NORMAL}D, {SECURITY_ALARM}D) as security",
        "privacy", "transparency",
        "case _worst when 2 then 'critical' when 1 then 'warning' else 'normal' end as status",
    )


def vitals_percent(record: DataFrame) -> DataFrame:
    """The five scores in percent with one decimal."""
    return record.select(
        *[F.round(F.col(c) * 100, 1).alias(c) if c in SCORES else F.col(c) for c in record.columns]
    )


def trace_nodes(traces: DataFrame, column: str = "trace") -> DataFrame:
    """Nodes of trace documents: (name, label, owner, status, alert, downstream).

    The document may hold the nodes directly or below a `nodes` key.
    """
    shape = "map<string, struct<name: string, owner: string, status: string, downstream: array<string>>>"
    text = F.col(column)
    # Most documents show by their text where the nodes are, and are read only once.
    named = text.contains('"nodes"') | text.contains("\\u")
    body = F.when(named, F.coalesce(F.get_json_object(column, "$.nodes"), text)).otherwise(text)
    nodes = F.when(text.rlike(r'^\s*\{\s*"nodes"\s*:\s*\{'), F.from_json(text, f"nodes {shape}")["nodes"])
    rows = traces.select(F.explode(F.coalesce(nodes, F.from_json(body, shape))).alias("_name", "_node"))
    node = rows.select("_node.*")
    return node.select(
        "name",
        F.replace(F.col("name"), F.lit("_"), F.lit(" ")).alias("label"),
        "owner",
        "status",
        F.coalesce(F.col("status").isin("critical", "warning"), F.lit(False)).alias("alert"),
        "downstream",
    )


def trace_edges(traces: DataFrame, column: str = "trace") -> DataFrame:
    """Edges of trace documents: (id, source, target, alert of the source)."""
    nodes = trace_nodes(traces, column)
    pairs = nodes.select(
        F.col("name").alias("source"), F.explode("downstream").alias("target"), "alert"
    )
    return pairs.select(
        F.concat_ws("-", F.lit("e"), "source", "target").alias("id"), "source", "target", "alert"
    )


def psi_rolling(
    record: DataFrame, model: str, order: Sequence[str], points: int = POINTS
) -> DataFrame:
    """The last points of 1 - stability per model, three decimals, numbered in time order.

    The rank filter is one Spark pushes below the shuffle, so each task sends at most
    `points` rows per model.
    """
    newest = Window.partitionBy(model).orderBy(*[F.desc(c) for c in order])
    last = record.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= points)
    forward = Window.partitionBy(model).orderBy(F.desc("_rn"))
    return last.select(
        model, *order, F.round(1 - F.col("stability"), 3).alias("psi"),
        F.row_number().over(forward).alias("point"),
    )


def vitals_summary(
    evaluated: DataFrame,
    by: Sequence[str],
    latency: DataFrame | None = None,
    batches: DataFrame | None = None,
) -> DataFrame:
    """Averages per model over its batches; a batch without a metric counts 0.

    `latency` has the keys and latency_ms per batch. `batches` lists the keys of all batches, the
    rejected ones too, whose metrics count 0; without it only graded batches are averaged over.
    """
    metric, value = F.col("metric"), F.col("value")

    def of(name: str) -> Column:
        return F.coalesce(F.max(F.when(metric == name, value)), F.lit(0.0))

    per_batch = evaluated.groupBy(*by).agg(
        of("gini").alias("gini"), of("psi").alias("psi"),
        of("privacy_score").alias("privacy"), of("shap_importance").alias("shap"),
    )
    if batches is not None:
        per_batch = batches.select(*by).distinct().join(per_batch, list(by), "left").na.fill(
            0.0, ["gini", "psi", "privacy", "shap"]
        )
    if latency is None:
        per_batch = per_batch.withColumn("latency_ms", F.lit(0.0))
    else:
        per_batch = per_batch.join(latency.select(*by, "latency_ms"), list(by), "left")
    return per_batch.groupBy(by[0]).agg(
        F.count(F.lit(1)).alias("batches"),
        F.avg("gini").alias("avg_gini"),
        F.avg("psi").alias("avg_psi"),
        F.avg("privacy").alias("avg_privacy"),
        F.avg("shap").alias("avg_shap"),
        F.avg(F.coalesce("latency_ms", F.lit(0.0))).alias("avg_latency_ms"),
    )


def summary_interpretation(summary: DataFrame, status: Column, model: str = "model_id") -> DataFrame:
    """Report lines (stage, metric, value, text) of each model's summary.

    `status` is the node status of the model.
    """
    # The wording of the report lines.
    shap_text = F.when(F.col("avg_shap") < 1.0, "Feature importance stable").otherwise(
        "High explainability instability detected"
    )
    status_text = (
        F.when(status == "green", "System stable")
        .when(status == "warning", "Moderate risk detected")
        .when(status == "critical", "High risk detected")
        .otherwise("Unknown")
    )

    def fixed(c: str, digits: int) -> Column:
        return F.format_string(f"%.{digits}f", F.col(c))

    seconds = F.format_string("%.4fs", F.col("avg_latency_ms") / 1000)
    lines = [
        ("Data Validation", "Schema Check", F.lit("0 Errors"), F.lit("All batches valid")),
        ("Batch Processing", "Batch Size", F.lit("50 rows"), F.lit("Stable aggregation")),
        ("Drift Detection", "PSI", fixed("avg_psi", 3), F.lit("Detects distribution shift")),
        ("Prediction Quality", "Gini", fixed("avg_gini", 3), F.lit("Stable predictions")),
        ("Explainability", "SHAP", fixed("avg_shap", 3), shap_text),
        ("Privacy", "Privacy Score", fixed("avg_privacy", 3), F.lit("Low leakage risk")),
        ("System Performance", "Latency", seconds, F.lit("Low latency")),
        ("Pipeline Health", "WDAG Status", status, status_text),
    ]
    cells = [
        F.struct(F.lit(i).alias("line"), F.lit(stage).alias("stage"), F.lit(metric).alias("metric"),
                 value.alias("value"), text.alias("text"))
        for i, (stage, metric, value, text) in enumerate(lines, 1)
    ]
    return summary.select(model, F.inline(F.array(*cells)))


def graph_health(status: DataFrame) -> DataFrame:
    """Mean status score of all nodes and node counts."""
    return status.agg(
        F.count(F.lit(1)).alias("nodes"), F.avg(status_score(F.col("status"))).alias("health")
    )


def latency_stats(
    df: DataFrame, latency: str, by: Sequence[str], limit_ms: float = LATENCY_LIMIT_MS
) -> DataFrame:
    """Mean and largest latency per batch, and how many records took longer than the limit."""
    ms = F.round(F.col(latency).cast("double"), 4)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        F.avg(ms).alias("latency_ms"),
        F.max(ms).alias("max_ms"),
        F.count_if(ms > limit_ms).alias("slow"),
    )


def latency_quantiles(
    df: DataFrame, latency: str, by: Sequence[str], points: Sequence[float] = (0.5, 0.95)
) -> DataFrame:
    """Approximate latency quantiles per batch."""
    marks = [
        F.percentile_approx(F.col(latency).cast("double"), p, 10_000).alias(f"p{round(p * 100)}")
        for p in points
    ]
    return df.groupBy(*by).agg(*marks)


def train_test_split(df: DataFrame, row_id: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Repeatable split: a row is 'test' if a hash of the seed and its id falls into that share.

    Rows of one id go together, wherever and however often they are read.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(row_id).cast("string")))
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    part = drawn < int(test_share * 2**32)
    return df.withColumn("split", F.when(part, "test").otherwise("train"))


def latency_sketches(df: DataFrame, latency: str, by: Sequence[str], name: str = "sketch") -> DataFrame:
    """A quantile sketch of the latencies per batch, to be stored beside its record."""
    return df.groupBy(*by).agg(
        F.count(latency).alias("records"), F.kll_sketch_agg_double(F.col(latency).cast("double")).alias(name)
    )


def quantiles_of_sketches(
    sketches: DataFrame, by: Sequence[str], points: Sequence[float] = (0.5, 0.95), name: str = "sketch"
) -> DataFrame:
    """Quantiles of all batches of a group from their sketches: (by, records, quantile, value)."""
    merged = sketches.groupBy(*by).agg(F.sum("records").alias("records"), F.kll_merge_agg_double(name).alias("_all"))
    cells = [
        F.struct(F.lit(p).alias("quantile"), F.kll_sketch_get_quantile_double("_all", F.lit(p)).alias("value"))
        for p in points
    ]
    return merged.select(*by, "records", F.inline(F.array(*cells)))
