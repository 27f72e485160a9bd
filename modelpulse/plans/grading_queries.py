"""Registered queries of grading and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelpulse.functions.storage import scratch_path, settle_rows
from modelpulse.operators import grading
from modelpulse.plans import sql as q
from modelpulse.plans.registry import query
from modelpulse.plans.vital_queries import BY, events_split, graded_events, short_metrics
from modelpulse.sources.store import append_vitals
from modelpulse.spec import DIRECTIONS

SERIES = ["model_id", "metric"]
_SHORT = f"WITH {q.SHORT_METRICS}, {q.SUMMARY}"


@query("grade_join", f"""{_SHORT},
bj AS (SELECT * FROM bs WHERE NOT (metric = 'privacy_score' AND model_id IN ('m1', 'm2'))),
{q.raw_grade(summary="bj")}
SELECT model_id, batch, metric, round(value, 6) AS value, round(mean, 6) AS mean,
       round(std, 6) AS std, raw FROM gr""")
def grade_join(spark, sf_dir):
    """Two models have no baseline for one metric; its value stays, ungraded."""
    summary, metrics = short_metrics(spark, sf_dir)
    partial = summary.where("not (metric = 'privacy_score' and model_id in ('m1', 'm2'))")
    return grading.grade_raw(metrics, partial).select(*BY, "metric", "value", "mean", "std", "raw")


@query("grade_raw", f"""{_SHORT}, {q.raw_grade("'finance'")}
SELECT model_id, batch, metric, round(value, 6) AS value, raw FROM gr""")
def grade_raw(spark, sf_dir):
    summary, metrics = short_metrics(spark, sf_dir)
    return grading.grade_raw(metrics, summary, "finance").select(*BY, "metric", "value", "raw")


_DOMAIN_SQL = """CASE mt.model_id WHEN 'm0' THEN 'healthcare' WHEN 'm1' THEN 'finance'
                 WHEN 'm2' THEN 'standard' ELSE 'retail' END"""


@query("grade_domain", f"""{_SHORT}, {q.raw_grade(_DOMAIN_SQL)}
SELECT model_id, batch, metric, domain, k, raw,
       CASE WHEN raw IS NULL THEN 'Unsupported domain: ' || domain END AS message FROM gr""")
def grade_domain(spark, sf_dir):
    """A domain per model, one of them unknown: its values become errors."""
    summary, metrics = short_metrics(spark, sf_dir)
    domain = F.expr(
        "case model_id when 'm0' then 'healthcare' when 'm1' then 'finance'"
        " when 'm2' then 'standard' else 'retail' end"
    )
    graded = grading.grade_raw(metrics, summary, domain)
    columns = [*BY, "metric", "domain", "k", "raw"]
    good = graded.where("raw is not null").select(*columns, F.lit(None).cast("string").alias("message"))
    return good.unionByName(grading.grading_errors(graded).select(*columns, "message"))


@query("grade_zero_std", f"""{_SHORT},
bz AS (SELECT model_id, metric, mean, CASE WHEN metric = 'gini' THEN 0 ELSE std END AS std FROM bs),
{q.raw_grade("'healthcare'", summary="bz")}
SELECT model_id, batch, metric, round(std, 6) AS std, raw FROM gr""")
def grade_zero_std(spark, sf_dir):
    summary, metrics = short_metrics(spark, sf_dir)
    flat = summary.withColumn("std", F.expr("if(metric = 'gini', 0D, std)"))
    return grading.grade_raw(metrics, flat, "healthcare").select(*BY, "metric", "std", "raw")


@query("grade_direction", f"""{_SHORT},
{q.raw_grade("'healthcare'", "CASE mt.metric WHEN 'gini' THEN 'lower' WHEN 'privacy_score' THEN 'sideways' ELSE 'upper' END")}
SELECT model_id, batch, metric, direction, raw FROM gr""")
def grade_direction(spark, sf_dir):
    """Directions of one's own: one lower, one invalid, the metric not named alarms above."""
    summary, metrics = short_metrics(spark, sf_dir)
    own = {"gini": "lower", "privacy_score": "sideways"}
    graded = grading.grade_raw(metrics, summary, "healthcare", own)
    return graded.select(*BY, "metric", "direction", "raw")


@query("grade_two_sided", f"""{_SHORT}, {q.raw_grade("'healthcare'", "'two-sided'")}
SELECT model_id, batch, metric, raw FROM gr""")
def grade_two_sided(spark, sf_dir):
    summary, metrics = short_metrics(spark, sf_dir)
    both = {m: "two-sided" for m in DIRECTIONS}
    return grading.grade_raw(metrics, summary, "healthcare", both).select(*BY, "metric", "raw")


@query("grade_persistence", f"""WITH {q.GRADED}
SELECT model_id, batch, metric, round(value, 6) AS value, raw, status FROM ge""")
def grade_persistence(spark, sf_dir):
    """All vitals with the persistence rule of their domain."""
    return graded_events(spark, sf_dir).select(*BY, "metric", "value", "raw", "status")


@query("grade_persistence_domains", f"""{_SHORT}, {q.raw_grade(_DOMAIN_SQL.replace("retail", "finance"), "'two-sided'")},
{q.persisted()}
SELECT model_id, batch, metric, domain, raw, status FROM ge""")
def grade_persistence_domains(spark, sf_dir):
    """Three persistence depths side by side."""
    summary, metrics = short_metrics(spark, sf_dir)
    domain = F.expr(
        "case model_id when 'm0' then 'healthcare' when 'm1' then 'finance'"
        " when 'm2' then 'standard' else 'finance' end"
    )
    both = {m: "two-sided" for m in DIRECTIONS}
    graded = grading.grade(metrics, summary, domain, BY, both)
    return graded.select(*BY, "metric", "domain", "raw", "status")


_EVERY_DOMAIN = (
    "case model_id when 'm0' then 'healthcare' when 'm1' then 'finance'"
    " when 'm2' then 'standard' else 'finance' end"
)


@query("grade_late", f"""{_SHORT}, {q.raw_grade(_DOMAIN_SQL.replace("retail", "finance"), "'two-sided'")},
{q.persisted()},
lt AS (SELECT *, day(batch) % 5 = 2 AND metric <> 'gini' OR day(batch) = 19 AS late FROM ge)
SELECT model_id, batch, metric, raw, status, late,
       max(late::INT) OVER (PARTITION BY model_id, metric ORDER BY batch ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 1
         AS judged FROM lt""")
def grade_late(spark, sf_dir):
    """Batches that come when later ones are graded: they and the three after each are judged anew."""
    summary, metrics = short_metrics(spark, sf_dir)
    raw = settle_rows(grading.grade_raw(metrics, summary, F.expr(_EVERY_DOMAIN), {m: "two-sided" for m in DIRECTIONS}))
    late = F.expr("day(batch) % 5 = 2 and metric <> 'gini' or day(batch) = 19")
    stored = settle_rows(grading.persist_filter(raw.where(~late), SERIES, ["batch"]))
    again = settle_rows(grading.regrade_late(stored, raw.where(late), SERIES, ["batch"]))
    both = grading.with_regraded(
        stored.withColumn("late", F.lit(False)).withColumn("judged", F.lit(False)),
        again.withColumn("judged", F.lit(True)), SERIES, ["batch"],
    )
    return both.select(*BY, "metric", "raw", "status", "late", "judged")


@query("overall_status", f"""WITH {q.GRADED}
SELECT model_id, batch, status FROM ov""")
def overall_status(spark, sf_dir):
    return grading.overall_status(graded_events(spark, sf_dir), BY)


_FINANCE = f"""{_SHORT}, {q.raw_grade("'finance'")}, {q.persisted()}"""


def _finance(spark, sf_dir):
    summary, metrics = short_metrics(spark, sf_dir)
    return grading.grade(metrics, summary, "finance", BY)


@query("status_history", f"""{_FINANCE}
SELECT model_id, batch, metric, status, array_to_string(list(status) OVER (
         PARTITION BY model_id, metric ORDER BY batch
         ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS history
FROM ge WHERE status <> 'no_baseline'""")
def status_history(spark, sf_dir):
    listed = grading.status_history(_finance(spark, sf_dir), SERIES, ["batch"])
    return listed.select(*BY, "metric", "status", F.array_join("history", ",").alias("history"))


@query("status_append", f"""{_FINANCE}
SELECT model_id, batch, metric, round(value, 6) AS value, status FROM ge""")
def status_append(spark, sf_dir):
    """Graded statuses appended to a table and read back."""
    path = scratch_path(spark, "evaluated")
    graded = _finance(spark, sf_dir).withColumn("time", F.col("batch").cast("timestamp"))
    append_vitals(graded, path)
    return spark.read.parquet(path).select(*BY, "metric", "value", "status")


@query("history_reset", f"""{_SHORT}, {q.raw_grade("'finance'")},
rs AS (SELECT DISTINCT model_id, batch FROM li WHERE day(batch) % 7 = 0),
gx AS (SELECT gr.*, (SELECT count(*) FROM rs
                     WHERE rs.model_id = gr.model_id AND rs.batch <= gr.batch) AS epoch FROM gr),
g2 AS (SELECT * FROM gx),
gf AS (SELECT *, coalesce(count(*) FILTER (raw IN ('warning', 'critical')) OVER (
              PARTITION BY model_id, metric, epoch ORDER BY batch
              ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS f1 FROM g2)
SELECT model_id, batch, metric, epoch, raw, CASE
    WHEN raw NOT IN ('warning', 'critical') THEN raw
    WHEN value > mean + k * 3 * std THEN 'critical'
    WHEN f1 < 1 THEN 'warning' ELSE 'critical' END AS status FROM gf""")
def history_reset(spark, sf_dir):
    """The history of a model is cleared before each batch on a day divisible by seven."""
    summary, metrics = short_metrics(spark, sf_dir)
    graded = grading.grade_raw(metrics, summary, "finance")
    live = events_split(spark, sf_dir)[1]
    resets = live.where("day(batch) % 7 = 0").select(*BY).distinct()
    marked = grading.reset_epochs(graded, resets, ["model_id"], "batch")
    final = grading.persist_filter(marked, SERIES, ["batch"], epoch="epoch")
    return final.select(*BY, "metric", "epoch", "raw", "status")
