"""Registered queries of baselines and vitals."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelpulse.functions.storage import scratch_path, settle
from modelpulse.operators import baseline as base
from modelpulse.operators import drift as dr
from modelpulse.operators import explain, fairness, privacy, profiles
from modelpulse.plans import monitor
from modelpulse.plans import sql as q
from modelpulse.plans.registry import query
from modelpulse.sources import tables as t
from modelpulse.sources.store import append_once, read_committed

BY = ["model_id", "batch"]
SHAP_SPEC = dataclasses.replace(t.EVENTS_SPEC, shap="shap")


def events_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(baseline rows, live rows) of the scored events."""
    scored = t.scored_events(spark, sf_dir)
    return t.baseline_rows(scored), t.live_rows(scored)


def lineitem_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scored = t.scored_lineitem(spark, sf_dir)
    start = t.LINEITEM_LIVE_FROM
    return t.baseline_rows(scored, start), t.live_rows(scored, start)


def shap_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before, live = events_split(spark, sf_dir)
    return before, t.with_shap(live, before, SHAP_SPEC)


def drift_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, live = events_split(spark, sf_dir)
    spec = t.EVENTS_SPEC
    profile = dr.baseline_profile(before, spec.numerical, row_id=spec.row_id)
    return dr.drift_by_feature(live, profile, spec.numerical, BY, row_id=spec.row_id)


# --- baselines ----------------------------------------------------------------------------


@query("baseline_pred_stats", f"""WITH {q.EVENTS}
SELECT model_id, 'gini' AS metric, round(avg(prediction), 6) AS mean,
       round(stddev_pop(prediction), 6) AS std FROM ba GROUP BY 1""")
def baseline_pred_stats(spark, sf_dir):
    return base.baseline_pred_stats(events_split(spark, sf_dir)[0], t.EVENTS_SPEC)


@query("baseline_profile", f"""WITH {q.EVENTS}, {q.profile(q.EVENT_FEATURES)}
SELECT model_id, feature, st.n, round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS lo,
       round(hi, 6) AS hi, i AS bin, round(p, 6) AS p
FROM st JOIN pb USING (model_id, feature)""")
def baseline_profile(spark, sf_dir):
    profile = dr.baseline_profile(events_split(spark, sf_dir)[0], ["value", "k"])
    return profile.selectExpr(
        "model_id", "feature", "n", "mean", "std", "lo", "hi",
        "posexplode(p) as (bin, p)").withColumn("bin", F.col("bin").cast("bigint"))


@query("baseline_profile_merged", f"""WITH {q.EVENTS}, {q.profile(q.EVENT_FEATURES)}
SELECT model_id, feature, st.n, round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS lo,
       round(hi, 6) AS hi, i AS bin, CASE WHEN feature = 'k' THEN round(p, 6) END AS p
FROM st JOIN pb USING (model_id, feature)""")
def baseline_profile_merged(spark, sf_dir):
    """The profile of ten days from cells per day that two runs stored, the second of them twice.

    Whole numbers below 100 have a cell each, so the shares of `k` are exact; those of `value` have a
    slack and are left out here.
    """
    before = events_split(spark, sf_dir)[0]
    path = scratch_path(spark, "profile-cells")
    for run, days in (("early", "day(batch) <= 5"), ("rest", "day(batch) > 5"), ("rest", "day(batch) > 5")):
        cells = profiles.profile_cells(before.where(days), q.EVENT_FEATURES, ["model_id", "batch"])
        append_once(cells, path, run, time="batch")
    profile = profiles.profile_from_cells(read_committed(spark, path))
    binned = profile.selectExpr(
        "model_id", "feature", "n", "mean", "std", "lo", "hi", "posexplode(p) as (bin, p)")
    exact = F.expr("if(feature = 'k', p, null)")
    return binned.withColumn("bin", F.col("bin").cast("bigint")).withColumn("p", exact)


@query("baseline_defaults", f"""WITH {q.EVENTS}, {q.SUMMARY}
SELECT * FROM bs WHERE metric NOT IN ('gini', 'statistical_parity')""")
def baseline_defaults(spark, sf_dir):
    """The fixed expectations for every model seen in the baseline, fairness off."""
    models = events_split(spark, sf_dir)[0].select("model_id").distinct()
    return base.baseline_defaults(models, fairness=False)


@query("baseline_summary", f"""WITH {q.EVENTS}, {q.SUMMARY}
SELECT model_id, metric, round(mean, 6) AS mean, round(std, 6) AS std FROM bs""")
def baseline_summary(spark, sf_dir):
    return base.baseline_summary(events_split(spark, sf_dir)[0], t.EVENTS_SPEC)


@query("baseline_check", f"""WITH {q.EVENTS}, {q.SUMMARY},
rq AS (SELECT model_id, metric FROM (SELECT DISTINCT model_id FROM ba),
  (VALUES ('gini'), ('psi'), ('linf'), ('ood_score'), ('privacy_score'), ('shap_importance'),
          ('statistical_parity')) m(metric)),
br AS (SELECT model_id, metric,
         CASE WHEN model_id = 'm1' AND metric = 'psi' THEN 'high' ELSE CAST(mean AS VARCHAR) END
           AS mean,
         CASE WHEN model_id = 'm2' AND metric = 'gini' THEN CAST(-std AS VARCHAR)
              WHEN model_id = 'm3' AND metric = 'ood_score' THEN NULL
              ELSE CAST(std AS VARCHAR) END AS std
       FROM bs WHERE NOT (model_id = 'm0' AND metric = 'linf'))
SELECT rq.model_id, rq.metric, CASE
    WHEN br.metric IS NULL THEN 'missing metric'
    WHEN mean IS NULL OR std IS NULL THEN 'missing mean or std'
    WHEN try_cast(mean AS DOUBLE) IS NULL THEN 'mean not numeric'
    WHEN try_cast(std AS DOUBLE) IS NULL THEN 'std not numeric'
    WHEN try_cast(std AS DOUBLE) < 0 THEN 'negative std' END AS problem
FROM rq LEFT JOIN br USING (model_id, metric)
WHERE problem IS NOT NULL""")
def baseline_check(spark, sf_dir):
    """The summary of the events with one flaw per model, found again."""
    before = events_split(spark, sf_dir)[0]
    summary = base.baseline_summary(before, t.EVENTS_SPEC)
    flawed = summary.where("not (model_id = 'm0' and metric = 'linf')").selectExpr(
        "model_id",
        "metric",
        "if(model_id = 'm1' and metric = 'psi', 'high', cast(mean as string)) as mean",
        """case when model_id = 'm2' and metric = 'gini' then cast(-std as string)
                when model_id = 'm3' and metric = 'ood_score' then null
                else cast(std as string) end as std""",
    )
    return base.check_baseline(flawed, before.select("model_id"), fairness=True)


# --- fairness -----------------------------------------------------------------------------


@query("parity_categorical", f"""WITH {q.EVENTS}, {q.parity("event_type")}
SELECT model_id, batch, round(statistical_parity, 6) AS statistical_parity FROM pa""")
def parity_categorical(spark, sf_dir):
    return fairness.statistical_parity(events_split(spark, sf_dir)[1], t.EVENTS_SPEC)


@query("parity_one_hot", """
WITH d AS (SELECT source, quality, toxic, lang FROM labels JOIN documents USING (doc_id)),
m AS (SELECT source, toxic, lang, avg(quality) AS m FROM d
      WHERE lang IN ('en', 'fr', 'de', 'es') GROUP BY 1, 2, 3)
SELECT source, toxic, CASE WHEN count(m) < 2 THEN 0.0 ELSE round(max(m) - min(m), 6) END
       AS statistical_parity
FROM (SELECT DISTINCT source, toxic FROM d) LEFT JOIN m USING (source, toxic) GROUP BY 1, 2""")
def parity_one_hot(spark, sf_dir):
    spec = dataclasses.replace(t.DOCS_SPEC, keys=("source", "toxic"))
    return fairness.statistical_parity(t.labelled_docs(spark, sf_dir), spec)


@query("parity_lineitem", f"""WITH {q.LINEITEM}, {q.parity("l_returnflag")}
SELECT model_id, batch, round(statistical_parity, 6) AS statistical_parity FROM pa""")
def parity_lineitem(spark, sf_dir):
    return fairness.statistical_parity(lineitem_split(spark, sf_dir)[1], t.LINEITEM_SPEC)


@query("gini", f"""WITH {q.EVENTS}, {q.GINI}
SELECT model_id, batch, round(gini, 6) AS gini FROM gn""")
def gini(spark, sf_dir):
    return fairness.gini(events_split(spark, sf_dir)[1], "prediction", BY)


@query("gini_whole_table", """
SELECT l_linestatus AS model_id, round(sum((2 * rn - n - 1) * l_extendedprice)
       / (any_value(n) * sum(l_extendedprice)), 6) AS gini
FROM (SELECT l_linestatus, l_extendedprice,
             row_number() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) AS rn,
             count(*) OVER (PARTITION BY l_linestatus) AS n FROM lineitem)
GROUP BY 1""")
def gini_whole_table(spark, sf_dir):
    """One batch as large as the table: nearly every value is distinct and in the same group."""
    items = t.table(spark, sf_dir, "lineitem").withColumnRenamed("l_linestatus", "model_id")
    return fairness.gini(items, "l_extendedprice", ["model_id"])


@query("gini_multiclass", """
SELECT label, round(sum((2 * rn - n - 1) * x) / (any_value(n) * sum(x)), 6) AS gini
FROM (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY x) AS rn,
             count(*) OVER (PARTITION BY label) AS n
      FROM (SELECT label, CAST(list_max(embedding) AS DOUBLE) AS x FROM embeddings))
GROUP BY 1""")
def gini_multiclass(spark, sf_dir):
    return fairness.gini(t.prob_vectors(spark, sf_dir), "embedding", ["label"])


@query("minmax_normalize", f"""WITH {q.EVENTS}
SELECT event_id, model_id, round((prediction - lo) / (hi - lo), 6) AS scaled
FROM se JOIN (SELECT model_id, min(prediction) AS lo, max(prediction) AS hi FROM se GROUP BY 1)
     USING (model_id)""")
def minmax_normalize(spark, sf_dir):
    scored = t.scored_events(spark, sf_dir).select("event_id", "model_id", "prediction")
    return fairness.minmax_normalize(
        scored, "prediction", ["model_id"], "scaled", ["event_id"]
    ).drop("prediction")


# --- privacy ------------------------------------------------------------------------------


@query("privacy_score", f"""WITH {q.EVENTS}, {q.privacy("user_id, event_type")}
SELECT model_id, batch, round(privacy_score, 6) AS privacy_score FROM pv""")
def privacy_score(spark, sf_dir):
    return privacy.privacy_score(events_split(spark, sf_dir)[1], t.EVENTS_SPEC.quasi, BY)


@query("privacy_lineitem", f"""WITH {q.LINEITEM}, {q.privacy("l_suppkey, l_quantity")}
SELECT model_id, batch, round(privacy_score, 6) AS privacy_score FROM pv""")
def privacy_lineitem(spark, sf_dir):
    return privacy.privacy_score(lineitem_split(spark, sf_dir)[1], t.LINEITEM_SPEC.quasi, BY)


# --- drift and security -------------------------------------------------------------------

_DRIFT = f"WITH {q.EVENTS}, {q.drift(q.EVENT_FEATURES)}"


@query("psi_by_feature", f"""{_DRIFT}
SELECT model_id, batch, feature, n, round(psi, 6) AS psi FROM fe""")
def psi_by_feature(spark, sf_dir):
    return drift_rows(spark, sf_dir).select(*BY, "feature", "n", "psi")


@query("psi", f"""{_DRIFT}
SELECT model_id, batch, round(least(avg(psi), 1.0), 6) AS psi FROM fe GROUP BY 1, 2""")
def psi(spark, sf_dir):
    return dr.drift_metrics(drift_rows(spark, sf_dir), BY).select(*BY, "psi")


@query("linf", f"""{_DRIFT}
SELECT model_id, batch, round(avg(linf), 6) AS linf FROM fe GROUP BY 1, 2""")
def linf(spark, sf_dir):
    return dr.drift_metrics(drift_rows(spark, sf_dir), BY).select(*BY, "linf")


@query("ood_score", f"""{_DRIFT}
SELECT model_id, batch, round(avg(ood), 6) AS ood_score FROM fe GROUP BY 1, 2""")
def ood_score(spark, sf_dir):
    return dr.drift_metrics(drift_rows(spark, sf_dir), BY).select(*BY, "ood_score")


@query("ood_band", f"""WITH {q.EVENTS}, {q.profile(q.EVENT_FEATURES)},
lf AS ({q._melt("li", q.EVENT_FEATURES, "model_id, batch")})
SELECT model_id, batch, feature, round(count(*) FILTER (
         std <> 0 AND (x < mean - 1.5 * std OR x > mean + 1.5 * std)) / count(*), 6) AS ood_band
FROM lf JOIN st USING (model_id, feature) GROUP BY 1, 2, 3""")
def ood_band(spark, sf_dir):
    """Share of rows outside 1.5 deviations."""
    before, live = events_split(spark, sf_dir)
    profile = dr.baseline_profile(before, t.EVENTS_SPEC.numerical)
    rows = dr.drift_by_feature(live, profile, t.EVENTS_SPEC.numerical, BY, threshold=1.5)
    return rows.select(*BY, "feature", "ood_band")


@query("security_combined", f"""{_DRIFT}
SELECT model_id, batch, feature, round(linf, 6) AS linf, round(ood_band, 6) AS ood_score FROM fe""")
def security_combined(spark, sf_dir):
    return dr.security(drift_rows(spark, sf_dir), BY).select(*BY, "feature", "security.*")


_ITEM_FEATURES = list(t.LINEITEM_SPEC.numerical)


@query("drift_lineitem", f"""WITH {q.LINEITEM}, {q.drift(_ITEM_FEATURES)}
SELECT model_id, batch, round(least(avg(psi), 1.0), 6) AS psi, round(avg(linf), 6) AS linf,
       round(avg(ood), 6) AS ood_score FROM fe GROUP BY 1, 2""")
def drift_lineitem(spark, sf_dir):
    before, live = lineitem_split(spark, sf_dir)
    profile = dr.baseline_profile(before, _ITEM_FEATURES, row_id=t.LINEITEM_SPEC.row_id)
    return dr.drift(live, profile, t.LINEITEM_SPEC)


# --- transparency -------------------------------------------------------------------------


@query("shap_score", f"""WITH {q.EVENTS}, {q.SHAP}
SELECT model_id, batch, round(shap_importance, 6) AS shap_importance FROM sp""")
def shap_score(spark, sf_dir):
    return explain.shap_score(shap_split(spark, sf_dir)[1], "shap", BY)


@query("shap_score_matrix", """
WITH c AS (SELECT label, vec_id, abs(CAST(unnest(embedding) AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT label, v, sum(v) OVER w AS t, max(v) OVER w AS mx, count(*) OVER w AS cells
      FROM c WINDOW w AS (PARTITION BY label)),
r AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label, round(any_value(t) / any_value(cells) / (any_value(mx) + 1e-6)
       * (-sum(v / t * ln(v / t + 1e-9))) / ln(any_value(n) + 1e-9), 6) AS shap_importance
FROM s JOIN r USING (label) GROUP BY 1""")
def shap_score_matrix(spark, sf_dir):
    return explain.shap_score(t.prob_vectors(spark, sf_dir), "embedding", ["label"])


@query("shap_default", f"""WITH {q.EVENTS}
SELECT DISTINCT model_id, batch, 'shap_importance' AS metric, 0.0::DOUBLE AS value FROM li""")
def shap_default(spark, sf_dir):
    """Vitals of a model that sends no attributions: the score is 0, not absent."""
    before, live = events_split(spark, sf_dir)
    profile = dr.baseline_profile(before, t.EVENTS_SPEC.numerical)
    metrics = monitor.vitals_metrics(live, profile, t.EVENTS_SPEC)
    return metrics.where("metric = 'shap_importance'")


@query("feature_importance_topk", """
WITH c AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS feature
           FROM embeddings),
m AS (SELECT label, feature, avg(abs(CAST(v AS DOUBLE))) AS mean_abs FROM c GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean_abs DESC, feature) AS rank
      FROM m)
SELECT label, CAST(rank AS INTEGER) AS rank, CAST(feature AS INTEGER) AS feature,
       round(mean_abs, 6) AS mean_abs,
       round(mean_abs / sum(mean_abs) OVER (PARTITION BY label), 6) AS weight
FROM k WHERE rank <= 5""")
def feature_importance_topk(spark, sf_dir):
    return explain.feature_importance_topk(t.prob_vectors(spark, sf_dir), "embedding", ["label"])


@query("vitals_metrics", f"""WITH {q.METRICS}
SELECT model_id, batch, metric, round(value, 6) AS value FROM mt""")
def vitals_metrics(spark, sf_dir):
    before, live = shap_split(spark, sf_dir)
    profile = dr.baseline_profile(before, SHAP_SPEC.numerical, row_id=SHAP_SPEC.row_id)
    return monitor.vitals_metrics(live, profile, SHAP_SPEC)


def graded_events(spark: SparkSession, sf_dir: str, directions=None) -> DataFrame:
    """All seven vitals of the live events, graded with history."""
    before, live = shap_split(spark, sf_dir)
    profile = dr.baseline_profile(before, SHAP_SPEC.numerical, row_id=SHAP_SPEC.row_id)
    summary = settle(base.baseline_summary(before, SHAP_SPEC))
    return monitor.vitals(live, summary, profile, SHAP_SPEC)


def short_metrics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(summary, metrics) with the three vitals that need no profile."""
    before, live = events_split(spark, sf_dir)
    spec = t.EVENTS_SPEC
    parts = [
        fairness.gini(live, spec.prediction, BY).selectExpr(*BY, "'gini' metric", "gini value"),
        privacy.privacy_score(live, spec.quasi, BY).selectExpr(
            *BY, "'privacy_score' metric", "privacy_score value"
        ),
        fairness.statistical_parity(live, spec).selectExpr(
            *BY, "'statistical_parity' metric", "statistical_parity value"
        ),
    ]
    metrics = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return settle(base.baseline_summary(before, spec)), metrics
