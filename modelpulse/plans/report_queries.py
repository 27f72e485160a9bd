"""Registered queries of records, summaries and the vitals table."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelpulse.functions.storage import scratch_path, settle
from modelpulse.operators import graph, reporting
from modelpulse.plans import monitor
from modelpulse.plans import sql as q
from modelpulse.plans.registry import query
from modelpulse.plans.vital_queries import BY, SHAP_SPEC, shap_split
from modelpulse.sources import store
from modelpulse.sources import tables as t

_SCORES = """round(fairness, 6) AS fairness, round(stability, 6) AS stability,
       round(security, 6) AS security, round(privacy, 6) AS privacy,
       round(transparency, 6) AS transparency, status"""


def monitored_events(spark, sf_dir) -> monitor.Run:
    before, live = shap_split(spark, sf_dir)
    return monitor.run_batches(live, before, SHAP_SPEC)


@query("vitals_record", f"""WITH {q.RECORD}
SELECT model_id, batch, {_SCORES} FROM vr""")
def vitals_record(spark, sf_dir):
    """From raw events to one graded composite row per model and day."""
    return monitored_events(spark, sf_dir).records


# The stage graph of a service, as a deployment declares it (names only).
STAGES = [("Event_Intake", "ingest"), ("Feature_Join", "features"),
          ("Scoring_Service", "serving"), ("Report_Archive", "archive")]
LINKS = [("Event_Intake", "Feature_Join", 1.0), ("Feature_Join", "Scoring_Service", 0.9),
         ("Scoring_Service", "Report_Archive", 0.3)]


@query("vitals_record_trace", f"""WITH {q.RECORD},
ls AS (SELECT *, lag(req) OVER (PARTITION BY model_id ORDER BY batch) AS was,
              bool_or(req = 'critical') OVER (PARTITION BY model_id ORDER BY batch) AS struck
       FROM rq)
SELECT model_id, batch, vr.status,
  CASE WHEN req = 'green' AND was = 'critical' THEN 'critical' ELSE req END AS event_intake,
  CASE WHEN struck THEN 'critical' ELSE 'green' END AS feature_join,
  CASE WHEN struck THEN 'critical' ELSE 'green' END AS scoring_service,
  'green' AS report_archive
FROM ls JOIN vr USING (model_id, batch)""")
def vitals_record_trace(spark, sf_dir):
    """Records with the stage graph after each batch; shown are the states parsed back from
    the trace document."""
    run = monitored_events(spark, sf_dir)
    nodes = spark.createDataFrame(STAGES, "node string, owner string")
    edges = spark.createDataFrame(LINKS, "src string, dst string, weight double")
    traced = monitor.record_with_trace(run, SHAP_SPEC, nodes, edges, "Event_Intake")
    states = [
        F.get_json_object("wdag_trace", f"$.{n}.status").alias(n.lower()) for n, _ in STAGES
    ]
    return traced.select(*BY, "status", *states)


@query("vitals_percent", f"""WITH {q.RECORD}
SELECT model_id, batch, round(fairness * 100, 1) AS fairness, round(stability * 100, 1) AS stability,
       round(security * 100, 1) AS security, round(privacy * 100, 1) AS privacy,
       round(transparency * 100, 1) AS transparency, status FROM vr""")
def vitals_percent(spark, sf_dir):
    return reporting.vitals_percent(monitored_events(spark, sf_dir).records)


def _stored(spark, sf_dir):
    """Records appended to a vitals table in the shared folder, in two appends."""
    path = scratch_path(spark, "vitals")
    records = settle(monitored_events(spark, sf_dir).records)
    timed = records.withColumn("time", F.col("batch").cast("timestamp_ntz"))
    store.append_vitals(timed.where("batch < date'2024-01-20'"), path)
    store.append_vitals(timed.where("batch >= date'2024-01-20'"), path)
    return spark.read.parquet(path).drop("date")


@query("vitals_append", f"""WITH {q.RECORD}
SELECT model_id, batch, CAST(batch AS TIMESTAMP) AS time, {_SCORES} FROM vr""")
def vitals_append(spark, sf_dir):
    return _stored(spark, sf_dir)


@query("vitals_append_once", f"""WITH {q.RECORD}
SELECT model_id, batch, CAST(batch AS TIMESTAMP) AS time, {_SCORES} FROM vr""")
def vitals_append_once(spark, sf_dir):
    """Two runs, each of them done twice, taken into one; an aborted run leaves nothing."""
    path = scratch_path(spark, "vitals-once")
    timed = settle(monitored_events(spark, sf_dir).records).withColumn("time", F.col("batch").cast("timestamp_ntz"))
    for _ in range(2):
        store.append_once(timed.where("batch < date'2024-01-20'"), path, "first")
        store.append_once(timed.where("batch >= date'2024-01-20'"), path, "second")
    # Written, but never committed.
    timed.withColumn("date", F.col("batch")).write.partitionBy("date").parquet(f"{path}/data/run=aborted")
    store.compact(spark, path, "month")
    store.remove_replaced(spark, path)
    return store.read_committed(spark, path)


@query("vitals_latest", f"""WITH {q.RECORD}
SELECT model_id, batch, CAST(batch AS TIMESTAMP) AS time, {_SCORES}
FROM vr ORDER BY batch DESC, model_id DESC LIMIT 1""")
def vitals_latest(spark, sf_dir):
    return store.latest_vitals(_stored(spark, sf_dir))


@query("vitals_latest_no_data", f"""WITH {q.EVENTS}
SELECT max(model_id) AS model_id, max(ts) AS time, coalesce(max(event_type), 'no_data') AS status
FROM se WHERE ts > TIMESTAMP '2025-01-01'""")
def vitals_latest_no_data(spark, sf_dir):
    """Nothing was stored yet: one row that says so."""
    scored = t.scored_events(spark, sf_dir)
    none = scored.where(F.col("ts") > F.lit("2025-01-01").cast("timestamp_ntz")).select(
        "model_id", F.col("ts").alias("time"), F.col("event_type").alias("status")
    )
    return store.latest_vitals(none)


@query("vitals_latest_per_model", f"""WITH {q.RECORD}
SELECT model_id, batch, CAST(batch AS TIMESTAMP) AS time, {_SCORES}
FROM vr QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY batch DESC) = 1""")
def vitals_latest_per_model(spark, sf_dir):
    return store.latest_per_model(_stored(spark, sf_dir))


@query("psi_rolling15", f"""WITH {q.RECORD},
r AS (SELECT model_id, batch, round(1 - stability, 3) AS psi,
             row_number() OVER (PARTITION BY model_id ORDER BY batch DESC) AS rn FROM vr)
SELECT model_id, batch, psi,
       CAST(row_number() OVER (PARTITION BY model_id ORDER BY batch) AS INTEGER) AS point
FROM r WHERE rn <= 15""")
def psi_rolling15(spark, sf_dir):
    return reporting.psi_rolling(monitored_events(spark, sf_dir).records, "model_id", ["batch"])


_SUMMARY = f"""WITH {q.ACCEPTED},
lt AS (SELECT model_id, batch, avg(round(value, 4)) AS latency_ms FROM l0 GROUP BY 1, 2),
pb2 AS (SELECT rq.model_id, rq.batch,
    coalesce(max(value) FILTER (metric = 'gini'), 0) AS gini,
    coalesce(max(value) FILTER (metric = 'psi'), 0) AS psi,
    coalesce(max(value) FILTER (metric = 'privacy_score'), 0) AS privacy,
    coalesce(max(value) FILTER (metric = 'shap_importance'), 0) AS shap,
    any_value(latency_ms) AS latency_ms
  FROM rq LEFT JOIN ge USING (model_id, batch) JOIN lt USING (model_id, batch) GROUP BY 1, 2),
su AS (SELECT model_id, count(*) AS batches, avg(gini) AS avg_gini, avg(psi) AS avg_psi,
              avg(privacy) AS avg_privacy, avg(shap) AS avg_shap, avg(latency_ms) AS avg_latency_ms
       FROM pb2 GROUP BY 1)"""


def _summary(spark, sf_dir):
    before, live = shap_split(spark, sf_dir)
    run = monitor.run_batches(live, before, SHAP_SPEC)
    latency = reporting.latency_stats(live, "value", BY)
    return run, reporting.vitals_summary(run.evaluated, BY, latency, run.requests)


@query("vitals_summary", f"""{_SUMMARY}
SELECT model_id, batches, round(avg_gini, 6) AS avg_gini, round(avg_psi, 6) AS avg_psi,
       round(avg_privacy, 6) AS avg_privacy, round(avg_shap, 6) AS avg_shap,
       round(avg_latency_ms, 6) AS avg_latency_ms FROM su""")
def vitals_summary(spark, sf_dir):
    return _summary(spark, sf_dir)[1]


@query("summary_interpretation", f"""{_SUMMARY},
lo AS (SELECT model_id, req, lag(req) OVER (PARTITION BY model_id ORDER BY batch) AS was,
              row_number() OVER (PARTITION BY model_id ORDER BY batch DESC) AS rn FROM rq),
nw AS (SELECT model_id, CASE WHEN req = 'green' AND was = 'critical' THEN 'critical' ELSE req END
              AS state FROM lo WHERE rn = 1),
x AS (SELECT * FROM su JOIN nw USING (model_id))
SELECT model_id, 1::INTEGER AS line, 'Data Validation' AS stage, 'Schema Check' AS metric,
       '0 Errors' AS value, 'All batches valid' AS text FROM x
UNION ALL SELECT model_id, 2, 'Batch Processing', 'Batch Size', '50 rows', 'Stable aggregation' FROM x
UNION ALL SELECT model_id, 3, 'Drift Detection', 'PSI', printf('%.3f', avg_psi),
       'Detects distribution shift' FROM x
UNION ALL SELECT model_id, 4, 'Prediction Quality', 'Gini', printf('%.3f', avg_gini),
       'Stable predictions' FROM x
UNION ALL SELECT model_id, 5, 'Explainability', 'SHAP', printf('%.3f', avg_shap),
       CASE WHEN avg_shap < 1 THEN 'Feature importance stable'
            ELSE 'High explainability instability detected' END FROM x
UNION ALL SELECT model_id, 6, 'Privacy', 'Privacy Score', printf('%.3f', avg_privacy),
       'Low leakage risk' FROM x
UNION ALL SELECT model_id, 7, 'System Performance', 'Latency',
       printf('%.4fs', avg_latency_ms / 1000), 'Low latency' FROM x
UNION ALL SELECT model_id, 8, 'Pipeline Health', 'WDAG Status', state,
       CASE state WHEN 'green' THEN 'System stable' WHEN 'warning' THEN 'Moderate risk detected'
            WHEN 'critical' THEN 'High risk detected' ELSE 'Unknown' END FROM x""")
def summary_interpretation(spark, sf_dir):
    run, summary = _summary(spark, sf_dir)
    states = graph.current_status(run.requests, ["seq"])
    joined = summary.join(states.withColumnRenamed("node", "model_id"), "model_id", "left")
    return reporting.summary_interpretation(joined, F.col("status"))


@query("latency_stats", f"""WITH {q.EVENTS}
SELECT model_id, batch, count(*) AS records, round(avg(round(value, 4)), 6) AS latency_ms,
       round(max(round(value, 4)), 6) AS max_ms, count(*) FILTER (round(value, 4) > 60) AS slow
FROM se GROUP BY 1, 2""")
def latency_stats(spark, sf_dir):
    """Event values as latencies, with a limit of 60 ms."""
    return reporting.latency_stats(t.scored_events(spark, sf_dir), "value", BY, 60.0)


@query("latency_quantiles", f"""WITH {q.EVENTS}
SELECT model_id, count(*) AS records, unnest([0.5::DOUBLE, 0.95]) AS quantile, true AS near FROM se GROUP BY model_id""")
def latency_quantiles(spark, sf_dir):
    """Median and 95 % point of a model from the sketches of its days, held against the exact ranks:
    the share of latencies up to the value found is within 2 % of the one asked for."""
    rows = t.scored_events(spark, sf_dir)
    found = settle(reporting.quantiles_of_sketches(reporting.latency_sketches(rows, "value", BY), ["model_id"]))
    ranked = rows.select("model_id", F.col("value").alias("x")).join(F.broadcast(found), "model_id")
    share = F.avg((F.col("x") <= F.col("value")).cast("double"))
    ranks = ranked.groupBy("model_id", "records", "quantile").agg(share.alias("share"))
    return ranks.select("model_id", "records", "quantile", (F.abs(F.col("share") - F.col("quantile")) < 0.02).alias("near"))


@query("train_test_split", f"""WITH {q.EVENTS},
sp AS (SELECT *, CASE WHEN CAST('0x' || substr(md5('42:' || event_id), 1, 8) AS BIGINT) < 858993459 THEN 'test'
                      ELSE 'train' END AS split FROM se)
SELECT model_id, split, count(*) AS rows, round(avg(prediction), 6) AS mean FROM sp GROUP BY 1, 2""")
def train_test_split(spark, sf_dir):
    split = reporting.train_test_split(t.scored_events(spark, sf_dir), "event_id")
    return split.groupBy("model_id", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("prediction").alias("mean")
    )
