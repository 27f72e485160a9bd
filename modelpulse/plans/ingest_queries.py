"""Registered queries of sources, batch formation and validation."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelpulse.functions.storage import scratch_path, settle, settle_rows
from modelpulse.operators import batching, validation
from modelpulse.operators.drift import baseline_profile
from modelpulse.plans import monitor
from modelpulse.plans import sql as q
from modelpulse.plans.registry import query
from modelpulse.sources import intake
from modelpulse.sources import tables as t
from modelpulse.sources import telemetry as tel
from modelpulse.spec import Protected
from modelpulse.streaming.batches import Gathering, stream_batches

MODEL = ["model_id"]
WAIT = 6 * 3600


@query("scored_source", f"""WITH {q.EVENTS}
SELECT event_id, ts, model_id, batch, round(value, 6) AS value, round(k, 6) AS k, event_type,
       round(prediction, 6) AS prediction, user_id FROM li""")
def scored_source(spark, sf_dir):
    live = t.live_rows(t.scored_events(spark, sf_dir))
    return t.scored_source(live, t.EVENTS_SPEC)


# --- telemetry ----------------------------------------------------------------------------

_PACKED = """ev AS (
  SELECT user_id, event_id, 'm' || (user_id % 4) AS model_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0')
           || 'Z' AS stamp, round(value, 4) AS latency, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
pk AS (SELECT user_id, pos // 50 AS batch_no, user_id || '-' || (pos // 50) AS batch_id,
         string_agg('{"modelId":"' || model_id || '","timestamp":"' || stamp || '","latency":'
           || CAST(latency AS VARCHAR) || ',"input":{"event_type":"' || event_type || '","k":' || k
           || '},"output":{"k":' || k || '}}', ',' ORDER BY pos) AS body
       FROM ev GROUP BY 1, 2, 3)"""


def packed_events(spark, sf_dir):
    records = tel.event_records(t.table(spark, sf_dir, "events").withColumn("_ts", F.col("ts")))
    return tel.pack_telemetry(records, ["user_id"], ["timestamp", "event_id"])


@query("telemetry_pack", f"""WITH {_PACKED}
SELECT user_id, batch_no, batch_id, '{{"batchId":"' || batch_id || '","payload":[' || body || ']}}'
       AS value FROM pk""")
def telemetry_pack(spark, sf_dir):
    return packed_events(spark, sf_dir)


@query("telemetry_explode", f"""WITH {_PACKED}
SELECT user_id || '-' || (pos // 50) AS batch_id, CAST(pos % 50 AS INTEGER) AS pos, model_id,
       CAST(CAST(replace(replace(stamp, 'T', ' '), 'Z', '') AS TIMESTAMP) AS TIMESTAMP) AS ts,
       round(latency, 6) AS latency, '{{"event_type":"' || event_type || '","k":' || k || '}}' AS input,
       '{{"k":' || k || '}}' AS output FROM ev""")
def telemetry_explode(spark, sf_dir):
    """Envelopes packed from the events, unpacked again."""
    rows = tel.explode_telemetry(packed_events(spark, sf_dir))
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("telemetry_malformed", """
SELECT page_id, length(html) AS n FROM pages""")
def telemetry_malformed(spark, sf_dir):
    """Web pages sent instead of envelopes: all of them are set aside."""
    pages = t.table(spark, sf_dir, "pages")
    bad = tel.malformed_telemetry(pages, "html")
    return bad.select("page_id", F.length("html").cast("bigint").alias("n"))


@query("schema_mismatch", f"""WITH {_PACKED}
SELECT user_id || '-' || (pos // 50) AS batch_id, count(*) AS records,
       'schema_mismatch' AS failure_type,
       'Schema mismatch: expected 2 features, but received 1.' AS message, 'inference' AS stage,
       'critical' AS severity
FROM ev WHERE k < 10 GROUP BY 1""")
def schema_mismatch(spark, sf_dir):
    """Records with a small k lose a feature on the way."""
    rows = tel.explode_telemetry(packed_events(spark, sf_dir))
    k = F.get_json_object("input", "$.k").cast("int")
    short = F.when(k < 10, F.to_json(F.struct(k.alias("k")))).otherwise(F.col("input"))
    return tel.schema_mismatch(rows.withColumn("input", short), 2)


_TORN = """ev AS (
  SELECT 'b' || (event_id // 50) AS batch_id, CAST(event_id % 50 AS INTEGER) AS pos, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
ju AS (SELECT batch_id, pos, CASE WHEN k < 5 THEN 'modelId missing' WHEN k >= 95 THEN 'timestamp missing or invalid'
         WHEN k = 50 THEN 'latency is no number' END AS reason FROM ev)"""


def torn_envelopes(spark, sf_dir):
    """Envelopes of fifty events, some records of which are broken; empty ones; and no envelopes at all."""
    k = F.get_json_object("props", "$.k").cast("int")
    events = t.table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id", "ts", k.alias("k"))
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    record = F.struct(
        F.when(F.col("k") >= 5, F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string"))).alias("modelId"),
        F.when(F.col("k") < 95, stamp).otherwise("soon").alias("timestamp"),
        F.when(F.col("k") != 50, F.round("value", 4).cast("string")).otherwise("fast").alias("latency"),
        F.struct("event_id", "event_type", "value", "k", "user_id").alias("input"),
        F.struct((F.col("k") / 100).alias("prediction")).alias("output"),
    )
    numbered = events.select(F.concat(F.lit("b"), F.floor(F.col("event_id") / 50)).alias("batchId"), "event_id", F.to_json(record).alias("r"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "r"))), lambda x: x["r"]), ",")
    whole = numbered.groupBy("batchId").agg(listed.alias("body")).selectExpr(
        """concat('{"batchId":"', batchId, '","payload":[', body, ']}') as value"""
    )
    empty = t.table(spark, sf_dir, "nation").selectExpr("""concat('{"batchId":"e', n_nationkey, '","payload":[]}') as value""")
    pages = t.table(spark, sf_dir, "pages").select(F.col("html").alias("value"))
    return whole.unionByName(empty).unionByName(pages)


@query("telemetry_quarantine", f"""WITH {_TORN}
SELECT batch_id, pos, reason FROM ju WHERE reason IS NOT NULL
UNION ALL SELECT 'e' || n_nationkey, NULL, 'payload empty' FROM nation
UNION ALL SELECT NULL, NULL, 'no JSON object' FROM pages""")
def telemetry_quarantine(spark, sf_dir):
    """Why records and envelopes were set aside; their neighbours are used."""
    return intake.quarantined(torn_envelopes(spark, sf_dir)).drop("text")


@query("telemetry_vitals", f"""WITH {_TORN},
gd AS (SELECT CAST(substr(batch_id, 2) AS BIGINT) * 50 + pos AS good FROM ju WHERE reason IS NULL),
{q.METRICS.replace("FROM events),", "FROM events JOIN gd ON event_id = good),", 1)}
SELECT model_id, batch, metric, round(value, 6) AS value FROM mt WHERE metric <> 'shap_importance'""")
def telemetry_vitals(spark, sf_dir):
    """From envelopes, broken records and repeats among them, to the vitals of the usable records."""
    spec = t.EVENTS_SPEC
    sent = torn_envelopes(spark, sf_dir)
    twice = sent.unionByName(sent.where(F.xxhash64("value") % 3 == 0))
    kinds = {"event_id": "bigint", "event_type": "string", "value": "double", "k": "double", "user_id": "bigint", "prediction": "double"}
    rows = intake.scored(intake.records(twice), spec, kinds).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows = settle_rows(rows.withColumn("batch", F.to_date("ts")))
    profile = baseline_profile(t.baseline_rows(rows), spec.numerical, row_id=spec.row_id)
    return monitor.vitals_metrics(t.live_rows(rows), profile, spec).where("metric <> 'shap_importance'")


# --- batch formation ----------------------------------------------------------------------


@query("batch_by_rows", f"""WITH {q.EVENTS}
SELECT event_id, model_id,
       (row_number() OVER (PARTITION BY model_id ORDER BY ts, event_id) - 1) // 50 AS batch
FROM se""")
def batch_by_rows(spark, sf_dir):
    scored = t.scored_events(spark, sf_dir).select("event_id", "model_id", "ts")
    return batching.batch_by_rows(scored, MODEL, ["ts", "event_id"]).drop("ts")


@query("batch_by_rows_lineitem", """
SELECT l_linestatus AS model_id, batch, count(*) AS rows, min(l_shipdate) AS first_ts,
       round(sum(l_quantity), 6) AS quantity
FROM (SELECT *, (row_number() OVER (PARTITION BY l_linestatus
                 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
                          l_extendedprice) - 1) // 1000 AS batch FROM lineitem)
GROUP BY 1, 2""")
def batch_by_rows_lineitem(spark, sf_dir):
    """Two models share the table, many rows share a day: no key or tie may hold it up."""
    items = t.table(spark, sf_dir, "lineitem").withColumnRenamed("l_linestatus", "model_id")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    batches = batching.batch_by_rows(
        items.select("model_id", "l_quantity", *order), MODEL, order, 1000
    )
    return batches.groupBy("model_id", "batch").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("l_shipdate").alias("first_ts"),
        F.sum("l_quantity").alias("quantity"),
    )


def gathered(chunks: str, size: int, min_rows: int, wait: int | None) -> str:
    """fl: batch of every chunk (model_id, chunk) by walking the chunks one after the other."""
    late = "false" if wait is None else (
        f"(epoch_us(c.ts) - epoch_us(f.last) >= {wait * 1_000_000} AND "
        f"CASE WHEN f.flushed THEN c.rows ELSE f.acc + c.rows END >= {min_rows})"
    )
    return f"""{chunks},
fl AS (
  SELECT model_id, chunk, rn, 0::BIGINT AS batch, rows AS acc, rows >= {size} AS flushed,
         ts AS last FROM ch WHERE rn = 1
  UNION ALL
  SELECT c.model_id, c.chunk, c.rn, CASE WHEN f.flushed THEN f.batch + 1 ELSE f.batch END,
         CASE WHEN f.flushed THEN c.rows ELSE f.acc + c.rows END,
         (CASE WHEN f.flushed THEN c.rows ELSE f.acc + c.rows END) >= {size} OR {late},
         CASE WHEN (CASE WHEN f.flushed THEN c.rows ELSE f.acc + c.rows END) >= {size} OR {late}
              THEN c.ts ELSE f.last END
  FROM fl f JOIN ch c ON c.model_id = f.model_id AND c.rn = f.rn + 1)"""


# Chunks as they would be sent: one per model and hour, of uneven size.
_HOURLY = f"""{q.EVENTS},
ch AS (SELECT model_id, chunk, count(*) AS rows, max(ts) AS ts,
              row_number() OVER (PARTITION BY model_id ORDER BY chunk) AS rn
       FROM (SELECT model_id, epoch_us(ts) // 3600000000 AS chunk, ts FROM se) GROUP BY 1, 2)"""
_LABELLED = """lb AS (SELECT se.event_id, se.model_id, fl.batch, max(fl.flushed) OVER (
         PARTITION BY fl.model_id, fl.batch) AS complete
       FROM se JOIN fl ON se.model_id = fl.model_id AND epoch_us(se.ts) // 3600000000 = fl.chunk)"""


def hourly(spark, sf_dir):
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000))
    return t.scored_events(spark, sf_dir).select("event_id", "model_id", "ts", hour.alias("chunk"))


@query("batch_by_chunks", f"""WITH RECURSIVE {gathered(_HOURLY, 50, 20, None)}, {_LABELLED}
SELECT event_id, model_id, batch, complete FROM lb""")
def batch_by_chunks(spark, sf_dir):
    """Whole chunks gather until they hold 50 rows; the open batch at the end is kept."""
    found = batching.assign_batches(hourly(spark, sf_dir), MODEL, "chunk", "ts", timeout_seconds=None)
    return found.select("event_id", "model_id", "batch", "complete")


@query("batch_by_time", f"""WITH RECURSIVE {gathered(_HOURLY, 50, 20, WAIT)}, {_LABELLED}
SELECT event_id, model_id, batch, complete FROM lb""")
def batch_by_time(spark, sf_dir):
    """Also flushed with 20 rows once six hours have passed since the last flush."""
    found = batching.assign_batches(hourly(spark, sf_dir), MODEL, "chunk", "ts", timeout_seconds=WAIT)
    return found.select("event_id", "model_id", "batch", "complete")


@query("batch_flush_final", f"""WITH RECURSIVE {gathered(_HOURLY, 50, 20, WAIT)}, {_LABELLED}
SELECT model_id, batch, count(*) AS rows, min(event_id) AS first_event FROM lb WHERE complete
GROUP BY 1, 2""")
def batch_flush_final(spark, sf_dir):
    """Sizes of the batches without the one left open at the end."""
    found = batching.assign_batches(
        hourly(spark, sf_dir), MODEL, "chunk", "ts", timeout_seconds=WAIT, keep_partial=False
    )
    return found.groupBy("model_id", "batch").agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first_event")
    )


@query("batch_tumbling", """
SELECT event_id, make_timestamp(epoch_us(ts) // 5000000 * 5000000) AS batch FROM events""")
def batch_tumbling(spark, sf_dir):
    ticked = batching.batch_tumbling(t.table(spark, sf_dir, "events"), "ts")
    return ticked.select("event_id", F.col("batch").cast("timestamp_ntz").alias("batch"))


@query("batch_rows_or_tick", f"""WITH {q.EVENTS}
SELECT event_id, model_id, make_timestamp(epoch_us(ts) // 86400000000 * 86400000000) AS tick,
       (row_number() OVER (PARTITION BY model_id, epoch_us(ts) // 86400000000
                           ORDER BY ts, event_id) - 1) // 50 AS part
FROM se""")
def batch_rows_or_tick(spark, sf_dir):
    """Fifty rows or the end of the day, whichever comes first."""
    scored = t.scored_events(spark, sf_dir).select("event_id", "model_id", "ts")
    found = batching.batch_rows_or_tick(scored, MODEL, "ts", ["ts", "event_id"], seconds=86_400)
    return found.select(
        "event_id", "model_id", F.col("tick").cast("timestamp_ntz").alias("tick"), "part"
    )


@query("keep_latest_n", f"""WITH {q.EVENTS}
SELECT event_id, model_id, ts FROM se
QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY ts DESC, event_id DESC) <= 500""")
def keep_latest_n(spark, sf_dir):
    scored = t.scored_events(spark, sf_dir).select("event_id", "model_id", "ts")
    return batching.keep_latest(scored, MODEL, ["ts", "event_id"], 500, ["event_id"])


@query("stream_batches", f"""WITH RECURSIVE {gathered(_HOURLY, 50, 20, WAIT)}, {_LABELLED}
SELECT event_id, model_id, batch FROM lb WHERE complete""")
def stream_batches_query(spark, sf_dir):
    """The gathering on a stream of files; the last open batch stays in the state."""
    schema = t.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000))
    rows = t.score_events(raw).select("event_id", "model_id", "ts", hour.alias("chunk"))
    out = scratch_path(spark, "batches")
    how = Gathering(("model_id",), "chunk", "ts", scratch_path(spark, "gather"), timeout_seconds=WAIT)
    stream_batches(rows, how, out, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "model_id", "batch")


# --- validation ---------------------------------------------------------------------------

# A description that the events break in several ways, some batches more than others.
BROKEN = dataclasses.replace(
    t.EVENTS_SPEC,
    features=("value", "k", "income"),
    numerical=("value", "event_type"),
    categorical=("event_type",),
    quasi=("nickname", "user_id"),
    prediction="score",
    protected=Protected("categorical", ("user_id",)),
)


def _flawed(spark, sf_dir):
    """Scored events with holes: no nickname for one model, some scores missing."""
    return t.scored_events(spark, sf_dir).selectExpr(
        "*",
        "if(model_id = 'm1', null, event_type) as nickname",
        "if(event_type = 'error' and k < 3, null, prediction) as score",
    )


_VIOLATIONS = f"""WITH {q.EVENTS},
fl AS (SELECT *, CASE WHEN model_id = 'm1' THEN NULL ELSE event_type END AS nickname,
              CASE WHEN event_type = 'error' AND k < 3 THEN NULL ELSE prediction END AS score FROM se),
ag AS (SELECT model_id, batch, count(nickname) AS nick, count(*) - count(score) AS holes,
              count(score) AS scores, count(DISTINCT user_id) AS users FROM fl GROUP BY 1, 2),
vi AS (
  SELECT model_id, batch, 1 AS rule_no, 'income' AS "column",
         'Feature column ''income'' missing in data.' AS message FROM ag
  UNION ALL SELECT model_id, batch, 2, 'event_type',
         'Column ''event_type'' cannot be both numerical and categorical.' FROM ag
  UNION ALL SELECT model_id, batch, 3, 'event_type',
         'Numerical feature ''event_type'' must be numeric.' FROM ag
  UNION ALL SELECT model_id, batch, 4, 'nickname',
         'Quasi identifier column ''nickname'' contains only null values.' FROM ag WHERE nick = 0
  UNION ALL SELECT model_id, batch, 6, 'income', 'Missing required column: ''income''' FROM ag
  UNION ALL SELECT model_id, batch, 9, 'score', 'Column ''score'' contains only null values.'
         FROM ag WHERE scores = 0
  UNION ALL SELECT model_id, batch, 11, 'score',
         'Prediction column ''score'' contains null values.' FROM ag WHERE holes > 0
  UNION ALL SELECT model_id, batch, 12, 'user_id',
         'Protected attribute ''user_id'' must contain at least two groups.' FROM ag WHERE users < 2
  UNION ALL SELECT model_id, batch, 13, 'user_id',
         'Protected attribute ''user_id'' has too many unique values.' FROM ag WHERE users > 20)"""


@query("validate_batches", f"""{_VIOLATIONS}
SELECT model_id, batch, CAST(rule_no AS INTEGER) AS rule_no, "column", message FROM vi""")
def validate_batches(spark, sf_dir):
    return validation.check_batches(_flawed(spark, sf_dir), BROKEN)


@query("validate_first_error", f"""{_VIOLATIONS}
SELECT model_id, batch, CAST(rule_no AS INTEGER) AS rule_no, "column", message FROM vi
QUALIFY row_number() OVER (PARTITION BY model_id, batch ORDER BY rule_no) = 1""")
def validate_first_error(spark, sf_dir):
    return validation.first_errors(validation.check_batches(_flawed(spark, sf_dir), BROKEN), BROKEN)


@query("validate_one_hot", """
WITH d AS (SELECT source, toxic, lang, doc_id % 97 = 0 AS odd FROM labels JOIN documents USING (doc_id)),
ag AS (SELECT source, toxic, count(*) FILTER (odd AND lang = 'en') AS strange,
              count(*) FILTER ((odd AND lang = 'en') OR lang NOT IN ('en', 'fr', 'de', 'es')) AS off
       FROM d GROUP BY 1, 2)
SELECT source, toxic, 'is_en' AS "column",
       'One-hot column ''is_en'' must contain only 0/1 values.' AS message FROM ag WHERE strange > 0
UNION ALL
SELECT source, toxic, '', 'Invalid one-hot encoding: each row must belong to exactly one group.'
FROM ag WHERE off > 0""")
def validate_one_hot(spark, sf_dir):
    """Language flags of the documents, with a 2 here and there."""
    docs = t.labelled_docs(spark, sf_dir).withColumn(
        "is_en", F.expr("if(doc_id % 97 = 0, is_en * 2, is_en)")
    )
    spec = dataclasses.replace(t.DOCS_SPEC, keys=("source", "toxic"))
    return validation.check_batches(docs, spec).select("source", "toxic", "column", "message")


@query("validate_empty", f"""WITH {q.EVENTS}
SELECT model_id, batch, 0::INTEGER AS rule_no, '' AS "column", 'Input is empty.' AS message
FROM (SELECT DISTINCT model_id, batch FROM se
      EXCEPT SELECT DISTINCT model_id, batch FROM se WHERE value > 60 AND value < 62)""")
def validate_empty(spark, sf_dir):
    """Batches without a row left after a narrow filter on the value."""
    scored = t.scored_events(spark, sf_dir)
    return validation.check_batches(
        scored.where("value > 60 and value < 62"), t.EVENTS_SPEC, expected=scored.select("model_id", "batch")
    ).where("rule_no = 0")


_QUARANTINE_SQL = f"""{_VIOLATIONS},
f1 AS (SELECT model_id, batch, message FROM vi WHERE rule_no IN (4, 11)
       QUALIFY row_number() OVER (PARTITION BY model_id, batch ORDER BY rule_no) = 1)
SELECT model_id, batch, count(*) AS rows, any_value(f1.message) AS message
FROM se LEFT JOIN f1 USING (model_id, batch) GROUP BY 1, 2"""


@query("quarantine", _QUARANTINE_SQL)
def quarantine(spark, sf_dir):
    """Rejected batches become failure records; the rows of the others pass on. Together they
    are all batches again."""
    rows = _flawed(spark, sf_dir)
    spec = dataclasses.replace(
        BROKEN, features=("value", "k"), numerical=("value", "k"),
        protected=Protected("categorical", ("event_type",)),
    )
    at = F.col("batch").cast("timestamp")
    failed = settle(validation.failures(validation.check_batches(rows, spec), spec, "inference", at))
    passed = validation.accepted(rows, failed, spec.by)
    counts = rows.groupBy(*spec.by).agg(F.count(F.lit(1)).alias("rows"))
    bad = failed.join(counts, spec.by).select(*spec.by, "rows", F.col("failure.message").alias("message"))
    good = passed.groupBy(*spec.by).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(None).cast("string").alias("message")
    )
    return bad.unionByName(good)


def _misdescribed(spec) -> dict:
    """Descriptions of the scored events that are wrong in one way each, and what each is rejected for."""
    change = dataclasses.replace
    return {
        "domain": (change(spec, domain="retail"), "Invalid domain 'retail'."),
        "categorical": (change(spec, categorical=("color",), features=("value", "k")), "Categorical feature 'color' missing in data."),
        "overlap": (change(spec, categorical=("k", "event_type")), "Column 'k' cannot be both numerical and categorical."),
        "numerical": (change(spec, numerical=("value", "event_type"), categorical=()), "Numerical feature 'event_type' must be numeric."),
        "prediction": (change(spec, prediction="event_type"), "Prediction column 'event_type' must be numeric."),
        "kind": (change(spec, protected=Protected("ordinal", ("event_type",))), "Protected attribute type must be 'categorical' or 'one_hot'."),
        "columns": (change(spec, protected=Protected("one_hot", ())), "Protected attribute 'columns' must be a non-empty list."),
        "two": (change(spec, protected=Protected("categorical", ("event_type", "user_id"))), "Categorical protected attribute must contain exactly one column."),
        "single": (change(spec, protected=Protected("one_hot", ("event_id",))), "One-hot protected attributes must contain at least two columns."),
        "duplicate": (spec, "Duplicate columns detected."),
    }


_REASONS = " UNION ALL ".join(
    f"SELECT '{name}' AS case_name, '{message.replace(chr(39), chr(39) * 2)}' AS message"
    for name, (_, message) in _misdescribed(t.EVENTS_SPEC).items()
)


@query("validate_descriptions", f"""WITH {q.EVENTS}, rs AS ({_REASONS})
SELECT case_name, model_id, batch, message FROM (SELECT DISTINCT model_id, batch FROM se), rs""")
def validate_descriptions(spark, sf_dir):
    """Rules on the description and the schema: every batch of the events is rejected for each flaw."""
    rows = t.scored_events(spark, sf_dir)
    parts = []
    for name, (spec, message) in _misdescribed(t.EVENTS_SPEC).items():
        given = rows.select("*", F.col("value").alias("k")) if name == "duplicate" else rows
        found = validation.check_batches(given, spec).where(F.col("message") == message)
        parts.append(found.select(F.lit(name).alias("case_name"), "model_id", "batch", "message"))
    return reduce(DataFrame.unionByName, parts)
