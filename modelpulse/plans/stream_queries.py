"""Registered query of a whole stream: rows in, graded vitals out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelpulse.functions.storage import scratch_path, settle
from modelpulse.operators import baseline as base
from modelpulse.operators import fairness, privacy
from modelpulse.plans import sql as q
from modelpulse.plans.ingest_queries import WAIT, gathered
from modelpulse.plans.registry import query
from modelpulse.plans.vital_queries import BY, events_split
from modelpulse.sources import tables as t
from modelpulse.streaming import batches as st
from modelpulse.streaming import timers

#: Days at which the events of the month are handed to a stream that is stopped in between.
SLICES = (1, 8, 15, 23, 32)

_LIVE_CHUNKS = f"""{q.EVENTS},
ch AS (SELECT model_id, chunk, count(*) AS rows, max(ts) AS ts,
              row_number() OVER (PARTITION BY model_id ORDER BY chunk) AS rn
       FROM (SELECT model_id, epoch_us(ts) // 3600000000 AS chunk, ts FROM li) GROUP BY 1, 2)"""
# The vitals read `li`; here its batches are the gathered ones that were completed.
_GATHERED_LIVE = """lb AS (
  SELECT l0.*, fl.batch AS number, max(fl.flushed) OVER (PARTITION BY fl.model_id, fl.batch) AS done
  FROM l0 JOIN fl ON l0.model_id = fl.model_id AND epoch_us(l0.ts) // 3600000000 = fl.chunk),
lg AS (SELECT * EXCLUDE (batch, number, done), number AS batch FROM lb WHERE done)"""


def _on_gathered(block: str) -> str:
    return block.replace("FROM li", "FROM lg")


@query("stream_vitals", f"""WITH RECURSIVE {gathered(_LIVE_CHUNKS, 50, 20, WAIT)}, {_GATHERED_LIVE},
{_on_gathered(q.GINI)},
{_on_gathered(q.privacy("user_id, event_type"))},
{_on_gathered(q.parity("event_type"))},
mt AS (SELECT model_id, batch, 'gini' AS metric, gini AS value FROM gn
  UNION ALL SELECT model_id, batch, 'privacy_score', privacy_score FROM pv
  UNION ALL SELECT model_id, batch, 'statistical_parity', statistical_parity FROM pa),
{q.SUMMARY}, {q.raw_grade("'finance'")}, {q.persisted()}
SELECT model_id, batch, metric, round(value, 6) AS value, raw, status FROM ge""")
def stream_vitals(spark, sf_dir):
    """Live events as a stream: gathered into batches, graded with the statuses of earlier
    micro-batches, appended to the table that is read back here."""
    before, _ = events_split(spark, sf_dir)
    spec = t.EVENTS_SPEC
    summary = settle(base.baseline_summary(before, spec))
    root = scratch_path(spark, "stream-vitals")

    def judge(closed: DataFrame, epoch_id: int) -> None:
        parts = [
            (fairness.gini(closed, spec.prediction, BY), "gini"),
            (privacy.privacy_score(closed, spec.quasi, BY), "privacy_score"),
            (fairness.statistical_parity(closed, spec), "statistical_parity"),
        ]
        long = [df.selectExpr(*BY, f"'{name}' as metric", f"{name} as value") for df, name in parts]
        metrics = long[0].unionByName(long[1]).unionByName(long[2])
        st.grade_epoch(metrics, summary, spec, root, epoch_id, domain="finance")

    schema = t.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000))
    rows = t.live_rows(t.score_events(raw)).drop("batch").withColumn("chunk", hour)
    how = st.Gathering(("model_id",), "chunk", "ts", f"{root}/gather", timeout_seconds=WAIT)
    st.stream_batches(rows, how, f"{root}/rows", f"{root}/progress", judge).awaitTermination()
    return spark.read.parquet(f"{root}/evaluated").select(*BY, "metric", "value", "raw", "status")


def _in_slices(spark: SparkSession, sf_dir: str, label: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream makes of the events when it is run once per slice of the month, each time from
    where it stopped; a slice is one micro-batch, however many files it has."""
    events = t.table(spark, sf_dir, "events")
    root = scratch_path(spark, label)
    for low, high in zip(SLICES, SLICES[1:]):
        day = F.dayofmonth("ts")
        events.where((day >= low) & (day < high)).write.mode("append").parquet(f"{root}/in")
        stream = work(spark.readStream.schema(events.schema).parquet(f"{root}/in"))
        with timers.options(spark):
            query = (
                stream.writeStream.format("parquet").option("path", f"{root}/out")
                .option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
            )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("stream_rows_or_tick", f"""WITH {q.EVENTS},
b AS (SELECT event_id, model_id, user_id % 4 // 2 + user_id // 4 % 2 * 2 AS client, ts, date_trunc('day', ts) AS tick FROM se),
n AS (SELECT *, (row_number() OVER (PARTITION BY model_id, client, tick ORDER BY ts, event_id) - 1) // 5 AS part FROM b),
c AS (SELECT *, count(*) OVER (PARTITION BY model_id, client, tick, part) AS rows FROM n)
SELECT event_id, model_id, client, CAST(tick AS TIMESTAMP) AS tick, part FROM c
WHERE rows = 5 OR tick + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)""")
def stream_rows_or_tick(spark, sf_dir):
    """Five rows or the end of the day, per model and client, on a stream of four runs; a timer sends
    off what is open when the day ends, so only the last day keeps rows back."""
    client = F.expr("user_id % 4 div 2 + user_id div 4 % 2 * 2").alias("client")

    def work(raw: DataFrame) -> DataFrame:
        rows = t.score_events(raw).select("event_id", "model_id", client, "ts")
        return timers.stream_rows_or_tick(
            rows, ["model_id", "client"], "ts", ["ts", "event_id"], "0 seconds", size=5, seconds=86_400
        )

    found = _in_slices(spark, sf_dir, "rows-or-tick", work)
    return found.select("event_id", "model_id", "client", F.col("tick").cast("timestamp_ntz").alias("tick"), "part")


_QUIET = 6 * 3600


@query("stream_alerts", f"""WITH g AS (
  SELECT user_id, ts, event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > {_QUIET * 1_000_000}, true) AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g),
o AS (SELECT user_id, no, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS events,
             max(ts) + INTERVAL {_QUIET * 1_000_000 + 1} MICROSECOND AS "at" FROM s GROUP BY 1, 2),
e AS (SELECT *, lead(first_seen) OVER (PARTITION BY user_id ORDER BY no) AS again FROM o)
SELECT 'user_' || user_id AS node, 'grey' AS event, "at", first_seen, last_seen, events FROM e
WHERE again IS NOT NULL OR (epoch_us("at") + 999) // 1000 <= (SELECT epoch_ms(max(ts)) FROM events)
UNION ALL
SELECT 'user_' || user_id, 'seen', again, again, again, 0 FROM e WHERE again IS NOT NULL""")
def stream_alerts(spark, sf_dir):
    """Users that were silent for six hours and users that came back, from a stream of four runs."""
    def work(raw: DataFrame) -> DataFrame:
        return timers.silence_alerts(raw.selectExpr("concat('user_', user_id) as node", "ts"), _QUIET, "0 seconds")

    found = _in_slices(spark, sf_dir, "alerts", work)
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("at", "first_seen", "last_seen")]
    return found.select("node", "event", *times, "events")
