"""Registered queries of the dependency graph and of heartbeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelpulse.functions.ordering import number_rows
from modelpulse.functions.storage import scratch_path, settle, settle_rows
from modelpulse.operators import graph, reporting, series
from modelpulse.operators.cycles import strong_components
from modelpulse.plans import monitor
from modelpulse.plans import sql as q
from modelpulse.plans.registry import query
from modelpulse.plans.report_queries import monitored_events
from modelpulse.plans.vital_queries import SHAP_SPEC, shap_split
from modelpulse.sources import tables as t
from modelpulse.streaming.heartbeat import outages

ORDER = ["ts", "seq"]
SILENCE = 6 * 3600


@query("node_request", f"""WITH {q.RECORD}
SELECT rq.model_id AS node, min(ts) AS seq, any_value(req) AS req_status
FROM rq JOIN l0 USING (model_id, batch) GROUP BY model_id, batch""")
def node_request(spark, sf_dir):
    """Requests of the models' nodes, at the first moment of each batch."""
    run = monitored_events(spark, sf_dir)
    return run.requests.select("node", F.col("seq").cast("timestamp_ntz").alias("seq"), "req_status")


_STATUS = f"""WITH {q.NODE_EVENTS},
nl AS (SELECT *, lag(req_status) OVER (PARTITION BY node ORDER BY ts, seq) AS was FROM ne),
ns AS (SELECT node, ts, seq, req_status,
              CASE WHEN req_status = 'green' AND was = 'critical' THEN 'critical' ELSE req_status END
                AS status FROM nl)"""


@query("node_hysteresis", f"{_STATUS} SELECT * FROM ns")
def node_hysteresis(spark, sf_dir):
    return graph.node_status(t.node_events(spark, sf_dir), ORDER)


@query("healthy_nodes", """WITH ne AS (
  SELECT 'user_' || user_id AS node, ts, event_id AS seq,
         CASE WHEN value >= 60 THEN 'critical' WHEN value >= 40 THEN 'warning' ELSE 'green' END
           AS req_status FROM events),
nl AS (SELECT *, lag(req_status) OVER (PARTITION BY node ORDER BY ts, seq) AS was,
              row_number() OVER (PARTITION BY node ORDER BY ts DESC, seq DESC) AS rn FROM ne)
SELECT node, 'green' AS status FROM nl
WHERE rn = 1 AND req_status = 'green' AND coalesce(was, '') <> 'critical'""")
def healthy_nodes(spark, sf_dir):
    """Latest state of one node per user, the green ones."""
    named = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    events = t.table(spark, sf_dir, "events")
    value = F.col("value")
    status = F.when(value >= 60, "critical").when(value >= 40, "warning").otherwise("green")
    requests = events.select(
        named.alias("node"), "ts", F.col("event_id").alias("seq"), status.alias("req_status")
    )
    return graph.healthy_nodes(graph.current_status(requests, ORDER))


@query("node_lock", """WITH ne AS (
  SELECT event_type AS node, ts, event_id AS seq,
         CASE WHEN value >= 80 THEN 'locked' WHEN value >= 60 THEN 'critical' ELSE 'green' END
           AS req_status FROM events),
nl AS (SELECT *, lag(req_status) OVER (PARTITION BY node ORDER BY ts, seq) AS was FROM ne)
SELECT node, ts, seq, CASE WHEN req_status = 'green' AND was = 'critical' THEN 'critical'
                           ELSE req_status END AS status FROM nl""")
def node_lock(spark, sf_dir):
    """Extreme values lock their node; a lock is a request like others."""
    events = t.table(spark, sf_dir, "events")
    status = F.expr("case when value >= 80 then 'locked' when value >= 60 then 'critical' else 'green' end")
    requests = events.select(
        F.col("event_type").alias("node"), "ts", F.col("event_id").alias("seq"),
        status.alias("req_status"),
    )
    return graph.node_status(requests, ORDER).drop("req_status")


@query("node_reset", f"""WITH {q.NODE_EVENTS},
nr AS (SELECT node, ts, seq, CASE WHEN seq % 50 = 0 THEN 'reset' ELSE req_status END AS req_status
       FROM ne),
nl AS (SELECT *, lag(req_status) OVER (PARTITION BY node ORDER BY ts, seq) AS was FROM nr)
SELECT node, ts, seq, req_status, CASE WHEN req_status = 'reset' THEN 'green'
       WHEN req_status = 'green' AND was = 'critical' THEN 'critical' ELSE req_status END AS status
FROM nl""")
def node_reset(spark, sf_dir):
    """Every fiftieth event resets its node: green at once, and no hold after it."""
    events = t.node_events(spark, sf_dir)
    reset = F.expr("if(seq % 50 = 0, 'reset', req_status)")
    return graph.node_status(events.withColumn("req_status", reset), ORDER)


@query("status_score", f"""{_STATUS}
SELECT node, count(*) AS updates, round(avg(CASE status WHEN 'green' THEN 1.0 WHEN 'warning' THEN 0.6
       WHEN 'grey' THEN 0.5 ELSE 0.0 END), 6) AS health FROM ns GROUP BY 1""")
def status_score(spark, sf_dir):
    states = graph.node_status(t.node_events(spark, sf_dir), ORDER)
    return states.groupBy("node").agg(
        F.count(F.lit(1)).alias("updates"),
        F.avg(graph.status_score(F.col("status"))).alias("health"),
    )


@query("node_adjacency", f"""WITH {q.GRAPH},
bo AS (SELECT src AS node, 'downstream' AS side, dst AS other FROM eg
       UNION SELECT dst, 'upstream', src FROM eg),
nb AS (SELECT *, (row_number() OVER (PARTITION BY node, side ORDER BY other) - 1) // 1000 AS page_no
       FROM bo)
SELECT node, side, page_no, string_agg(other, ',' ORDER BY other) AS neighbours
FROM nb GROUP BY 1, 2, 3""")
def node_adjacency(spark, sf_dir):
    lists = graph.adjacency(t.graph_tables(spark, sf_dir)[1])
    return lists.withColumn("neighbours", F.array_join("neighbours", ","))


@query("edge_weights", """
SELECT 'part_' || l_partkey AS src, 'supplier_' || l_suppkey AS dst,
       round(arg_max(l_discount * 10 + 0.0, l_orderkey * 10 + l_linenumber), 6) AS weight
FROM lineitem GROUP BY 1, 2""")
def edge_weights(spark, sf_dir):
    """Repeated edges keep the weight given last."""
    items = t.table(spark, sf_dir, "lineitem")
    edges = items.selectExpr(
        "concat('part_', l_partkey) as src", "concat('supplier_', l_suppkey) as dst",
        "l_discount * 10 + 0.0D as weight", "l_orderkey * 10 + l_linenumber as seq",
    )
    return graph.latest_edges(edges, "seq")


@query("graph_integrity", f"""WITH {q.GRAPH},
n2 AS (SELECT node FROM nd WHERE node NOT LIKE 'customer_1%'
       UNION ALL SELECT 'nation_' || n_nationkey FROM nation WHERE n_regionkey = 1)
SELECT 'duplicate node' AS problem, node AS item FROM n2 GROUP BY node HAVING count(*) > 1
UNION ALL
SELECT DISTINCT 'edge endpoint missing', e FROM (SELECT src AS e FROM eg UNION SELECT dst FROM eg)
WHERE e NOT IN (SELECT node FROM n2)
UNION ALL
SELECT DISTINCT 'unknown node', event_type FROM events""")
def graph_integrity(spark, sf_dir):
    """A graph that lacks some customers and names some nations twice, with runs of nodes that
    are not in it at all."""
    nodes, edges = t.graph_tables(spark, sf_dir)
    nation = t.table(spark, sf_dir, "nation").where("n_regionkey = 1")
    twice = nation.selectExpr("concat('nation_', n_nationkey) as node")
    flawed = nodes.where("node not like 'customer\\\\_1%'").select("node").unionByName(twice)
    return graph.check_graph(flawed, edges, t.node_events(spark, sf_dir))


_OWN_STATUS = """st AS (
  SELECT nd.node, CASE WHEN c_acctbal < -500 THEN 'critical' WHEN c_acctbal < 1000 THEN 'warning'
                       ELSE 'green' END AS status
  FROM nd LEFT JOIN customer ON nd.node = 'customer_' || c_custkey),
sd AS (SELECT 'region_' || r_regionkey AS node FROM region WHERE r_regionkey IN (1, 3))"""


def _own_status(spark, sf_dir):
    nodes, edges = t.graph_tables(spark, sf_dir)
    customers = t.table(spark, sf_dir, "customer").selectExpr(
        "concat('customer_', c_custkey) as node", "c_acctbal"
    )
    status = nodes.join(customers.hint("merge"), "node", "left").selectExpr(
        "node",
        """case when c_acctbal < -500 then 'critical' when c_acctbal < 1000 then 'warning'
                else 'green' end as status""",
    )
    seeds = nodes.where("node in ('region_1', 'region_3')").select("node")
    return status, edges, seeds


_SPREAD = f"""WITH RECURSIVE {q.GRAPH}, {_OWN_STATUS},
ac AS (SELECT node FROM sd UNION SELECT dst FROM ac JOIN eg ON src = node),
cr AS (SELECT node FROM sd
       UNION SELECT node FROM st WHERE status = 'critical' AND node IN (SELECT node FROM ac)
       UNION SELECT dst FROM cr JOIN eg ON src = node AND weight >= 0.5),
wa AS (SELECT node FROM st WHERE status = 'warning' AND node IN (SELECT node FROM ac)
       UNION SELECT dst FROM wa JOIN eg ON src = node AND weight >= 0.5),
fs AS (SELECT node, status AS was, CASE
         WHEN node IN (SELECT node FROM cr) THEN 'critical'
         WHEN node IN (SELECT node FROM wa) THEN 'warning' ELSE status END AS status FROM st)"""


@query("propagate_impact", f"""{_SPREAD}
SELECT node, status, status <> was AS raised FROM fs""")
def propagate_impact(spark, sf_dir):
    """Two regions turn critical in a graph whose customers already alarm here and there."""
    return graph.propagate(*_own_status(spark, sf_dir))


@query("inject_failure", f"""WITH RECURSIVE {q.GRAPH},
sd AS (SELECT 'nation_' || n_nationkey AS node FROM nation WHERE n_nationkey < 5),
cr AS (SELECT node FROM sd UNION SELECT dst FROM cr JOIN eg ON src = node AND weight >= 0.5)
SELECT node, CASE WHEN node IN (SELECT node FROM cr) THEN 'critical' ELSE 'green' END AS status,
       node IN (SELECT node FROM cr) AS raised,
       CASE WHEN node IN (SELECT node FROM sd)
            THEN '{{"failure_type":"inference_crash","stage":"' || node || '"}}' END AS failure
FROM nd""")
def inject_failure(spark, sf_dir):
    """Failures of five nations in an otherwise green graph."""
    nodes, edges = t.graph_tables(spark, sf_dir)
    status = nodes.select("node", F.lit("green").alias("status"))
    nation = t.table(spark, sf_dir, "nation").where("n_nationkey < 5")
    failed = nation.selectExpr("concat('nation_', n_nationkey) as node").selectExpr(
        "node",
        "to_json(named_struct('failure_type', 'inference_crash', 'stage', node)) as failure",
    )
    return graph.inject_failures(status, edges, failed)


@query("graph_cycles", """WITH RECURSIVE fo AS (
  SELECT 'u' || user_id || '_' || event_type || '_' || strftime(ts, '%d') AS u,
         lead('u' || user_id || '_' || event_type || '_' || strftime(ts, '%d')) OVER w AS v,
         user_id, lead(user_id) OVER w AS next_id, value
  FROM events WINDOW w AS (PARTITION BY event_type, strftime(ts, '%d') ORDER BY ts, event_id)),
eg AS (SELECT DISTINCT CASE WHEN (user_id < next_id) = (value < 95) THEN u ELSE v END AS src,
                       CASE WHEN (user_id < next_id) = (value < 95) THEN v ELSE u END AS dst
       FROM fo WHERE v IS NOT NULL),
rc AS (SELECT src, dst FROM eg UNION SELECT rc.src, eg.dst FROM rc JOIN eg ON rc.dst = eg.src)
SELECT a.src AS node, min(a.dst) AS component FROM rc a JOIN rc b ON a.src = b.dst AND a.dst = b.src
GROUP BY 1""")
def graph_cycles(spark, sf_dir):
    """Users that follow each other in the events of a type and day, upwards unless the event is
    large; the nodes on a cycle with the smallest node of their component."""
    return strong_components(_follow_edges(t.table(spark, sf_dir, "events")))


def _follow_edges(events):
    """Edge between the users of consecutive events of a type on one day."""
    place = F.concat_ws("_", "event_type", F.date_format("ts", "dd"))
    named = events.select(place.alias("node"), "ts", F.col("event_id").alias("seq"), "user_id", "value")
    numbered = settle(number_rows(named, ["node"], ORDER, "_seq"))
    after = numbered.selectExpr("node", "_seq - 1 as _seq", "user_id as next_id")
    forward = "(user_id < next_id) = (value < 95)"
    u, v = "concat('u', user_id, '_', node)", "concat('u', next_id, '_', node)"
    return numbered.join(after, ["node", "_seq"]).selectExpr(
        f"if({forward}, {u}, {v}) as src", f"if({forward}, {v}, {u}) as dst"
    )


@query("heartbeat_timeout", """WITH s AS (
  SELECT event_type || '_' || user_id AS node, max(ts) AS last_seen FROM events GROUP BY 1)
SELECT node, last_seen, 'grey' AS status FROM s
WHERE TIMESTAMP '2024-01-31' - last_seen > INTERVAL 2 DAY""")
def heartbeat_timeout(spark, sf_dir):
    """One node per event type and user, silent for two days at the end of the month."""
    events = t.table(spark, sf_dir, "events").selectExpr(
        "concat(event_type, '_', user_id) as node", "ts"
    )
    nodes = events.select("node").distinct()
    asof = F.lit("2024-01-31").cast("timestamp")
    return graph.heartbeat_timeouts(nodes, events, asof, 2 * 86400)


@query("heartbeat_gaps", f"""
SELECT node, last_seen, seen_again FROM (
  SELECT 'user_' || user_id AS node, ts AS seen_again,
         lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_seen FROM events)
WHERE epoch_us(seen_again) - epoch_us(last_seen) > {SILENCE * 1_000_000}""")
def heartbeat_gaps(spark, sf_dir):
    return graph.heartbeat_gaps(_user_beats(t.table(spark, sf_dir, "events")), SILENCE)


_SESSIONS = f"""g AS (
  SELECT user_id, ts, event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > {SILENCE * 1_000_000},
         true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g),
o AS (SELECT 'user_' || user_id AS node, min(ts) AS first_seen, max(ts) AS last_seen,
             count(*) AS events, max(ts) + INTERVAL {SILENCE * 1000000 + 1} MICROSECOND AS grey_at
      FROM s GROUP BY user_id, no)"""


def _user_beats(events):
    return events.selectExpr("concat('user_', user_id) as node", "ts")


def _plain_times(df):
    return df.select(
        *[F.col(c).cast("timestamp_ntz").alias(c) if d == "timestamp" else F.col(c) for c, d in df.dtypes]
    )


@query("heartbeat_sessions", f"WITH {_SESSIONS} SELECT * FROM o")
def heartbeat_sessions(spark, sf_dir):
    return _plain_times(
        graph.activity_periods(_user_beats(t.table(spark, sf_dir, "events")), SILENCE)
    )


@query("stream_heartbeat", f"""WITH {_SESSIONS}
SELECT * FROM o WHERE epoch_us(grey_at) // 1000 <= (SELECT epoch_ms(max(ts)) FROM events)""")
def stream_heartbeat(spark, sf_dir):
    """The same on a stream: an alarm appears once the watermark has passed it."""
    schema = t.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out, checkpoint = scratch_path(spark, "outages"), scratch_path(spark, "outages-progress")
    (
        outages(_user_beats(stream), SILENCE, watermark="0 seconds")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return _plain_times(spark.read.parquet(out))


# Statuses one moment after the other, level by level: `ow` has the requests (node, ts, seq, req).
LEVELS = ("region", "nation", "customer", "order")


def _folded() -> str:
    """fs: every moment of every node; needs ow and eg."""
    parts = []
    for no, name in enumerate(LEVELS):
        own = f"""SELECT node, ts, seq, node AS origin, req AS own, NULL::INTEGER AS passed, req = 'critical' AS visited
  FROM ow WHERE node LIKE '{name}~_%' ESCAPE '~'"""
        if no:
            own += f"""
  UNION ALL SELECT dst, ts, seq, origin, NULL, CASE WHEN weight < 0.5 THEN NULL WHEN status = 'critical' THEN 3
       WHEN status = 'warning' THEN 2 END, true FROM f{no - 1} JOIN eg ON src = node WHERE visited"""
        step = """CASE WHEN own IS NOT NULL THEN own WHEN passed = 3 THEN 'critical' ELSE last END AS last,
       CASE WHEN own = 'green' AND last = 'critical' THEN 'critical' WHEN own = 'reset' THEN 'green'
            WHEN own IS NOT NULL THEN own WHEN passed = 3 THEN 'critical'
            WHEN passed = 2 AND status <> 'critical' THEN 'warning' ELSE status END AS status"""
        parts.append(f"""r{no} AS ({own}),
n{no} AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts, seq, origin) AS rn FROM r{no}),
f{no} AS (
  SELECT node, ts, seq, origin, own, passed, visited, rn, {step}
  FROM (SELECT *, NULL::VARCHAR AS last, 'green' AS status FROM n{no} WHERE rn = 1)
  UNION ALL
  SELECT n.node, n.ts, n.seq, n.origin, n.own, n.passed, n.visited, n.rn,
         {step.replace("own", "n.own").replace("passed", "n.passed").replace("ELSE last", "ELSE f.last").replace("AND last", "AND f.last").replace("ELSE status", "ELSE f.status").replace("AND status", "AND f.status")}
  FROM f{no} f JOIN n{no} n ON n.node = f.node AND n.rn = f.rn + 1)""")
    union = " UNION ALL ".join(f"SELECT * FROM f{no}" for no in range(len(LEVELS)))
    return ",\n".join(parts) + f""",
fs AS (SELECT node, ts, seq, origin, own AS request, CASE passed WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' END AS passed,
              status FROM ({union}) WHERE own IS NOT NULL OR passed IS NOT NULL)"""


def _silent(source: str, seconds: int, seq: str) -> str:
    """Requests for grey after a silence, up to the end of the month."""
    return f"""SELECT node, ts + INTERVAL {seconds * 1_000_000 + 1} MICROSECOND AS ts, {seq} AS seq, 'grey' AS req
  FROM (SELECT node, ts, lead(ts) OVER (PARTITION BY node ORDER BY ts) AS next FROM {source})
  WHERE (next IS NULL OR epoch_us(next) - epoch_us(ts) > {seconds * 1_000_000})
    AND ts + INTERVAL {seconds * 1_000_000 + 1} MICROSECOND <= TIMESTAMP '2024-01-31'"""


@query("status_series", f"""WITH RECURSIVE {q.GRAPH},
bt AS (SELECT 'customer_' || user_id AS node, ts, event_id AS seq,
         CASE WHEN value >= 60 THEN 'critical' WHEN value >= 40 THEN 'warning' ELSE 'green' END AS req FROM events),
ow AS (SELECT * FROM bt
  UNION ALL SELECT 'nation_' || user_id % 25, ts, event_id,
         CASE WHEN value >= 200 THEN 'critical' WHEN value >= 100 THEN 'warning' ELSE 'green' END
       FROM events WHERE event_type = 'error'
  UNION ALL {_silent("bt", 2 * 86400, "-1")}),
{_folded()}
SELECT * FROM fs""")
def status_series(spark, sf_dir):
    """Customers ask with every event, nations with every error; customers that send nothing for two
    days turn grey; what is critical spreads to the orders at that moment."""
    events = t.table(spark, sf_dir, "events")

    def asked(of, prefix: str, key: str, bands: str):
        return of.selectExpr(f"concat('{prefix}', {key}) as node", "ts", "event_id as seq", f"{bands} as req_status")

    band = "case when value >= {} then 'critical' when value >= {} then 'warning' else 'green' end"
    customers = asked(events, "customer_", "user_id", band.format(60, 40))
    nations = asked(events.where("event_type = 'error'"), "nation_", "user_id % 25", band.format(200, 100))
    until = F.lit("2024-01-31").cast("timestamp")
    silent = series.silence_requests(customers, 2 * 86400, until, F.lit(-1).cast("bigint"))
    requests = customers.unionByName(nations).unionByName(silent)
    return series.status_series(requests, t.graph_tables(spark, sf_dir)[1])


@query("run_pipeline", f"""WITH RECURSIVE {q.RECORD}, {q.GRAPH},
bt AS (SELECT 'region_' || substr(model_id, 2) AS node, min(ts) AS ts, CAST(batch AS VARCHAR) AS seq, any_value(req) AS req
       FROM rq JOIN l0 USING (model_id, batch) GROUP BY model_id, batch),
ow AS (SELECT * FROM bt UNION ALL {_silent("bt", SILENCE, "''")}),
{_folded().replace("fs AS", "sr AS")}
SELECT * FROM sr""")
def run_pipeline(spark, sf_dir):
    """From raw events to the statuses of the whole graph over time: each model runs a region, its
    days are batches, and a region without a batch for six hours turns grey."""
    before, live = shap_split(spark, sf_dir)
    node = F.concat(F.lit("region_"), F.substring("node", 2, 9))
    until = F.lit("2024-01-31").cast("timestamp")
    edges = t.graph_tables(spark, sf_dir)[1]
    return monitor.run_pipeline(live, before, SHAP_SPEC, edges, node, SILENCE, until)[1]


_TRACE = f"""{_SPREAD},
up AS (SELECT dst AS node, string_agg('"' || src || '"', ',' ORDER BY src) AS l FROM eg GROUP BY 1),
dn AS (SELECT src AS node, page_no, string_agg('"' || dst || '"', ',' ORDER BY dst) AS l
       FROM (SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1) // 1000
                    AS page_no FROM eg) GROUP BY 1, 2)"""


def _spread_trace(spark, sf_dir):
    nodes, edges = t.graph_tables(spark, sf_dir)
    status = settle_rows(graph.propagate(*_own_status(spark, sf_dir)))
    return graph.trace_json(nodes, edges, status)


@query("graph_trace_json", f"""{_TRACE}
SELECT nd.node, coalesce(dn.page_no, 0) AS page_no,
  '{{"' || nd.node || '":{{"name":"' || nd.node || '","owner":"' || owner || '","status":"' || status
  || '","metrics":{{}},"upstream":[' || CASE WHEN coalesce(page_no, 0) = 0 THEN coalesce(up.l, '')
  ELSE '' END || '],"downstream":[' || coalesce(dn.l, '') || ']}}}}' AS trace
FROM nd JOIN fs USING (node) LEFT JOIN up ON up.node = nd.node LEFT JOIN dn ON dn.node = nd.node""")
def graph_trace_json(spark, sf_dir):
    return _spread_trace(spark, sf_dir)


@query("trace_nodes", f"""{_SPREAD}
SELECT nd.node AS name, replace(nd.node, '_', ' ') AS label, owner, status,
       status IN ('critical', 'warning') AS alert,
       (SELECT count(*) FROM eg WHERE src = nd.node) AS children
FROM nd JOIN fs USING (node)""")
def trace_nodes(spark, sf_dir):
    """Display rows of the nodes, parsed back from trace documents below a `nodes` key."""
    wrapped = _spread_trace(spark, sf_dir).select(
        F.concat(F.lit('{"nodes":'), "trace", F.lit("}")).alias("trace")
    )
    rows = reporting.trace_nodes(wrapped)
    # A node with several pages of neighbours comes once per page.
    return rows.groupBy("name", "label", "owner", "status", "alert").agg(
        F.sum(F.size("downstream")).alias("children")
    )


@query("trace_nodes_edges", f"""{_SPREAD}
SELECT 'e-' || src || '-' || dst AS id, src AS source, dst AS target,
       status IN ('critical', 'warning') AS alert FROM eg JOIN fs ON node = src""")
def trace_nodes_edges(spark, sf_dir):
    return reporting.trace_edges(_spread_trace(spark, sf_dir))
