"""SQL building blocks of the checks: the same views over the warehouse tables."""

EVENTS = """se AS (
  SELECT event_id, ts, 'm' || CAST(user_id % 4 AS VARCHAR) AS model_id, CAST(ts AS DATE) AS batch,
         value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type, user_id,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS prediction
  FROM events),
ba AS (SELECT * FROM se WHERE ts < TIMESTAMP '2024-01-11'),
pm AS (SELECT model_id, avg(prediction) AS pmean FROM ba GROUP BY 1),
l0 AS (SELECT se.*, se.prediction - pm.pmean AS shap FROM se JOIN pm USING (model_id)
       WHERE ts >= TIMESTAMP '2024-01-11'),
li AS (SELECT * FROM l0)"""

# Batches with one group, or too many, are rejected before any vital is computed.
VALID = """li AS (SELECT * FROM l0 WHERE (model_id, batch) IN (
         SELECT (model_id, batch) FROM l0 GROUP BY model_id, batch
         HAVING count(DISTINCT event_type) BETWEEN 2 AND 20)),
fb AS (SELECT DISTINCT model_id, batch FROM l0 EXCEPT SELECT DISTINCT model_id, batch FROM li)"""

LINEITEM = """sl AS (
  SELECT l_orderkey, l_linenumber, l_shipdate AS ts, l_linestatus AS model_id,
         strftime(l_shipdate, '%Y-%m') AS batch, l_suppkey, l_quantity, l_extendedprice, l_discount,
         l_tax, l_returnflag, l_discount * 10 + 0.0 AS prediction
  FROM lineitem),
ba AS (SELECT * FROM sl WHERE ts < TIMESTAMP '1998-01-01'),
li AS (SELECT * FROM sl WHERE ts >= TIMESTAMP '1998-01-01')"""


def _melt(source: str, features: list[str], keep: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{f}' AS feature, {f} AS x FROM {source}" for f in features
    )


def profile(features: list[str]) -> str:
    """st: statistics per feature; ed: bin edges; pb: baseline shares; needs ba."""
    return f"""bf AS ({_melt("ba", features, "model_id")}),
st AS (SELECT model_id, feature, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std,
              min(x) AS lo, max(x) AS hi FROM bf GROUP BY 1, 2),
ed AS (SELECT model_id, feature, i, i * ((hi - lo) / 10) + lo AS e0,
              CASE WHEN i = 9 THEN hi ELSE (i + 1) * ((hi - lo) / 10) + lo END AS e1
       FROM st, range(10) r(i)),
pb AS (SELECT ed.model_id, ed.feature, ed.i,
              count(bf.x) / any_value(st.n) AS p
       FROM ed JOIN st USING (model_id, feature)
       LEFT JOIN bf ON bf.model_id = ed.model_id AND bf.feature = ed.feature AND bf.x >= ed.e0
            AND (bf.x < ed.e1 OR (ed.i = 9 AND bf.x = ed.e1))
       GROUP BY 1, 2, 3)"""


def drift(features: list[str]) -> str:
    """fe: psi, linf, ood and ood_band per (batch, feature); needs ba and li."""
    return f"""{profile(features)},
lf AS ({_melt("li", features, "model_id, batch")}),
fs AS (SELECT lf.model_id, lf.batch, lf.feature, count(*) AS n,
              max(abs(x - mean)) / (any_value(std) + 1e-6) AS linf,
              count(*) FILTER (abs((x - mean) / (std + 1e-6)) > 3) / count(*) AS ood,
              count(*) FILTER (std <> 0 AND (x < mean - 3 * std OR x > mean + 3 * std)) / count(*)
                AS ood_band
       FROM lf JOIN st USING (model_id, feature) GROUP BY 1, 2, 3),
qb AS (SELECT lf.model_id, lf.batch, lf.feature, ed.i, count(*) AS c
       FROM lf JOIN ed ON lf.model_id = ed.model_id AND lf.feature = ed.feature AND lf.x >= ed.e0
            AND (lf.x < ed.e1 OR (ed.i = 9 AND lf.x = ed.e1))
       GROUP BY 1, 2, 3, 4),
sh AS (SELECT fs.model_id, fs.batch, fs.feature,
              CASE WHEN pb.p = 0 THEN 1e-6 ELSE pb.p END AS p,
              CASE WHEN coalesce(qb.c, 0) = 0 THEN 1e-6 ELSE qb.c / fs.n END AS q
       FROM fs JOIN pb USING (model_id, feature)
       LEFT JOIN qb USING (model_id, batch, feature, i)),
ps AS (SELECT model_id, batch, feature, sum((q - p) * ln(q / p)) AS psi FROM sh GROUP BY 1, 2, 3),
fe AS (SELECT fs.*, ps.psi FROM fs JOIN ps USING (model_id, batch, feature))"""


GINI = """gn AS (
  SELECT model_id, batch, CASE WHEN sum(prediction) = 0 THEN 0.0 ELSE
         sum((2 * rn - n - 1) * prediction) / (any_value(n) * sum(prediction)) END AS gini
  FROM (SELECT model_id, batch, prediction,
               row_number() OVER (PARTITION BY model_id, batch ORDER BY prediction) AS rn,
               count(*) OVER (PARTITION BY model_id, batch) AS n FROM li)
  GROUP BY 1, 2)"""


def privacy(quasi: str) -> str:
    return f"""pv AS (
  SELECT model_id, batch, 1 - count(*) FILTER (c = 1) / sum(c) AS privacy_score
  FROM (SELECT model_id, batch, {quasi}, count(*) AS c FROM li GROUP BY ALL) GROUP BY 1, 2)"""


def parity(group: str) -> str:
    return f"""pa AS (
  SELECT model_id, batch, CASE WHEN count(*) < 2 THEN 0.0 ELSE max(m) - min(m) END
         AS statistical_parity
  FROM (SELECT model_id, batch, {group}, avg(prediction) AS m FROM li GROUP BY ALL) GROUP BY 1, 2)"""


SHAP = """sp AS (
  SELECT model_id, batch, CASE WHEN any_value(t) = 0 THEN 0.0 ELSE
         any_value(t) / any_value(n) / (any_value(mx) + 1e-6)
         * (-sum(v / t * ln(v / t + 1e-9))) / ln(any_value(n) + 1e-9) END AS shap_importance
  FROM (SELECT model_id, batch, abs(shap) AS v, sum(abs(shap)) OVER w AS t,
               max(abs(shap)) OVER w AS mx, count(*) OVER w AS n
        FROM li WINDOW w AS (PARTITION BY model_id, batch))
  GROUP BY 1, 2)"""

SUMMARY = """bs AS (
  SELECT model_id, 'gini' AS metric, avg(prediction) AS mean, stddev_pop(prediction) AS std
  FROM ba GROUP BY 1
  UNION ALL
  SELECT model_id, metric, mean, std FROM (SELECT DISTINCT model_id FROM ba),
    (VALUES ('psi', 0.1::DOUBLE, 0.05::DOUBLE), ('linf', 0.2, 0.1), ('ood_score', 0.1, 0.05),
            ('privacy_score', 0.7, 0.1), ('statistical_parity', 0.2, 0.1),
            ('shap_importance', 0.5, 0.2)) d(metric, mean, std))"""

EVENT_FEATURES = ["value", "k"]

# mt: all seven vitals of the live events, long.
METRICS = f"""{EVENTS},
{drift(EVENT_FEATURES)},
{GINI},
{privacy("user_id, event_type")},
{parity("event_type")},
{SHAP},
dm AS (SELECT model_id, batch, least(avg(psi), 1.0) AS psi, avg(linf) AS linf,
              avg(ood) AS ood_score FROM fe GROUP BY 1, 2),
mt AS (SELECT model_id, batch, 'gini' AS metric, gini AS value FROM gn
  UNION ALL SELECT model_id, batch, 'privacy_score', privacy_score FROM pv
  UNION ALL SELECT model_id, batch, 'statistical_parity', statistical_parity FROM pa
  UNION ALL SELECT model_id, batch, 'shap_importance', shap_importance FROM sp
  UNION ALL SELECT model_id, batch, 'psi', psi FROM dm
  UNION ALL SELECT model_id, batch, 'linf', linf FROM dm
  UNION ALL SELECT model_id, batch, 'ood_score', ood_score FROM dm)"""

# mt: the three vitals that need no profile; enough to show how grading works.
SHORT_METRICS = f"""{EVENTS},
{GINI},
{privacy("user_id, event_type")},
{parity("event_type")},
mt AS (SELECT model_id, batch, 'gini' AS metric, gini AS value FROM gn
  UNION ALL SELECT model_id, batch, 'privacy_score', privacy_score FROM pv
  UNION ALL SELECT model_id, batch, 'statistical_parity', statistical_parity FROM pa)"""


def raw_grade(
    domain: str = "'standard'",
    direction: str = "CASE mt.metric WHEN 'linf' THEN 'lower' ELSE 'upper' END",
    summary: str = "bs",
) -> str:
    """gj: joined with the baseline; gr: with the raw status. Needs mt and the summary."""
    return f"""gj AS (
  SELECT mt.model_id, mt.batch, mt.metric, mt.value, b.mean, b.std, {domain} AS domain,
         {direction} AS direction
  FROM mt LEFT JOIN {summary} b ON b.model_id = mt.model_id AND b.metric = mt.metric),
gk AS (SELECT *, CASE domain WHEN 'healthcare' THEN 2.0::DOUBLE WHEN 'finance' THEN 2.5
                      WHEN 'standard' THEN 3.0 END AS k,
              CASE domain WHEN 'healthcare' THEN 0 WHEN 'finance' THEN 1 WHEN 'standard' THEN 3 END
                AS need FROM gj),
gr AS (SELECT *, CASE
    WHEN mean IS NULL THEN 'no_baseline'
    WHEN k IS NULL THEN NULL
    WHEN std = 0 THEN 'normal'
    WHEN direction = 'upper' THEN CASE WHEN value > mean + k * std THEN 'critical'
         WHEN value > mean + (k - 1) * std THEN 'warning' ELSE 'normal' END
    WHEN direction = 'lower' THEN CASE WHEN value < mean - k * std THEN 'critical'
         WHEN value < mean - (k - 1) * std THEN 'warning' ELSE 'normal' END
    WHEN direction = 'two-sided' THEN CASE
         WHEN value > mean + k * std OR value < mean - k * std THEN 'critical'
         WHEN value > mean + (k - 1) * std OR value < mean - (k - 1) * std THEN 'warning'
         ELSE 'normal' END END AS raw FROM gk)"""


def persisted(partition: str = "model_id, metric") -> str:
    """ge: final status; needs gr."""
    return f"""gf AS (
  SELECT *, coalesce(count(*) FILTER (raw IN ('warning', 'critical')) OVER (
              PARTITION BY {partition} ORDER BY batch ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), 0)
              AS f1,
         coalesce(count(*) FILTER (raw IN ('warning', 'critical')) OVER (
              PARTITION BY {partition} ORDER BY batch ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0)
              AS f3 FROM gr),
ge AS (SELECT *, CASE
    WHEN raw IS NULL OR raw NOT IN ('warning', 'critical') OR need = 0 THEN raw
    WHEN value > mean + k * 3 * std THEN 'critical'
    WHEN (CASE need WHEN 1 THEN f1 ELSE f3 END) < need THEN 'warning'
    ELSE 'critical' END AS status FROM gf)"""


OVERALL = """ov AS (
  SELECT model_id, batch, CASE
    WHEN bool_or(status = 'critical') THEN 'critical'
    WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'normal' END AS status
  FROM ge GROUP BY 1, 2)"""

GRADED = f"""{METRICS},
{SUMMARY},
{raw_grade()},
{persisted()},
{OVERALL}"""

# rq: state requests of all batches, the rejected ones included.
ACCEPTED = GRADED.replace("li AS (SELECT * FROM l0)", VALID) + """,
rq AS (SELECT model_id, batch, CASE status WHEN 'normal' THEN 'green' ELSE status END AS req FROM ov
       UNION ALL SELECT model_id, batch, 'critical' FROM fb)"""

RECORD = f"""{ACCEPTED},
vr AS (SELECT ge.model_id, ge.batch,
    coalesce(max(value) FILTER (metric = 'statistical_parity'), 0.85) AS fairness,
    1 - coalesce(max(value) FILTER (metric = 'psi'), 0.08) AS stability,
    CASE any_value(ov.status) WHEN 'normal' THEN 0.95::DOUBLE ELSE 0.68 END AS security,
    coalesce(max(value) FILTER (metric = 'privacy_score'), 0.9) AS privacy,
    coalesce(max(value) FILTER (metric = 'gini'), 0.45) AS transparency,
    any_value(ov.status) AS status
  FROM ge JOIN ov USING (model_id, batch) GROUP BY 1, 2)"""

GRAPH = """nd AS (
  SELECT 'region_' || r_regionkey AS node, 'region' AS owner FROM region
  UNION ALL SELECT 'nation_' || n_nationkey, 'nation' FROM nation
  UNION ALL SELECT 'customer_' || c_custkey, 'customer' FROM customer
  UNION ALL SELECT 'order_' || o_orderkey, 'orders' FROM orders),
eg AS (
  SELECT 'region_' || n_regionkey AS src, 'nation_' || n_nationkey AS dst, 1.0::DOUBLE AS weight
  FROM nation
  UNION ALL SELECT 'nation_' || c_nationkey, 'customer_' || c_custkey, (c_custkey % 10) / 10
  FROM customer
  UNION ALL SELECT 'customer_' || o_custkey, 'order_' || o_orderkey, (o_orderkey % 10) / 10
  FROM orders)"""

NODE_EVENTS = """ne AS (
  SELECT event_type AS node, ts, event_id AS seq,
         CASE WHEN value >= 60 THEN 'critical' WHEN value >= 40 THEN 'warning' ELSE 'green' END
           AS req_status
  FROM events)"""
