"""Only tables that were counted go to every executor: small files say little about the rows in them.

A join that Spark turns into a broadcast by itself shows by a plan that changes with its threshold.
"""

import pytest

from modelpulse.functions import joins, storage
from modelpulse.operators import graph
from modelpulse.plans import graph_queries

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Five regions, 25 nations, 100 customers and 400 orders."""
    at = tmp_path_factory.mktemp("tables")
    rows = {
        "region": (range(5), "id as r_regionkey"),
        "nation": (range(25), "id as n_nationkey, id % 5 as n_regionkey"),
        "customer": (range(100), "id as c_custkey, id % 25 as c_nationkey, id * 37D % 2000 - 600 as c_acctbal"),
        "orders": (range(400), "id as o_orderkey, id * 7 % 100 as o_custkey"),
    }
    for name, (ids, columns) in rows.items():
        spark.range(len(ids)).selectExpr(*columns.split(", ")).write.parquet(str(at / f"{name}.parquet"))
    return str(at)


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def told(spark, monkeypatch, threshold, run):
    """Broadcasts in the plans of all tables that are settled on the way and of the result; its rows."""
    found, write = [], storage._write
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, threshold)
    try:
        with monkeypatch.context() as m:
            m.setattr(storage, "_write", lambda df, path: found.append(broadcasts(df)) or write(df, path))
            out = run()
        return [*found, broadcasts(out)], sorted(map(str, out.collect()))
    finally:
        spark.conf.set(THRESHOLD, before)


@pytest.mark.parametrize("join", ["lookup_join", "even_join"])
def test_copies_for_salts_are_not_broadcast(spark, monkeypatch, join):
    left = storage.settle_rows(spark.range(300).selectExpr("id % 3 as k", "id"))
    right = storage.settle_rows(spark.range(3).selectExpr("id as k", "id * 10 as v"))
    much = {"limit": 0, "rows": 3} if join == "lookup_join" else {"hot": 10}
    run = lambda: getattr(joins, join)(left, right, ["k"], **much)
    plans, rows = told(spark, monkeypatch, "10m", run)
    assert (plans, rows) == told(spark, monkeypatch, "-1", run) and len(rows) == 300


@pytest.mark.parametrize("name", ["inject_failure", "propagate_impact", "graph_trace_json", "trace_nodes", "trace_nodes_edges"])
def test_spread_broadcasts_counted_tables_only(spark, tables, monkeypatch, name):
    how, spread, _, salts, rows = joins.lookup_join.__defaults__
    monkeypatch.setattr(joins.lookup_join, "__defaults__", (how, spread, 0, salts, rows))
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    run = lambda: getattr(graph_queries, name)(spark, tables)
    plans, rows = told(spark, monkeypatch, "10m", run)
    assert (plans, rows) == told(spark, monkeypatch, "-1", run) and len(rows) >= 400
