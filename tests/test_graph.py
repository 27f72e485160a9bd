"""Node states, spread of failures, integrity, heartbeats and traces."""

import random

import pytest
from pyspark.sql import functions as F

from modelpulse.operators import contraction, cycles, graph, reporting
from modelpulse.operators.cycles import strong_components

EVENTS = "node string, seq int, req_status string"


def stepwise(requests):
    """Node statuses request by request, with the pending green kept in a history."""
    status, history, out = "green", [], []
    for req in requests:
        if req == "reset":
            status = "green"
        elif status == "critical" and req == "green" and (not history or history[-1] != "green"):
            history.append("green")
        else:
            status = req
            history.append(req)
        out.append(status)
    return out


@pytest.mark.parametrize("block", [2, 100_000])
def test_hysteresis_equals_steps(spark, block, monkeypatch):
    monkeypatch.setattr(graph.overlapped, "__defaults__", (block,))
    random.seed(block)
    kinds = ["green", "green", "critical", "warning", "grey", "locked", "reset"]
    data, wanted = [], {}
    for n in range(40):
        requests = [random.choice(kinds) for _ in range(25)]
        data += [(f"n{n}", i, r) for i, r in enumerate(requests)]
        wanted.update({(f"n{n}", i): s for i, s in enumerate(stepwise(requests))})
    df = spark.createDataFrame(data, EVENTS)
    out = graph.node_status(df, ["seq"]).collect()
    assert {(r.node, r.seq): r.status for r in out} == wanted
    last = {r.node: r.status for r in graph.current_status(df, ["seq"]).collect()}
    assert last == {f"n{n}": wanted[(f"n{n}", 24)] for n in range(40)}


def spread(spark, status, edges, seeds):
    s = spark.createDataFrame(status, "node string, status string")
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    d = spark.createDataFrame([(x,) for x in seeds], "node string")
    return {r.node: r.status for r in graph.propagate(s, e, d).collect()}


def test_spread_over_strong_edges(spark):
    out = spread(
        spark,
        [(n, "green") for n in "ABCDEF"],
        [("A", "B", 0.9), ("B", "C", 0.3), ("A", "D", 0.8), ("D", "E", 0.5), ("C", "F", 1.0)],
        ["A"],
    )
    assert out == {"A": "critical", "B": "critical", "C": "green", "D": "critical", "E": "critical", "F": "green"}


def test_spread_continues_with_own_status(spark):
    out = spread(
        spark,
        [("A", "green"), ("B", "warning"), ("C", "green"), ("D", "critical"), ("E", "green"), ("Z", "warning"), ("Y", "green")],
        [("A", "B", 0.1), ("B", "C", 0.7), ("A", "D", 0.2), ("D", "E", None), ("C", "E", 0.9), ("Z", "Y", 1.0)],
        ["A"],
    )
    # Y is below no critical node, so its warning parent does not reach it.
    assert out == {"A": "critical", "B": "warning", "C": "warning", "D": "critical", "E": "critical", "Z": "warning", "Y": "green"}


def walked(status, edges, seeds):
    """Fixpoint of the rule over all descendants of the seeds."""
    rank = {"critical": 3, "warning": 2}
    active, todo = set(seeds), list(seeds)
    while todo:
        node = todo.pop()
        for a, b, _ in edges:
            if a == node and b not in active:
                active.add(b)
                todo.append(b)
    level = {n: 3 if n in seeds else rank.get(status[n], 1) for n in active}
    changed = True
    while changed:
        changed = False
        for a, b, w in edges:
            if a in active and w >= 0.5 and level[a] > level[b]:
                level[b], changed = level[a], True
    return {n: {3: "critical", 2: "warning"}.get(level.get(n, 0), s) for n, s in status.items()}


@pytest.mark.parametrize("limit", [0, 200_000])
def test_spread_on_random_graphs_with_cycles(spark, limit, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", limit)
    random.seed(11)
    names = [f"n{i}" for i in range(40)]
    status = {n: random.choice(["green"] * 5 + ["warning", "critical", "grey"]) for n in names}
    pairs = {(random.choice(names), random.choice(names)) for _ in range(60)}
    edges = [(a, b, random.choice([0.2, 0.5, 0.9])) for a, b in pairs]
    seeds = {"n0", "n7"}
    assert spread(spark, list(status.items()), edges, seeds) == walked(status, edges, seeds)


def test_spread_down_a_chain_keeps_its_plans_small(spark, monkeypatch):
    monkeypatch.setattr(graph, "STATE_TABLES", 3)
    monkeypatch.setattr(graph, "PLAIN_ROUNDS", 100)
    names = [f"n{i:02d}" for i in range(20)]
    edges = [(a, b, 0.9) for a, b in zip(names, names[1:])] + [("n15", "n02", 0.9)]
    out = spread(spark, [(n, "green") for n in [*names, "z"]], edges, ["n00"])
    assert out == {**{n: "critical" for n in names}, "z": "green"}


def deep(rng, kind):
    """(edges, seeds) of a graph that a spread does not cross in a few rounds."""
    weight = lambda: rng.choice([0.2, 0.9, 0.9, 0.9])
    if kind == "tree":
        pairs = [(rng.randrange(max(0, i - 3), i), i) for i in range(1, 60)]
    elif kind == "diamonds":
        pairs = [p for i in range(0, 45, 3) for p in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3))]
    elif kind == "ladder":
        pairs = [(i, i + j) for i in range(0, 30) for j in (1, 2, 3)]
    elif kind == "rings":
        pairs = [(i, (i + 1) % 20) for i in range(20)] + [(30 + i, 30 + (i + 1) % 9) for i in range(9)]
        pairs += [(35, 7), (60, 8), (61, 60), (12, 13), (13, 12), (9, 4), (15, 50), (50, 51), (51, 15), (50, 50)]
    else:
        pairs = [(i, i + 1) for i in range(25)] + [(rng.randrange(45), rng.randrange(45)) for _ in range(35)]
    return [(f"n{a}", f"n{b}", weight()) for a, b in set(pairs)], {"n0", f"n{rng.randrange(8)}"}


@pytest.mark.parametrize("kind", ["tree", "diamonds", "ladder", "rings", "random"])
def test_spread_over_shortened_links(spark, kind, monkeypatch):
    monkeypatch.setattr(graph, "PLAIN_ROUNDS", 1)
    rng = random.Random(f"deep {kind}")
    edges, seeds = deep(rng, kind)
    names = sorted({x for a, b, _ in edges for x in (a, b)} | seeds)
    status = {n: rng.choice(["green"] * 8 + ["warning", "critical", "grey"]) for n in names}
    assert spread(spark, list(status.items()), [*edges, (None, "n1", 0.9), ("n1", None, 0.9)], seeds) == walked(status, edges, seeds)


def test_a_long_chain_takes_the_logarithm_of_its_rounds(spark, monkeypatch):
    rounds = []
    plain, doubled = graph._follow, contraction.settle_observed
    monkeypatch.setattr(graph, "_follow", lambda *a: rounds.append("step") or plain(*a))
    monkeypatch.setattr(contraction, "settle_observed", lambda *a, **k: rounds.append("double") or doubled(*a, **k))
    names = [f"n{i:04d}" for i in range(2_000)]
    edges = [(a, b, 0.1 if b == "n1500" else 0.9) for a, b in zip(names, names[1:])]
    status = {n: "warning" if n == "n1600" else "green" for n in names}
    out = spread(spark, list(status.items()), edges, ["n0000"])
    assert out == {n: "critical" if n < "n1500" else "warning" if n >= "n1600" else "green" for n in names}
    assert len(rounds) <= 15, rounds


def test_latest_edge_weight_wins(spark):
    e = spark.createDataFrame([("a", "b", 0.9, 1), ("a", "b", 0.1, 2), ("a", "c", None, 1)], "src string, dst string, weight double, seq int")
    out = {(r.src, r.dst): r.weight for r in graph.latest_edges(e, "seq").collect()}
    assert out == {("a", "b"): 0.1, ("a", "c"): 1.0}


def test_failures_are_attached(spark):
    s = spark.createDataFrame([("a", "green"), ("b", "green")], "node string, status string")
    e = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    f = spark.createDataFrame([("a", "boom")], "node string, failure string")
    out = {r.node: (r.status, r.failure) for r in graph.inject_failures(s, e, f).collect()}
    assert out == {"a": ("critical", "boom"), "b": ("critical", None)}


def test_integrity_and_cycles(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y")], "node string, owner string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "src string, dst string")
    runs = spark.createDataFrame([("q", 1, "green"), ("a", 2, "green")], EVENTS)
    found = {(r.problem, r["item"]) for r in graph.check_graph(nodes, edges, runs).collect()}
    assert found == {
        ("duplicate node", "a"), ("edge endpoint missing", "c"), ("edge endpoint missing", "d"), ("unknown node", "q"),
    }
    assert {(r.node, r.component) for r in strong_components(edges).collect()} == {("b", "b"), ("c", "b")}
    assert strong_components(edges.where("src <> 'c'")).count() == 0


def mutual(edges):
    """Smallest node of all that a node reaches and is reached by."""
    below = {}
    for a, b in edges:
        below.setdefault(a, set()).add(b)
    reached = {}
    for start in {x for e in edges for x in e}:
        seen, todo = set(), list(below.get(start, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += below.get(x, ())
        reached[start] = seen
    return {v: min(u for u in r if v in reached[u]) for v, r in reached.items() if v in r}


_rng = random.Random(6)
GRAPHS = {
    "two cycles and a node between them": [(1, 2), (2, 1), (2, 9), (9, 3), (3, 4), (4, 3)],
    "joined cycles and a loop": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2), (7, 7)],
    "a long chain": [(i, i + 1) for i in range(300)],
    "a ring beside a chain": [(i, (i + 1) % 70) for i in range(70)] + [(i, i + 1) for i in range(200, 290)],
    "a chain that closes a cycle": [(1, 2), (2, 1), (2, 100), *[(i, i + 1) for i in range(100, 150)], (150, 1), (120, 400)],
    "random": [(_rng.randrange(40), _rng.randrange(40)) for _ in range(52)],
    "random and sparse": [(_rng.randrange(60), _rng.randrange(60)) for _ in range(55)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_are_what_reaches_each_other(spark, name):
    edges = [*GRAPHS[name], *GRAPHS[name][:2], (None, 1), (1, None)]
    found = strong_components(spark.createDataFrame(edges, "src int, dst int")).collect()
    wanted = mutual(GRAPHS[name])
    assert {r.node: r.component for r in found} == wanted and len(found) == len(wanted)


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    """Doubling settles a few dozen tables for a chain of a thousand nodes between two cycles."""
    rounds = []
    real = cycles.settle_counted
    monkeypatch.setattr(cycles, "settle_counted", lambda df: rounds.append(1) or real(df))
    edges = [(-2, -1), (-1, -2), (-1, 0), *[(i, i + 1) for i in range(1_000)], (1_000, 2_000), (2_000, 1_000)]
    out = strong_components(spark.createDataFrame(edges, "src int, dst int")).collect()
    assert {(r.node, r.component) for r in out} == {(-2, -2), (-1, -2), (1_000, 1_000), (2_000, 1_000)}
    assert len(rounds) <= 50


def test_invalid_requests(spark):
    df = spark.createDataFrame([("a", 1, "purple"), ("a", 2, "green")], EVENTS)
    assert graph.invalid_requests(df).count() == 1


def test_adjacency_pages(spark):
    edges = spark.createDataFrame([("hub", f"n{i:03d}") for i in range(25)], "src string, dst string")
    out = graph.adjacency(edges, page=10).where("node = 'hub'").orderBy("page_no").collect()
    assert [len(r.neighbours) for r in out] == [10, 10, 5]


def test_heartbeats(spark):
    rows = [("a", 0), ("a", 600), ("b", 0), ("b", 100), ("b", 701), ("b", 1400)]
    events = spark.createDataFrame(rows, "node string, seq int").withColumn("ts", F.timestamp_seconds("seq"))
    nodes = spark.createDataFrame([("a",), ("b",), ("never",)], "node string")
    late = graph.heartbeat_timeouts(nodes, events, F.timestamp_seconds(F.lit(1201)), 600)
    assert [r.node for r in late.collect()] == ["a"]
    exact = graph.heartbeat_timeouts(nodes, events, F.timestamp_seconds(F.lit(1200)), 600)
    assert exact.count() == 0
    gaps = graph.heartbeat_gaps(events, 600).collect()
    assert len(gaps) == 2 and {g.node for g in gaps} == {"b"}
    periods = graph.activity_periods(events, 600).groupBy("node").count().collect()
    assert {r.node: r["count"] for r in periods} == {"a": 1, "b": 3}


def test_trace_round_trip(spark):
    nodes = spark.createDataFrame([("Event_Intake", "x"), ("Model", "y")], "node string, owner string")
    edges = spark.createDataFrame([("Event_Intake", "Model")], "src string, dst string")
    status = spark.createDataFrame([("Event_Intake", "critical", '{"psi": {"value": 0.5}}')], "node string, status string, metrics string")
    doc = graph.trace_document(nodes, edges, status)
    text = doc.first().trace
    assert '"metrics":{"psi":{"value":0.5}}' in text
    rows = {r.name: (r.label, r.status, r.alert) for r in reporting.trace_nodes(doc).collect()}
    assert rows == {"Event_Intake": ("Event Intake", "critical", True), "Model": ("Model", "green", False)}
    edge = reporting.trace_edges(doc).first()
    assert (edge.id, edge.alert) == ("e-Event_Intake-Model", True)
    with pytest.raises(ValueError):
        graph.trace_document(nodes, edges, status, limit=1)


def test_requests(spark):
    overall = spark.createDataFrame([("m", 1, "normal"), ("m", 2, "critical")], "model_id string, batch int, status string")
    failed = spark.createDataFrame([("m", 3, ("crash",))], "model_id string, batch int, failure struct<message: string>")
    out = graph.node_requests(overall, failed, ["model_id", "batch"], F.col("model_id"), F.col("batch"))
    rows = {r.seq: (r.req_status, r.system_failure) for r in out.collect()}
    assert rows == {1: ("green", None), 2: ("critical", None), 3: ("critical", '{"message":"crash"}')}


def test_requests_of_one_kind_and_latency(spark):
    nodes = spark.createDataFrame([("a",)], "node string")
    both = graph.lock_requests(nodes, F.lit(1)).unionByName(graph.reset_requests(nodes, F.lit(2)))
    out = {r.seq: r.status for r in graph.node_status(both, ["seq"]).collect()}
    assert out == {1: "locked", 2: "green"}
    df = spark.createDataFrame([("m", float(i)) for i in range(1, 101)], "m string, ms double")
    row = reporting.latency_quantiles(df, "ms", ["m"]).first()
    assert (row.p50, row.p95) == (50.0, 95.0)
    stats = reporting.latency_stats(df, "ms", ["m"], 90.0).first()
    assert (stats.records, stats.slow, stats.max_ms, stats.latency_ms) == (100, 10, 100.0, 50.5)


def test_only_nodes_with_several_pages_are_numbered(spark, monkeypatch):
    numbered = []
    whole = graph.number_rows
    monkeypatch.setattr(graph, "number_rows", lambda df, *a: numbered.append(df.count()) or whole(df, *a))
    links = [("hub", f"n{i:02d}") for i in range(25)] + [(f"n{i:02d}", f"m{i:02d}") for i in range(25)] * 2
    edges = spark.createDataFrame(links, "src string, dst string")
    found = {(r.node, r.side, r.page_no): r.neighbours for r in graph.adjacency(edges, page=10).collect()}
    assert numbered == [25]
    assert [len(found["hub", "downstream", p]) for p in range(3)] == [10, 10, 5]
    assert found["n03", "upstream", 0] == ["hub"] and found["n03", "downstream", 0] == ["m03"]
    assert len(found) == 3 + 25 * 3


def test_trace_documents_of_every_form_are_read(spark):
    entry = '{"a_b":{"name":"a_b","owner":"nodes","status":"warning","upstream":[],"downstream":["c"]}}'
    quoted = entry.replace('"', '\\"')
    docs = [entry, f'{{"nodes":{entry}}}', f'{{"at":1,"nodes":{entry}}}', f'{{"nodes":"{quoted}"}}']
    for doc in docs:
        rows = reporting.trace_nodes(spark.createDataFrame([(doc,)], "trace string")).collect()
        assert [(r.name, r.label, r.owner, r.alert, r.downstream) for r in rows] == [("a_b", "a b", "nodes", True, ["c"])]
