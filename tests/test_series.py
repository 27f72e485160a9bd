"""Status over time across the graph, against a walk through all moments one after the other."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from modelpulse.operators import series

START = datetime(2024, 1, 1)


class Watched:
    """A node that takes requests one by one."""

    def __init__(self):
        self.status, self.last = "green", None

    def ask(self, status):
        held = status == "green" and self.last == "critical"
        self.last = status
        self.status = "critical" if held else "green" if status == "reset" else status

    def hand_down(self, status):
        if status == "critical":
            self.ask("critical")
        elif self.status != "critical":
            self.status = "warning"


def step_by_step(requests, edges):
    """All moments in order; a walk meets the nodes below in an order that parents come first."""
    below = {}
    for a, b, w in edges:
        below.setdefault(a, []).append((b, w))
    depth = {}

    def set_depth(node, d):
        if depth.get(node, -1) < d:
            depth[node] = d
            for b, _ in below.get(node, []):
                set_depth(b, d + 1)

    for node in [*below, *[b for _, b, _ in edges], *[r[0] for r in requests]]:
        set_depth(node, depth.get(node, 0))
    nodes, out = {n: Watched() for n in depth}, {}
    for node, ts, seq, req in sorted(requests, key=lambda r: (r[1], r[2], r[0])):
        nodes[node].ask(req)
        out[node, ts, seq, node] = (req, None, nodes[node].status)
        if req != "critical":
            continue
        met, todo = {node}, [node]
        for n in todo:
            for b, _ in below.get(n, []):
                if b not in met:
                    met.add(b)
                    todo.append(b)
        for n in sorted(met - {node}, key=lambda n: depth[n]):
            got = [nodes[a].status for a, b, w in edges if b == n and a in met and (1.0 if w is None else w) >= 0.5]
            worst = "critical" if "critical" in got else "warning" if "warning" in got else None
            if worst:
                nodes[n].hand_down(worst)
                out[n, ts, seq, node] = (None, worst, nodes[n].status)
    return out


def told(spark, requests, edges):
    r = spark.createDataFrame(requests, "node string, ts timestamp, seq bigint, req_status string")
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    rows = series.status_series(r, e).collect()
    found = {(x.node, x.ts, x.seq, x.origin): (x.request, x.passed, x.status) for x in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_series_equals_walking_moment_by_moment(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(14)]
    pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(22)}
    edges = [(a, b, rng.choice([0.2, 0.5, 0.9, None])) for a, b in sorted(pairs)]
    kinds = ["green"] * 4 + ["warning", "warning", "critical", "critical", "grey", "reset", "locked"]
    requests = [
        (rng.choice(names[:10]), START + timedelta(minutes=rng.randrange(60)), i, rng.choice(kinds)) for i in range(120)
    ]
    assert told(spark, requests, edges) == step_by_step(requests, edges)


def test_a_weak_edge_is_walked_on(spark):
    at = lambda m: START + timedelta(minutes=m)
    edges = [("a", "b", 0.1), ("b", "c", 1.0), ("c", "d", 0.9)]
    requests = [
        ("b", at(0), 1, "warning"), ("c", at(1), 2, "green"), ("a", at(2), 3, "critical"), ("c", at(3), 4, "green"),
        ("d", at(4), 5, "green"), ("b", at(5), 6, "critical"), ("d", at(6), 7, "green"), ("d", at(7), 8, "green"),
    ]
    found = told(spark, requests, edges)
    assert found == step_by_step(requests, edges)
    assert found["c", at(2), 3, "a"] == (None, "warning", "warning")
    assert found["d", at(6), 7, "d"][2] == "critical" and found["d", at(7), 8, "d"][2] == "green"


def test_cycles_are_refused_and_nothing_gives_nothing(spark):
    r = spark.createDataFrame([("a", START, 1, "critical")], "node string, ts timestamp, seq bigint, req_status string")
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    with pytest.raises(ValueError, match="cycle"):
        series.status_series(r, e)
    alone = series.status_series(r, e.limit(0)).collect()
    assert [(x.node, x.status) for x in alone] == [("a", "critical")]
    assert series.status_series(r.limit(0), e.limit(1)).count() == 0


def test_silences_ask_for_grey(spark):
    rows = [("a", START), ("a", START + timedelta(minutes=5)), ("a", START + timedelta(minutes=40)), ("b", START)]
    events = spark.createDataFrame(rows, "node string, ts timestamp")
    until = F.lit(START + timedelta(minutes=45))
    found = series.silence_requests(events, 600, until, F.lit(-1).cast("bigint")).collect()
    late = timedelta(minutes=10, microseconds=1)
    assert {(r.node, r.ts) for r in found} == {("a", rows[1][1] + late), ("b", START + late)}
    assert {r.req_status for r in found} == {"grey"}


def test_nodes_that_are_alike_are_walked_once(spark, monkeypatch):
    walked = []
    whole = series._unasked_statuses
    monkeypatch.setattr(series, "_unasked_statuses", lambda rows, moment: walked.append(rows.count()) or whole(rows, moment))
    monkeypatch.setattr(series, "SHARE", 7)
    at = lambda m: START + timedelta(minutes=m)
    # Forty children of a, half of them over weak links, each with two children; one child asks itself.
    edges = [("a", f"b{i:02d}", 0.9 if i % 2 else 0.1) for i in range(40)]
    edges += [(f"b{i:02d}", f"c{i:02d}{k}", w) for i in range(40) for k, w in enumerate((0.8, 0.7))]
    edges += [("b06", "d", 0.9), ("b07", "d", 0.2), ("d", "e", 0.6), ("b09", "e", 0.1)]
    kinds = ["critical", "green", "warning", "critical", "green", "green", "critical", "reset"]
    requests = [("a", at(2 * i), i, k) for i, k in enumerate(kinds)]
    requests += [("b05", at(2 * i + 1), i, k) for i, k in enumerate(["warning", "critical", "green", "green", "reset"])]
    assert told(spark, requests, edges) == step_by_step(requests, edges)
    assert sum(walked) < 40


def test_a_link_without_an_end_is_no_link(spark):
    requests = [("a", START, 1, "critical")]
    links = [("a", "b", 0.9), (None, "b", 0.9), ("a", None, 0.9)]
    assert told(spark, requests, links) == step_by_step(requests, links[:1])
