"""Status of every node of a dependency graph over time, failures and silences included.

Requests come in order of their moment (order columns, then the node they began at). A node that
asks for a critical state starts a walk at that moment: over strong edges a critical node makes
its children critical and a warning node makes them warn, and the walk goes on below every child
with the status the child then has. What a node gets from its parents stands among its own
requests, at the moment of the walk.

Levels of the graph are worked through from the top, so all that the parents of a node hand down
is known before the node is looked at: rounds carry lists of moments, and there are as many as
the graph is deep. Inside a level, positions are running totals, so neither a node with very many
moments nor one with very many children sits in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelpulse.functions.joins import even_join, lookup_join
from modelpulse.functions.ordering import overlapped, own_rows, running_totals
from modelpulse.functions.storage import scratch_path, settle, settle_counted, settle_rows
from modelpulse.operators.graph import CRITICAL, STRONG, WARNING, activity_periods, latest_edges

ORIGIN = "origin"
#: Nodes that are alike get the rows of their representative in shares of this many.
SHARE = 1_000


def silence_requests(
    events: DataFrame, timeout_seconds: float, until: Column, seq: Column
) -> DataFrame:
    """Requests for grey (node, ts, seq, req_status) at the moments when nodes have been silent for
    longer than the timeout, up to `until`. Nodes that were never seen ask for nothing."""
    periods = activity_periods(events.select("node", "ts"), timeout_seconds)
    moment = F.col("grey_at").cast(events.schema["ts"].dataType)
    return periods.where(F.col("grey_at") <= until.cast("timestamp")).select(
        "node", moment.alias("ts"), seq.alias("seq"), F.lit("grey").alias("req_status")
    )


def graph_levels(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, level) of the ends of edges, a node one level below its lowest parent; and the depth.

    Rounds take off the edges that begin at nodes without open parents. A graph with a cycle has
    no levels and is refused; `strong_components` names its cycles.
    """
    left, size = settle_counted(edges.select("src", "dst").distinct())
    ends = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    levels, depth = [], 0
    open_nodes = settle_rows(ends)
    while size:
        below = left.select(F.col("dst").alias("node")).distinct()
        ready, n = settle_counted(open_nodes.join(below, "node", "left_anti"))
        if not n:
            raise ValueError("the graph has a cycle, so its nodes have no order")
        levels.append(ready.withColumn("level", F.lit(depth)))
        open_nodes = settle_rows(open_nodes.join(ready, "node", "left_anti"))
        left, size = settle_counted(left.join(ready.withColumnRenamed("node", "src"), "src", "left_anti"))
        depth += 1
    levels.append(open_nodes.withColumn("level", F.lit(depth)))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return settle_rows(out), depth


def _statuses(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add the status of a node after each of its moments (node, order, own, passed, visited).

    `own` is a request of the node itself, `passed` the level its parents hand down. Own requests
    and passed critical ones decide: one green after a critical is held. A passed warning counts
    until the next deciding request, unless the node is critical. So a moment needs the last
    deciding request, the one before that, and whether a warning was passed since.
    """
    decides = F.col("own").isNotNull() | (F.col("passed") == CRITICAL)
    decides = F.coalesce(decides, F.lit(False))
    warns = ~decides & F.coalesce(F.col("passed") == WARNING, F.lit(False))
    one = lambda c: c.cast("bigint")
    placed = settle_rows(
        running_totals(rows, ["node"], list(order), {"_decided": one(decides), "_warned": one(warns)})
    )
    request = F.coalesce("own", F.lit("critical"))
    deciding = placed.where(decides).select("node", "_decided", F.col("_warned").alias("_warned_then"), request.alias("_req"))
    before = F.lag("_req").over(Window.partitionBy("node", "_block").orderBy("_decided"))
    held = (F.col("_req") == "green") & (F.coalesce("_before", F.lit("")) == "critical")
    state = F.when(held, "critical").when(F.col("_req") == "reset", "green").otherwise(F.col("_req"))
    numbered = own_rows(overlapped(deciding, "_decided", 1).withColumn("_before", before))
    base = numbered.select(
        "node", (F.col("_decided") + 1).alias("_last"), "_warned_then", state.alias("_state")
    )
    here = placed.withColumn("_last", F.col("_decided") + one(decides)).withColumn("_since", F.col("_warned") + one(warns))
    joined = here.join(base, ["node", "_last"], "left")
    warned = F.col("_since") > F.coalesce("_warned_then", F.lit(0))
    status = (
        F.when(F.col("_state") == "critical", "critical")
        .when(warned, "warning")
        .otherwise(F.coalesce("_state", F.lit("green")))
    )
    return joined.select(*rows.columns, status.alias("status"))


def _once(rows: DataFrame, moment: Sequence[str]) -> DataFrame:
    return rows.groupBy("node", *moment).agg(
        F.max("own").alias("own"), F.max("passed").alias("passed"), F.max("visited").alias("visited")
    )


def _unasked_statuses(rows: DataFrame, moment: Sequence[str]) -> DataFrame:
    """`_statuses` of nodes that ask for nothing themselves: what they are handed only makes them worse,
    so the first warning and the first critical moment of a node tell all."""
    at = F.struct(*moment)
    firsts = settle_rows(
        rows.groupBy("node").agg(
            F.min(F.when(F.col("passed") == CRITICAL, at)).alias("_critical"),
            F.min(F.when(F.col("passed") == WARNING, at)).alias("_warning"),
        ).where("_critical is not null or _warning is not null")
    )
    status = F.when(at >= F.col("_critical"), "critical").when(at >= F.col("_warning"), "warning").otherwise("green")
    joined = lookup_join(rows, firsts, ["node"], "left", spread_by=moment)
    return joined.select(*rows.columns, status.alias("status"))


# --- nodes that are alike ------------------------------------------------------------------


def _alike(links: DataFrame, levels: DataFrame, depth: int, asking: DataFrame) -> DataFrame | None:
    """(node, rep): nodes that ask for nothing and have one parent, with the smallest node that has the
    same moments. Those are nodes whose parents are alike and whose links are of one strength."""
    ins = links.groupBy(F.col("dst").alias("node")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("src").alias("over"), F.bool_or("strong").alias("strong")
    )
    silent = settle_rows(ins.where("_n = 1").drop("_n").join(asking, "node", "left_anti").join(levels, "node"))
    found: list[DataFrame] = []
    for level in range(1, depth + 1):
        # The one parent of a node is a level above it.
        here = silent.where(F.col("level") == level).drop("level")
        if found:
            above = found[-1].select(F.col("node").alias("over"), "rep")
            named = even_join(here, above, ["over"], "left")
            here = settle_rows(named.select("node", F.coalesce("rep", "over").alias("over"), "strong"))
        least = settle_rows(here.groupBy("over", "strong").agg(F.min("node").alias("rep")))
        met = even_join(here, least, ["over", "strong"])
        found.append(settle_rows(met.select("node", "rep")))
    if not found:
        return None
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _among_representatives(
    links: DataFrame, levels: DataFrame, alike: DataFrame | None
) -> tuple[DataFrame, set[int]]:
    """Links between nodes of which those alike are one, and the levels with nodes of several parents."""
    if alike is not None:
        others = alike.where("node <> rep")
        links = settle_rows(links.join(others.select(F.col("node").alias("dst")), "dst", "left_anti"))
        links = even_join(links, others.select(F.col("node").alias("src"), "rep"), ["src"], "left")
        links = links.groupBy(F.coalesce("rep", "src").alias("src"), "dst").agg(F.bool_or("strong").alias("strong"))
        links = settle_rows(links)
    many = links.groupBy(F.col("dst").alias("node")).count().where("count > 1").join(levels, "node")
    return links, {r["level"] for r in many.select("level").distinct().collect()}


def _of_those_alike(series: DataFrame, alike: DataFrame) -> DataFrame:
    """The rows of representatives for the nodes that are like them. The nodes of one are dealt into
    shares, each with a copy of its rows, so neither many nodes nor their product meet in one task."""
    others = alike.where("node <> rep")
    sizes = others.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARE)).cast("int").alias("_shares"))
    # At most one representative to SHARE nodes has several shares.
    large = F.broadcast(settle(sizes.where("_shares > 1")))
    dealt = others.join(large, "rep", "left").select(
        "rep", F.col("node").alias("_like"),
        F.pmod(F.xxhash64("node"), F.coalesce("_shares", F.lit(1))).cast("int").alias("_share"),
    )
    named = series.withColumnRenamed("node", "rep")
    copies = named.join(large, "rep", "left").select(
        *named.columns, F.explode(F.expr("sequence(0, coalesce(_shares, 1) - 1)")).alias("_share")
    )
    told = copies.join(dealt, ["rep", "_share"])
    return told.select(*[F.col("_like").alias("node") if c == "node" else F.col(c) for c in series.columns])


def status_series(
    requests: DataFrame, edges: DataFrame, order: Sequence[str] = ("ts", "seq"), min_weight: float = STRONG
) -> DataFrame:
    """Every request that reached a node: (node, order columns, origin, request, passed, status).

    `requests` has node, req_status and the order columns, which tell the requests of one node
    apart; nulls in them come first. `request` is the node's own, `passed` the status its parents
    hand down at a moment that began at the node `origin`; `status` is what the node has after it.
    Nodes start green. A 'reset' is green at once. Where several parents hand down at one moment
    the most severe counts, and a passed warning leaves a critical node critical. Nodes without
    edges keep their own requests; edges to unknown nodes are walked like others; a repeated
    edge counts with its weight given last (by `seq`) or else its largest.
    """
    order = list(order)
    moment = [*order, ORIGIN]
    known = latest_edges(edges.where("src is not null and dst is not null"), "seq" if "seq" in edges.columns else None)
    links = settle_rows(known.select("src", "dst", (F.col("weight") >= min_weight).alias("strong")))
    levels, depth = graph_levels(links)
    asking = settle_rows(requests.select("node").distinct())
    alike = _alike(links, levels, depth, asking)
    links, several = _among_representatives(links, levels, alike)
    parents = links.select(F.col("src").alias("node")).distinct().withColumn("_parent", F.lit(True))
    heard = asking.withColumn("_asks", F.lit(True))
    marked = settle_rows(levels.join(parents, "node", "left").join(heard, "node", "left"))
    down, n_links = settle_counted(
        links.join(marked.withColumnRenamed("node", "dst"), "dst").select(
            F.col("src").alias("node"), "dst", "strong", "level", F.coalesce("_parent", F.lit(False)).alias("_parent"),
            F.coalesce("_asks", F.lit(False)).alias("asks"),
        )
    )
    own = requests.select(
        "node", *order, F.col("node").alias(ORIGIN), F.col("req_status").alias("own"),
        F.lit(None).cast("int").alias("passed"), (F.col("req_status") == "critical").alias("visited"),
    )
    own = settle_rows(own.join(levels, "node", "left").withColumn("level", F.coalesce("level", F.lit(0))))
    given: list[DataFrame] = []
    series: list[DataFrame] = []
    for level in range(depth + 1):
        rows = own.where(F.col("level") == level).drop("level")
        quiet = None
        for g in given:
            here = g.where(F.col("level") == level)
            rows = rows.unionByName(here.where("asks").drop("level", "asks"))
            unasked = here.where("not asks").drop("level", "asks")
            quiet = unasked if quiet is None else quiet.unionByName(unasked)
        if level in several:
            # A moment of a node comes once per parent.
            rows = _once(rows, moment)
            quiet = settle_rows(_once(quiet, moment))
        told = settle_rows(_statuses(rows, moment))
        series.append(told.where("own is not null or passed is not null"))
        if quiet is not None:
            unasked = _unasked_statuses(quiet, moment)
            told = told.unionByName(unasked)
            series.append(unasked.where("passed is not null"))
            series.append(_of_those_alike(series[-1], alike))
        if level == depth:
            break
        handed = F.when(F.col("status") == "critical", CRITICAL).when(F.col("status") == "warning", WARNING)
        walks = told.where("visited").select("node", *moment, handed.alias("_handed"))
        met = lookup_join(walks, down, ["node"], spread_by=moment, rows=n_links)
        passed = met.withColumn("passed", F.when(F.col("strong"), F.col("_handed")))
        # A walk that brings nothing to a node without children ends there.
        useful = passed.where("passed is not null or _parent").select(
            F.col("dst").alias("node"), *moment, F.lit(None).cast("string").alias("own"), "passed",
            F.lit(True).alias("visited"), "level", "asks",
        )
        path = scratch_path(requests.sparkSession, "walks")
        useful.write.partitionBy("level", "asks").parquet(path)
        given.append(requests.sparkSession.read.schema(useful.schema).parquet(path))
    out = series[0]
    for s in series[1:]:
        out = out.unionByName(s)
    name = F.when(F.col("passed") == CRITICAL, "critical").when(F.col("passed") == WARNING, "warning")
    return out.select("node", *moment, F.col("own").alias("request"), name.alias("passed"), "status")


def last_statuses(series: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """(node, status) after the last moment of each node."""
    return series.groupBy("node").agg(
        F.max_by("status", F.struct(*order, ORIGIN)).alias("status")
    )
