"""Dependency graph of a monitored system: node status over time and spread of failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelpulse.functions.joins import BROADCAST_ROWS, even_join, is_small, lookup_join
from modelpulse.functions.ordering import number_rows, overlapped, own_rows
from modelpulse.functions.storage import settle_counted, settle_rows, settle_rows_counted
from modelpulse.operators.contraction import contract, levels_of
from modelpulse.spec import NODE_STATUSES, STATUS_SCORES

STRONG = 0.5
PAGE = 1_000


# --- node status --------------------------------------------------------------------------


def node_requests(
    overall: DataFrame, failed: DataFrame, by: Sequence[str], node: Column, seq: Column
) -> DataFrame:
    """Batches as status requests to the node that ran them; a rejected batch is critical."""
    state = F.col("status")
    green = F.when(state == "warning", "warning").when(state == "critical", "critical")
    ran = overall.select(
        *by,
        node.alias("node"),
        seq.alias("seq"),
        green.otherwise("green").alias("req_status"),
        F.lit(None).cast("string").alias("system_failure"),
    )
    broken = failed.select(
        *by,
        node.alias("node"),
        seq.alias("seq"),
        F.lit("critical").alias("req_status"),
        F.to_json("failure").alias("system_failure"),
    )
    return ran.unionByName(broken)


def node_status(events: DataFrame, order: Sequence[str], name: str = "status") -> DataFrame:
    """Status of a node after each request (node, req_status and the total `order`).

    One green after a critical request is held as critical; the next one clears it. A
    'reset' request sets green at once and is no critical request to the one after it.
    Looking one request back is enough, so blocks of the event series overlap by one row.
    """
    blocks = overlapped(number_rows(events, ["node"], order, "_seq"), "_seq", 1)
    earlier = F.lag("req_status").over(Window.partitionBy("node", "_block").orderBy("_seq"))
    req = F.col("req_status")
    held = (req == "green") & (F.coalesce(earlier, F.lit("")) == "critical")
    status = F.when(held, "critical").when(req == "reset", "green").otherwise(req)
    return own_rows(blocks.withColumn(name, status)).select(*events.columns, name)


def invalid_requests(events: DataFrame) -> DataFrame:
    """Requests for a status that does not exist."""
    return events.where(~F.col("req_status").isin(*NODE_STATUSES, "reset"))


def current_status(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Latest (node, status). Two requests per node decide it; the rank limit of Spark drops
    all others before the shuffle."""
    newest = Window.partitionBy("node").orderBy(*[F.desc(c) for c in order])
    last = events.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= 2)
    pair = last.groupBy("node").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("req_status"))).alias("_now"),
        F.max(F.when(F.col("_rn") == 2, F.col("req_status"))).alias("_was"),
    )
    held = (F.col("_now") == "green") & (F.coalesce("_was", F.lit("")) == "critical")
    status = F.when(held, "critical").when(F.col("_now") == "reset", "green")
    return pair.select("node", status.otherwise(F.col("_now")).alias("status"))


def lock_requests(nodes: DataFrame, seq: Column) -> DataFrame:
    return nodes.select("node", seq.alias("seq"), F.lit("locked").alias("req_status"))


def reset_requests(nodes: DataFrame, seq: Column) -> DataFrame:
    return nodes.select("node", seq.alias("seq"), F.lit("reset").alias("req_status"))


def healthy_nodes(status: DataFrame) -> DataFrame:
    return status.where(F.col("status") == "green")


def status_score(status: Column) -> Column:
    """Health of a status between 0 and 1; unknown ones count 0."""
    out = F
    for name, score in STATUS_SCORES.items():
        out = out.when(status == name, F.lit(score))
    return out.otherwise(F.lit(0.0))


# --- edges --------------------------------------------------------------------------------


def latest_edges(edges: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per (src, dst) with the weight given last in the order of `seq`; a missing weight is 1.

    Rows of a table have no order of their own: without `seq` a repeated edge counts with its
    largest weight.
    """
    weight = F.coalesce(F.col("weight"), F.lit(1.0))
    chosen = F.max(weight) if seq is None else F.max_by(weight, F.col(seq))
    return edges.groupBy("src", "dst").agg(chosen.alias("weight"))


def adjacency(edges: DataFrame, page: int = PAGE) -> DataFrame:
    """Neighbours of each node: (node, side, page_no, neighbours), at most `page` to a row.

    A node with very many neighbours gets many rows instead of one huge array.
    """
    told = settle_rows(edges.select(F.col("src"), F.col("dst")).distinct())
    sides = [("src", "downstream", "dst"), ("dst", "upstream", "src")]
    lists = [_neighbours(told, node, side, other, page) for node, side, other in sides]
    return lists[0].unionByName(lists[1])


def _neighbours(links: DataFrame, node: str, side: str, other: str, page: int) -> DataFrame:
    """One side of `adjacency` of distinct links. Only nodes with more neighbours than go into a page get
    them numbered; there are few of those."""
    rows = links.select(F.col(node).alias("node"), F.col(other).alias("other"))
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > page)
    hubs, n = settle_counted(counts.select(F.col("node").alias("_hub")))
    whole, paged = rows.withColumn("page_no", F.lit(0).cast("bigint")), None
    if n:
        is_hub = F.col("node").eqNullSafe(F.col("_hub"))
        whole = whole.join(F.broadcast(hubs), is_hub, "left_anti")
        numbered = number_rows(rows.join(F.broadcast(hubs), is_hub, "left_semi"), ["node"], ["other"], "_pos")
        paged = numbered.select("node", "other", F.floor(F.col("_pos") / F.lit(page)).cast("bigint").alias("page_no"))
        paged = paged.groupBy("node", "page_no").agg(F.sort_array(F.collect_list("other")).alias("neighbours"))
    lists = whole.groupBy("node").agg(
        F.lit(0).cast("bigint").alias("page_no"), F.sort_array(F.collect_list("other")).alias("neighbours")
    )
    out = lists if paged is None else lists.unionByName(paged)
    return out.select("node", F.lit(side).alias("side"), "page_no", "neighbours")


def check_graph(
    nodes: DataFrame, edges: DataFrame, events: DataFrame | None = None
) -> DataFrame:
    """Problems (problem, item): duplicate nodes, edges or runs that name no node."""
    names = nodes.select("node").distinct()
    twice = nodes.groupBy("node").count().where(F.col("count") > 1)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    found = [
        twice.select(F.lit("duplicate node").alias("problem"), F.col("node").alias("item")),
        ends.join(names, "node", "left_anti").select(
            F.lit("edge endpoint missing").alias("problem"), F.col("node").alias("item")
        ),
    ]
    if events is not None:
        runs = events.select("node").distinct().join(names, "node", "left_anti")
        found.append(
            runs.select(F.lit("unknown node").alias("problem"), F.col("node").alias("item"))
        )
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


# --- spread of failures -------------------------------------------------------------------


ACTIVE, WARNING, CRITICAL = 1, 2, 3
#: Rounds over the links as they are; a spread still going on then is a deep one.
PLAIN_ROUNDS = 4
#: Tables of earlier rounds that a round looks into; then they are made one, so plans don't grow.
STATE_TABLES = 8


def _follow(links: DataFrame, frontier: DataFrame, size: int) -> DataFrame:
    """Links that leave the frontier, with the level of the node they leave.

    A small frontier is broadcast. With a larger one both sides shuffle on src, and the links of
    hubs are dealt out, so a hub with very many of them stays out of a single task.
    """
    begun = frontier.select(F.col("node").alias("src"), "level")
    if size <= BROADCAST_ROWS:
        return links.join(F.broadcast(begun), "src")
    return even_join(links, begun, ["src"])


def _spread(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Highest level (node, level) every node gets; links are src, dst, strong, own.

    A strong link hands on the level of its source, a weak one only that the target is to be
    walked on from; a target never has less than its own level. Each round follows the links
    of the nodes whose level rose last, and keeps the targets that rise, so paths are never
    enumerated and cycles end. Every round is settled in the shared folder. A spread that does not
    end in PLAIN_ROUNDS goes on over shortened links: chains and trees take the logarithm of
    their depth; what lies between nodes with several parents takes a round per step.
    """
    found, ended = _rounds(links, seeds.select("node", F.lit(CRITICAL).alias("level")).distinct(), PLAIN_ROUNDS)
    if ended:
        return found
    begun = settle_rows(found.where(F.col("level") == CRITICAL))
    links, taken = contract(links, begun, ACTIVE)
    levels = begun if links is None else _rounds(links, begun)[0]
    return levels_of(levels, taken, ACTIVE)


def _rounds(links: DataFrame, begun: DataFrame, limit: int | None = None) -> tuple[DataFrame, bool]:
    """Levels after at most `limit` rounds, and whether no round is open."""
    frontier, size = settle_rows_counted(begun)
    found, tables, done = frontier, 1, 0
    given = F.expr(f"greatest(if(strong, level, {ACTIVE}), own) as level")
    while size and done != limit:
        reached = _follow(links, frontier, size).select(F.col("dst").alias("node"), given)
        best = reached.groupBy("node").agg(F.max("level").alias("level")).alias("n")
        known = found.hint("merge").alias("o")
        not_lower = (F.col("n.node") == F.col("o.node")) & (F.col("o.level") >= F.col("n.level"))
        frontier, size = settle_rows_counted(best.join(known, not_lower, "left_anti"))
        done += 1
        if size:
            found, tables = found.unionByName(frontier), tables + 1
        if tables == STATE_TABLES:
            found, tables = settle_rows(found.groupBy("node").agg(F.max("level").alias("level"))), 1
    return found.groupBy("node").agg(F.max("level").alias("level")), not size


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes reached from the seeds over any edge, the seeds included."""
    links = edges.select("src", "dst", F.lit(True).alias("strong"), F.lit(ACTIVE).alias("own"))
    links = links.where("src is not null and dst is not null")
    return _spread(settle_rows(links), seeds).select("node")


def propagate(
    status: DataFrame, edges: DataFrame, seeds: DataFrame, min_weight: float = STRONG
) -> DataFrame:
    """Status of all nodes after the seeds turned critical: (node, status, raised).

    A critical node makes its children critical and a warning node makes them warn, over
    edges of at least `min_weight`. The walk also continues below weaker edges with the
    status the child already has. Where several parents disagree the most severe status
    wins; a visit order decides nothing. With all other nodes green that is the set
    reachable over strong edges.
    """
    latest = latest_edges(edges, "seq" if "seq" in edges.columns else None)
    own = F.expr(f"case status when 'critical' then {CRITICAL} when 'warning' then {WARNING} end")
    alarmed, count = settle_rows_counted(
        status.where("status in ('critical', 'warning')").select(
            F.col("node").alias("dst"), own.alias("own")
        )
    )
    links = latest.select("src", "dst", (F.col("weight") >= min_weight).alias("strong"))
    links = links.where("src is not null and dst is not null")
    if count == 0:
        # Below a weak edge all is green and stays so.
        links = links.where("strong").withColumn("own", F.lit(ACTIVE))
    else:
        links = lookup_join(links, alarmed, ["dst"], "left", spread_by=["src"], rows=count)
        links = links.withColumn("own", F.expr(f"coalesce(own, {ACTIVE})"))
    levels = _spread(settle_rows(links), seeds)
    new = F.expr(f"case level when {CRITICAL} then 'critical' when {WARNING} then 'warning' end")
    raised = levels.select("node", new.alias("_new"))
    after = F.coalesce(F.col("_new"), F.col("status"))
    return status.join(raised.hint("merge"), "node", "left").select(
        "node", after.alias("status"), (after != F.col("status")).alias("raised")
    )


def inject_failures(
    status: DataFrame, edges: DataFrame, failed: DataFrame, min_weight: float = STRONG
) -> DataFrame:
    """Failed nodes (node, failure) turn critical, carry their failure, and spread it."""
    spread = propagate(status, edges, failed, min_weight)
    told, count = settle_rows_counted(failed.select("node", "failure"))
    return lookup_join(spread, told, ["node"], "left", rows=count)


# --- heartbeats ---------------------------------------------------------------------------


def heartbeat_timeouts(
    nodes: DataFrame, events: DataFrame, asof: Column, timeout_seconds: float
) -> DataFrame:
    """Known nodes silent for longer than the timeout at `asof`; never seen ones are left out."""
    seen = events.groupBy("node").agg(F.max("ts").alias("last_seen"))
    silent = F.unix_micros(asof.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    return (
        nodes.select("node").distinct().join(seen, "node")
        .where(silent > F.lit(int(timeout_seconds * 1_000_000)))
        .select("node", "last_seen", F.lit("grey").alias("status"))
    )


def _busy_slots(events: DataFrame, timeout_seconds: float) -> DataFrame:
    """First and last event of a node per time slot as long as the timeout.

    Two events of one slot are never further apart than the timeout, so silences show
    between slots only. A node has at most one row per slot, however many events it sends,
    and the aggregation is partial before the shuffle.
    """
    width = int(timeout_seconds * 1_000_000)
    slot = F.expr(f"floor(unix_micros(cast(ts as timestamp)) / {width})")
    slots = events.groupBy("node", slot.alias("_slot")).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count(F.lit(1)).alias("events"),
    )
    before = F.lag("last_seen").over(Window.partitionBy("node").orderBy("_slot"))
    silence = F.expr(
        "unix_micros(cast(first_seen as timestamp)) - unix_micros(cast(_before as timestamp))"
        f" > {width}"
    )
    return slots.withColumn("_before", before).withColumn("_silent", silence)


def heartbeat_gaps(events: DataFrame, timeout_seconds: float) -> DataFrame:
    """Every silence longer than the timeout between two events of a node."""
    return _busy_slots(events, timeout_seconds).where("_silent").select(
        "node", F.col("_before").alias("last_seen"), F.col("first_seen").alias("seen_again")
    )


def activity_periods(events: DataFrame, timeout_seconds: float) -> DataFrame:
    """Periods of a node without a silence longer than the timeout, with the moment after
    each at which the silence is too long (one microsecond past the timeout)."""
    fresh = F.when(F.coalesce("_silent", F.lit(True)), 1).otherwise(0)
    so_far = Window.partitionBy("node").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    numbered = _busy_slots(events, timeout_seconds).withColumn("_no", F.sum(fresh).over(so_far))
    periods = numbered.groupBy("node", "_no").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("events").alias("events"),
    )
    late = int(timeout_seconds * 1_000_000) + 1
    grey = F.expr(f"cast(last_seen as timestamp) + make_dt_interval(0, 0, 0, {late} / 1000000.0BD)")
    return periods.select("node", "first_seen", "last_seen", "events", grey.alias("grey_at"))


# --- trace --------------------------------------------------------------------------------


def trace_json(
    nodes: DataFrame, edges: DataFrame, status: DataFrame, page: int = PAGE
) -> DataFrame:
    """The graph as JSON documents name -> {name, owner, status, metrics, upstream, downstream}.

    One document per node and page of neighbours, so neither a hub nor the whole graph has
    to fit into one value. `status` may bring a `metrics` JSON column.
    """
    lists = adjacency(edges, page).groupBy("node", "page_no").agg(
        F.max(F.when(F.col("side") == "upstream", F.col("neighbours"))).alias("upstream"),
        F.max(F.when(F.col("side") == "downstream", F.col("neighbours"))).alias("downstream"),
    )
    state = status if "metrics" in status.columns else status.withColumn("metrics", F.lit("{}"))
    joined = (
        nodes.select("node", "owner")
        .join(state.select("node", "status", "metrics").hint("merge"), "node", "left")
        .join(lists.hint("merge"), "node", "left")
    )
    none = F.array().cast("array<string>")
    entry = F.struct(
        F.col("node").alias("name"),
        "owner",
        F.coalesce("status", F.lit("green")).alias("status"),
        F.parse_json(F.coalesce("metrics", F.lit("{}"))).alias("metrics"),
        F.coalesce("upstream", none).alias("upstream"),
        F.coalesce("downstream", none).alias("downstream"),
    )
    return joined.select(
        "node",
        F.coalesce("page_no", F.lit(0)).cast("bigint").alias("page_no"),
        F.to_json(F.create_map(F.col("node"), entry)).alias("trace"),
    )


def small_graph(nodes: DataFrame, edges: DataFrame, limit: int = PAGE) -> bool:
    """Whether one document can hold the graph: a few stages, as pipelines have."""
    return is_small(nodes, limit) and is_small(edges, limit)


def trace_document(
    nodes: DataFrame, edges: DataFrame, status: DataFrame, limit: int = PAGE
) -> DataFrame:
    """A small graph in one document; larger ones are refused, use `trace_json`."""
    if not small_graph(nodes, edges, limit):
        raise ValueError(f"more than {limit} nodes or edges do not go into one document")
    parts = trace_json(nodes, edges, status, limit)
    # Joining the inner texts keeps the entries as they were written.
    inner = F.expr("substring(trace, 2, length(trace) - 2)")
    listed = F.array_sort(F.collect_list(inner))
    return parts.agg(
        F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}")).alias("trace")
    )
