"""Cycles of a directed graph: its strongly connected components, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelpulse.functions.storage import settle, settle_counted, settle_observed, settle_rows


def _largest_reaching(edges: DataFrame) -> DataFrame:
    """(node, label): the largest node that reaches each end of an edge, itself included.

    A round takes the labels of the sources, which are partly combined before the shuffle, and
    the label of the label, as what reaches that reaches the node too; so long paths take few
    rounds. The last round changes nothing.
    """
    labels = settle(
        edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node"))
    )
    moved = 1
    while moved:
        given = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(
            F.max("label").alias("_given")
        )
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("_far"))
        best = F.greatest("label", "_far", F.coalesce("_given", "label"))
        taken = labels.join(given, "node", "left").join(far, "label").select(
            "node", best.alias("label"), (best > F.col("label")).alias("_moved")
        )
        taken, seen = settle_observed(taken, moved=F.count_if("_moved"))
        labels, moved = taken.select("node", "label"), seen["moved"]
    return labels


def _trimmed(edges: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Edges left after those that start where none ends or end where none starts have gone."""
    kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    kept = kept.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    left, now = settle_counted(kept.select("src", "dst"))
    return (left, now) if now < size else (edges, size)


def _ends_of_paths(step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the forced paths of (node, next) end, and the rings among them.

    Pointers double in every round. `next` of the first table is the first node that has no step
    of its own; nodes of the second run in a ring and have its smallest node. A pointer that is
    in no path with an end sees the whole ring once the smallest node it has passed stays.
    """
    state, size = settle_counted(step.select("node", "next", F.least("node", "next").alias("least")))
    ended = 0
    while True:
        ahead = state.select(F.col("node").alias("next"), F.col("next").alias("_far"), F.col("least").alias("_least"))
        stepped, seen = settle_observed(
            state.join(ahead, "next", "left").select(
                "node",
                F.coalesce("_far", "next").alias("next"),
                F.least("least", F.coalesce("_least", "least")).alias("least"),
                F.col("_far").isNull().alias("_ended"),
                (F.coalesce("_least", "least") < F.col("least")).alias("_moved"),
            ),
            ended=F.count_if("_ended"),
            moved=F.count_if(F.col("_moved") & ~F.col("_ended")),
        )
        now = seen["ended"]
        if now == size or (now == ended and not seen["moved"]):
            rings = stepped.where("not _ended").select("node", F.col("least").alias("component"))
            return stepped.where("_ended").select("node", "next"), rings
        state, ended = stepped.select("node", "next", "least"), now


def strong_components(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle: (node, component), the component being its smallest node.

    Nodes between two cycles are on none and don't come; a node with an edge to itself does. Edges
    that can't be on a cycle are trimmed and forced paths (one edge in, one out) are shortened to
    one edge, by doubling, so chains take few rounds. Then every node learns the largest node that
    reaches it and, among nodes that agree in that, the largest it reaches; where both are one,
    it is in the component of that one. Edges inside a component found, or between nodes that
    differ, go, and the rest begins anew. Repeated edges and null ends count for nothing.
    """
    given = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    loops = given.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    left, size = settle_counted(given.where("src <> dst"))
    found = [settle_rows(loops)]
    paths: list[DataFrame] = []
    while size:
        before = size
        left, size = _trimmed(left, size)
        if not size:
            break
        if size < before // 2:
            continue
        inner, shorter, rings, n = _forced(left)
        if n:
            found.append(rings)
            paths.append(inner)
            found.append(shorter.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")))
            left, size = settle_counted(shorter.where("src <> dst").distinct())
        if size < before:
            continue
        above = _largest_reaching(left)
        alike = _within(left, above)
        below = _largest_reaching(alike.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        here = above.withColumnRenamed("label", "_up").join(below, "node")
        mine = settle_rows(here.where("_up = label").select("node", F.col("label").alias("component")))
        # The largest node of all is named by itself, on a cycle or not.
        several = mine.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        found.append(settle_rows(mine.join(several.select("component"), "component", "left_semi").select("node", "component")))
        rest = _within(alike, below).join(mine.select(F.col("node").alias("src")), "src", "left_anti")
        left, size = settle_counted(rest.select("src", "dst"))
    out = _merged(found)
    for inner in reversed(paths):
        # A forced path lies on a cycle where its two ends do together.
        start = out.select(F.col("node").alias("start"), F.col("component"))
        end = out.select(F.col("node").alias("end"), F.col("component").alias("_other"))
        closed = inner.join(start, "start").join(end, "end").where("component = _other").select("node", "component")
        # One that comes back to where it began makes a component of its ends and itself.
        out = _merged([out, closed])
    least = out.groupBy("component").agg(F.min("node").alias("_least"))
    return out.join(least, "component").select("node", F.col("_least").alias("component"))


def _within(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between nodes of one label."""
    ends = lambda side, name: labels.select(F.col("node").alias(side), F.col("label").alias(name))
    return settle_rows(
        edges.join(ends("src", "_a"), "src").join(ends("dst", "_b"), "dst").where("_a = _b").select("src", "dst")
    )


def _forced(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Nodes with one edge in and one out: (node, start, end) of their paths, the edges with each
    path as one edge, the rings (node, component), and the number of such nodes."""
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_outs"), F.min("dst").alias("next"))
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_ins"), F.min("src").alias("last"))
    steps, n = settle_counted(outs.join(ins, "node").where("_outs = 1 and _ins = 1").select("node", "next", "last"))
    if not n:
        return steps, edges, steps, 0
    ahead, rings = _ends_of_paths(steps.select("node", "next"))
    behind, _ = _ends_of_paths(steps.select("node", F.col("last").alias("next")))
    inner = settle_rows(ahead.withColumnRenamed("next", "end").join(behind.withColumnRenamed("next", "start"), "node"))
    name = steps.select("node")
    kept = edges.join(name.withColumnRenamed("node", "src"), "src", "left_anti")
    direct = kept.join(name.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    short = inner.select(F.col("start").alias("src"), F.col("end").alias("dst"))
    return inner, settle_rows(direct.union(short).distinct()), settle_rows(rings), n


def _merged(found: list[DataFrame]) -> DataFrame:
    """One row per node; a node of a larger component may also be known by an edge to itself."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    # The largest name stands for a component found by labels; a loop names its own node.
    best = out.groupBy("node").agg(
        F.max(F.when(F.col("component") != F.col("node"), F.col("component"))).alias("_of"), F.max("component").alias("_self")
    )
    return settle_rows(best.select("node", F.coalesce("_of", "_self").alias("component")))
