"""Shortening a graph before something spreads over it, so that long paths take few rounds.

A link (src, dst, strong, own) says what dst gets from src: `own`, or the level of src if that is more
and the link is strong. Two links in a row are one link of that kind, and so are two links side by
side. A node with a single link into it needs no round of its own: its level follows from
that of the nearest node above it with several. Pointers to that one double, a chain or a
tree of any depth goes in its logarithm of rounds, and links that now run side by side become
one, which leaves new nodes with a single link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelpulse.functions.joins import lookup_join
from modelpulse.functions.storage import settle_counted, settle_observed, settle_rows

#: Links are shortened again as long as that takes away one in so many.
WORTH = 20


def _in_a_row(floor: int) -> tuple[str, str]:
    """strong and own of a link after one called `_strong`, `_own`."""
    return "strong and _strong", f"greatest(own, if(strong, _own, {floor}))"


def _tidy(links: DataFrame, seeds: DataFrame) -> tuple[DataFrame, int]:
    """Links that can be reached, those side by side as one, those that return to their node as
    what the node has of its own."""
    merged = settle_rows(
        links.groupBy("src", "dst").agg(F.bool_or("strong").alias("strong"), F.max("own").alias("own"))
    )
    reached = merged.select(F.col("dst").alias("src")).unionByName(seeds.select(F.col("node").alias("src")))
    single = merged.join(reached.distinct(), "src", "left_semi")
    back, loops = settle_counted(single.where("src = dst").select("dst", F.col("own").alias("_own")))
    rest = single.where("src <> dst")
    if loops:
        rest = lookup_join(rest, back, ["dst"], "left", spread_by=["src"], rows=loops)
        rest = rest.selectExpr("src", "dst", "strong", "greatest(own, coalesce(_own, own)) as own")
    kept = settle_rows(rest)
    return kept, kept.count()


def _to_the_top(steps: DataFrame, size: int, floor: int) -> DataFrame:
    """(node, root, strong, own, ended): the link to every node from the nearest node that is in no step.

    Nodes in or below a ring of steps find none. A round doubles the way; where one brings nobody to
    an end, none will, as the nodes of a way end one after the other.
    """
    strong, own = _in_a_row(floor)
    state, ended = steps.withColumn("ended", F.lit(False)), 0
    while True:
        ahead = state.selectExpr(
            "node as root", "root as _far", "strong as _strong", "own as _own", "ended as _ended"
        )
        state, seen = settle_observed(
            lookup_join(state, ahead, ["root"], "left", spread_by=["node"], rows=size).selectExpr(
                "node", "coalesce(_far, root) as root", f"if(_far is null, strong, {strong}) as strong",
                f"if(_far is null, own, {own}) as own", "_far is null or _ended as ended",
            ),
            ended=F.count_if("ended"),
        )
        if seen["ended"] in (ended, size):
            return state
        ended = seen["ended"]


def contract(links: DataFrame, seeds: DataFrame, floor: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """Fewer links with the same outcome (None for none), and the nodes taken out: tables (node,
    root, strong, own).

    `seeds` have the highest level whatever leads into them; `floor` is the least level of a node
    that is reached. What is left lies between nodes with several links into them. Give the levels
    found there to `levels_of`, with the tables.
    """
    strong, own = _in_a_row(floor)
    into = seeds.select(F.col("node").alias("dst"))
    left, size = _tidy(links.join(into, "dst", "left_anti"), seeds)
    taken: list[DataFrame] = []
    while size:
        ins = left.groupBy(F.col("dst").alias("node")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("src").alias("root"),
            F.bool_or("strong").alias("strong"), F.max("own").alias("own"),
        )
        steps, singles = settle_counted(ins.where("_n = 1").drop("_n"))
        if singles * WORTH < size:
            break
        found = _to_the_top(steps, singles, floor)
        taken.append(found.where("ended").drop("ended"))
        rest = left.join(steps.select(F.col("node").alias("dst")), "dst", "left_anti")
        above = found.selectExpr("node as src", "root as _root", "strong as _strong", "own as _own", "ended as _ended")
        moved = lookup_join(rest, above, ["src"], "left", spread_by=["dst"], rows=singles)
        left, size = _tidy(
            moved.where("coalesce(_ended, true)").selectExpr(
                "coalesce(_root, src) as src", "dst", f"if(_root is null, strong, {strong}) as strong",
                f"if(_root is null, own, {own}) as own",
            ),
            seeds,
        )
    return (left if size else None), taken


def levels_of(levels: DataFrame, taken: list[DataFrame], floor: int) -> DataFrame:
    """Levels (node, level) of all reached nodes, from those of the nodes that were left."""
    for steps in reversed(taken):
        tops, size = settle_counted(levels.select(F.col("node").alias("root"), "level"))
        got = lookup_join(steps, tops, ["root"], spread_by=["node"], rows=size)
        below = got.selectExpr("node", f"greatest(own, if(strong, level, {floor})) as level")
        levels = settle_rows(levels.unionByName(below))
    return levels
