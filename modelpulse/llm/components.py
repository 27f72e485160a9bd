"""Connected components of links, without a large group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelpulse.functions.storage import Passing, settle_rows


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node in a link; the component is its smallest node.

    Rounds of label propagation with shortcuts: each node takes the smallest label among its
    own and its neighbours', which is partly summed before the shuffle, then the label of its
    label. Every round is written to the shared folder and replaces the one before; a round
    without a change is the last. Links may repeat, point either way or at their own node.
    """
    links_on_way, rounds = Passing(links.sparkSession), Passing(links.sparkSession)
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    both = links_on_way.settle_rows(pairs.union(pairs.select("b", "a")).where("a <> b").distinct())
    label = rounds.settle_rows(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")))
    while True:
        # The label of a node's label, then the smallest one among the neighbours.
        far = label.select(F.col("a").alias("label"), F.col("label").alias("far"))
        jumped = label.join(far, "label").select("a", F.least("label", "far").alias("label"), F.col("label").alias("was"))
        offered = both.join(jumped.select("a", "label"), "a").groupBy("b").agg(F.min("label").alias("offer"))
        moved = jumped.join(offered, jumped["a"] == offered["b"]).select(
            "a", F.least("label", "offer").alias("label"), "was"
        )
        moved = rounds.settle_rows(moved)
        rounds.remove(keep=1)
        changed = moved.where("label <> was").limit(1).count()
        label = moved.select("a", "label")
        if not changed:
            links_on_way.remove()
            return label.select(F.col("a").alias("node"), F.col("label").alias("component"))
