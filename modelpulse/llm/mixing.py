"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are first summed by membership pattern - the set of sources they belong to - so what is
solved is as large as the number of patterns, not of documents. The flow sends words from
patterns to sources. Each pattern offers its words once at no cost, a second time at cost 1, a
third time at cost 2, up to the largest number of repetitions, and each source asks for its target. Documents are then
taken in a seeded order until the words that flow out of their pattern are reached.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelpulse.functions.storage import settle_rows
from modelpulse.llm.common import WORD, besides, fresh

REPEATS = 3
#: Slices of the seeded order; the words of each slice are summed before any window.
SLICES = 4096


def word_count(text: str) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def cycled_weights(sources: Sequence[str | None]) -> dict[str | None, int]:
    """1, 2, 3, 1, ... for the sources by code point, null last."""
    known = sorted(s for s in sources if s is not None)
    return {s: i % 3 + 1 for i, s in enumerate(known + [None] * (None in sources))}


def capped_targets(sizes: dict, weights: dict, repeats: int = REPEATS) -> dict:
    """Shares of all words by weight; none above `repeats` times its source's size.

    What a source can't take is shared again by weight among the others until none is above.
    """
    total = float(sum(sizes.values()))
    capped: set = set()
    while True:
        left = total - sum(repeats * sizes[s] for s in capped)
        open_weight = sum(w for s, w in weights.items() if s not in capped)
        share = {s: left * w / open_weight for s, w in weights.items() if s not in capped} if open_weight else {}
        above = {s for s, x in share.items() if x > repeats * sizes[s]}
        if not above:
            return {s: float(repeats * sizes[s]) if s in capped else share[s] for s in weights}
        capped |= above


def flow(patterns: dict[tuple, int], targets: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """Words that each (pattern, source) sends, by successive cheapest paths.

    `patterns` has the words of each set of sources. Its supply comes in `repeats` layers of
    that many words, layer k at cost k a word, so a document is repeated only where nothing
    unused is left. Targets are met as far as the patterns allow.
    """
    names = list(patterns)
    sources = list(targets)
    need = {s: round(targets[s]) for s in sources}
    used = {p: 0 for p in names}
    sent = {(p, s): 0 for p in names for s in p if s in need}
    serves: dict = {s: [p for p in names if s in p] for s in sources}

    def step_cost(p) -> int | None:
        """Cost of one more word of a pattern; what a layer still has is the room."""
        layer = used[p] // patterns[p] if patterns[p] else repeats
        return layer if layer < repeats else None

    for s in sources:
        while need[s] > 0:
            # Cheapest way to one more word for s: from a pattern of s, or from one whose words
            # another source gives up for those of a further pattern.
            best: dict = {}
            heap: list = [(0, 0, None, s)]
            came: dict = {}
            count, end = 1, None
            done: set = set()
            while heap:
                cost, _, kind, node = heapq.heappop(heap)
                if (kind, node) in done:
                    continue
                done.add((kind, node))
                if kind == "end":
                    end = node
                    break
                if kind is None:  # a source: any of its patterns may give
                    for p in serves[node]:
                        if best.get(("p", p), 1 << 60) > cost and ("p", p) not in done:
                            best["p", p], came["p", p] = cost, node
                            heapq.heappush(heap, (cost, count, "p", p))
                            count += 1
                else:
                    p = node
                    own = step_cost(p)
                    if own is not None:
                        heapq.heappush(heap, (cost + own, count, "end", p))
                        count += 1
                    for other in p:
                        if other in need and sent[p, other] and (None, other) not in done:
                            if best.get((None, other), 1 << 60) > cost:
                                best[None, other], came[None, other] = cost, p
                                heapq.heappush(heap, (cost, count, None, other))
                                count += 1
            if end is None:
                break
            layer_left = patterns[end] - used[end] % patterns[end]
            room, way, p = min(need[s], layer_left), [], end
            while True:
                taker = came["p", p]
                way.append((p, taker))
                if taker == s:
                    break
                p = came[None, taker]
                room = min(room, sent[p, taker])
                way.append((p, taker))
            for i, (p, taker) in enumerate(way):
                sent[p, taker] += -room if i % 2 else room
            used[end] += room
            need[s] -= room
    return sent


def mix(
    docs: DataFrame,
    memberships: Column,
    size: Column,
    weigh: Callable[[Sequence], dict] = cycled_weights,
    seed: int = 17,
    doc_id: str = "doc_id",
    repeats: int = REPEATS,
) -> tuple[DataFrame, dict, dict]:
    """Add size, copies and taken (words the mix takes, repeats counted) to the rows; returned
    with the size and the target of each source.

    `memberships` is an array of the sources of a row; a null in it is a source of its own. A
    null or empty array belongs to no source and gives nothing. Rows of the same id and size
    stand next to each other in the seeded order, so that reruns agree; repeated rows count
    each. A source ends within one document of its target.
    """
    c = {n: fresh(docs.columns, f"mix_{n}") for n in ("sources", "size", "at", "slice", "earlier", "before", "kept", "rest", "full", "edge")}
    order = F.xxhash64(F.lit(seed), F.col(doc_id), size)
    rows = docs.select(
        "*", F.array_sort(F.array_distinct(memberships)).alias(c["sources"]), size.alias(c["size"]), order.alias(c["at"])
    ).withColumn(c["slice"], F.shiftright(c["at"], 52))
    rows = settle_rows(rows)
    # One row for each pattern and slice of the order, whatever the number of documents.
    summed = rows.groupBy(c["sources"], c["slice"]).agg(F.sum(c["size"]).alias("words"), F.count(F.lit(1)).alias("n"))
    summed = settle_rows(summed)
    found = [
        (tuple(r[0]) if r[0] is not None else (), int(r[1]))
        for r in summed.groupBy(c["sources"]).agg(F.sum("words").alias("words")).collect()
    ]
    patterns = {p: n for p, n in found if p}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = capped_targets(sizes, weigh(list(sizes)), repeats) if sizes else {}
    sent = flow(patterns, targets, repeats)
    plan = []
    for p, n in patterns.items():
        out = sum(sent.get((p, s), 0) for s in p)
        plan.append((list(p), out // n if n else 0, out % n if n else 0))
    spark = docs.sparkSession
    kind = docs.select(memberships.alias("m")).schema["m"].dataType.simpleString()
    wanted = spark.createDataFrame(plan, f"`{c['sources']}` {kind}, `{c['kept']}` bigint, `{c['rest']}` bigint")
    spans = summed.selectExpr(
        f"`{c['sources']}`",
        f"`{c['slice']}`",
        f"coalesce(sum(words) over (partition by `{c['sources']}` order by `{c['slice']}`"
        f" rows between unbounded preceding and 1 preceding), 0) as `{c['earlier']}`",
        "words",
    )
    same = lambda a, b: a[c["sources"]].eqNullSafe(b[c["sources"]])
    # The last slice wholly inside the words still wanted, and the one in which they end: a row for
    # each pattern, as in the plan, so that the documents are never shuffled to meet it.
    ends = F.col(c["earlier"]) + F.col("words")
    in_edge = (F.col(c["earlier"]) < F.col(c["rest"])) & (ends > F.col(c["rest"]))
    cut = spans.join(F.broadcast(wanted), same(spans, wanted)).groupBy(spans[c["sources"]], c["kept"], c["rest"]).agg(
        F.max(F.when(ends <= F.col(c["rest"]), F.col(c["slice"]))).alias(c["full"]),
        F.max(F.when(in_edge, F.col(c["slice"]))).alias(c["edge"]),
        F.max(F.when(in_edge, F.col(c["earlier"]))).alias(c["earlier"]),
    )
    cut = settle_rows(cut)
    cuts = {x: fresh([*docs.columns, *c.values()], f"cut_{x}") for x in cut.columns}
    rows = rows.alias("r").join(
        F.broadcast(cut.select(*[F.col(x).alias(y) for x, y in cuts.items()])),
        F.expr(f"r.`{c['sources']}` <=> `{cuts[c['sources']]}`"),
        "left",
    )
    rest, kept = F.col(cuts[c["rest"]]), F.col(cuts[c["kept"]])
    edge = F.col(c["slice"]) == F.col(cuts[c["edge"]])
    inside = rows.where(edge).selectExpr(
        "*",
        f"`{cuts[c['earlier']]}` + coalesce(sum(`{c['size']}`) over (partition by `{c['sources']}`, `{c['slice']}`"
        f" order by `{c['at']}`, `{doc_id}`, `{c['size']}` rows between unbounded preceding and 1 preceding), 0) as `{c['before']}`",
    )
    outside = rows.where(~F.coalesce(edge, F.lit(False))).withColumn(c["before"], F.lit(None).cast("bigint"))
    done = inside.unionByName(outside)
    # The document in which the words end is taken if that comes nearer.
    more = (F.col(c["before"]) < rest) & (2 * (rest - F.col(c["before"])) >= F.col(c["size"]))
    whole = F.col(c["slice"]) <= F.col(cuts[c["full"]])
    copies = F.coalesce(kept + F.when(F.col(c["size"]) == 0, 0).when(whole | more, 1).otherwise(0), F.lit(0))
    own = besides(docs.columns, ("size", "copies", "taken"))
    return done.select(
        *[F.col(f"`{x}`") for x in own],
        F.col(c["size"]).alias("size"),
        copies.cast("bigint").alias("copies"),
        (copies * F.col(c["size"])).cast("bigint").alias("taken"),
    ), sizes, targets
