"""Near-duplicate documents by BagMinHash signatures of their shingles.

Every (shingle, register weight) is a Poisson process in time: a register keeps the earliest
point it was given, and two texts keep the same point in a register with the probability of
their weighted Jaccard similarity, the shingles' counts being the weights. The weights are cut
into whole steps. Steps (0,1], (1,2], (2,4], (4,8], ... are processes of their own, as fast as
the block is wide, and every point of a block lies in one step of it, found by halving: the half
without the point is a process of its own from then on. A text follows only the parts of the
tree below its counts, and a process ends as soon as it is later than the latest register.

Bands of registers give candidates: texts that share a bucket. First each bucket is a star around
the text with the most company in all its buckets, most often the original of the copies, which
joins large groups at one comparison a text. In a bucket that still holds several groups, the
texts outside its largest group are compared with all others, in blocks of bounded size: a unit of
work counts the overlap of two blocks' multisets at once and gives links between groups, never
pairs of texts. The overlap of the multisets decides on every link.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelpulse.functions.storage import Passing, settle_rows
from modelpulse.llm.common import text_chunks
from modelpulse.llm.components import components
from modelpulse.llm.shingles import mixed, ragged_range, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS = 5, 26
#: Load of a block: the shingles of its texts and TEXT_LOAD for each text.
BLOCK_LOAD, TEXT_LOAD = 200_000, 200
#: Cells of an incidence matrix that a unit of work fills at once.
CELLS = 4_000_000


def exponential(seed: np.ndarray, salt: int) -> np.ndarray:
    """Waiting time of rate 1, fixed by the seed."""
    bits = mixed(seed ^ mixed(np.array([salt], np.uint64))[0]) >> np.uint64(11)
    return -np.log((bits.astype(np.float64) + 0.5) / 9007199254740992.0)


def signatures(texts: list[str], width: int = WORDS, registers: int = ROWS * BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Registers of each text as the ids of the earliest points, and its number of shingles."""
    shingles, sizes = shingle_hashes(texts, width)
    rows = len(texts)
    times = np.full((rows, registers), np.inf)
    points = np.zeros((rows, registers), np.uint64)
    owner = np.repeat(np.arange(rows), sizes)
    # Equal shingles of a text are one element with their count as weight.
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(shingles)))
    element, owner = shingles[first], owner[first]
    # Blocks (0,1], (1,2], (2,4], ... that begin below the weight.
    blocks = np.where(weight == 1, 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1)
    block = ragged_range(blocks)
    element, owner, weight = (np.repeat(x, blocks) for x in (element, owner, weight))
    low = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0)).astype(np.int64)
    high = (1 << block).astype(np.int64)
    seed = mixed(element ^ mixed(block.astype(np.uint64) + np.uint64(77)))
    # A process: its text, weight, span of steps, seed and the time of its next point.
    time = exponential(seed, 1) / (high - low) / registers
    limit = np.full(rows, np.inf)
    live = (owner, weight, low, high, seed, time)
    while len(live[0]):
        owner, weight, low, high, seed, time = live
        # The point goes down to its step; each half it leaves behind is a process from here on.
        born = []
        path, lo, hi = seed.copy(), low.copy(), high.copy()
        while True:
            wide = np.flatnonzero(hi - lo > 1)
            if not len(wide):
                break
            middle = (lo[wide] + hi[wide]) // 2
            side = (mixed(path[wide] ^ np.uint64(0x51ED270B)) >> np.uint64(63)).astype(bool)
            left_seed = mixed(path[wide] + np.uint64(0x2545F491))
            right_seed = mixed(path[wide] + np.uint64(0x9E6C63D1))
            other_low = np.where(side, lo[wide], middle)
            other_high = np.where(side, middle, hi[wide])
            other_seed = np.where(side, left_seed, right_seed)
            later = time[wide] + exponential(other_seed, 1) / (other_high - other_low) / registers
            below = (other_low < weight[wide]) & (later <= limit[owner[wide]])
            born.append(tuple(x[below] for x in (owner[wide], weight[wide], other_low, other_high, other_seed, later)))
            path[wide] = np.where(side, right_seed, left_seed)
            lo[wide] = np.where(side, middle, lo[wide])
            hi[wide] = np.where(side, hi[wide], middle)
        # Points in steps below the weight count; their step goes on as a process.
        seen = lo < weight
        point = mixed(path ^ np.uint64(0xA0761D64))
        register = ((point >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        slot = (owner * registers + register)[seen]
        flat, ids = times.reshape(-1), points.reshape(-1)
        # The earliest point of each slot; ties (the same point twice) are the same id.
        by = np.lexsort((time[seen], slot))
        head = np.append(True, slot[by][1:] != slot[by][:-1])[: len(by)]
        at, when, what = slot[by][head], time[seen][by][head], point[seen][by][head]
        earlier = when < flat[at]
        flat[at[earlier]], ids[at[earlier]] = when[earlier], what[earlier]
        touched = np.unique(owner)
        limit[touched] = times[touched].max(axis=1)
        again = mixed(path + np.uint64(0x8EBC6AF0))
        born.append((owner[seen], weight[seen], lo[seen], hi[seen], again[seen], time[seen] + exponential(again[seen], 1) / registers))
        joined = [np.concatenate(x) for x in zip(*born)]
        stay = joined[5] <= limit[joined[0]]
        live = tuple(x[stay] for x in joined)
    return points, sizes


def multisets(texts: list[str], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text, the second and later copies of one as elements of their own, and their number."""
    shingles, sizes = shingle_hashes(texts, width)
    owner = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    copy = np.arange(len(shingles)) - np.repeat(first, np.diff(np.append(first, len(shingles))))
    return mixed(shingles + copy.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), sizes


def overlaps(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of each multiset on the left with each on the right, exactly."""
    (left_items, left_sizes), (right_items, right_sizes) = left, right
    rows, columns = len(left_sizes), len(right_sizes)
    both = np.intersect1d(left_items, right_items)
    cells = []
    for items, sizes in (left, right):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.minimum(np.searchsorted(both, items), max(len(both) - 1, 0))
        met = both[place] == items if len(both) else np.zeros(len(items), bool)
        order = np.argsort(place[met], kind="stable")
        cells.append((owner[met][order], place[met][order]))
    common = np.zeros((rows, columns))
    step = max(1, CELLS // (rows + columns))
    for start in range(0, len(both), step):
        wide = min(step, len(both) - start)
        sides = []
        for (owner, place), n in zip(cells, (rows, columns)):
            low, high = np.searchsorted(place, (start, start + wide))
            side = np.zeros((n, wide), np.float32)
            side[owner[low:high], place[low:high] - start] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    return common / np.maximum(left_sizes[:, None] + right_sizes[None, :] - common, 1)


def joined_groups(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups that links between their texts join, each with the smallest group it reaches."""
    a, b = group[a], group[b]
    label = np.arange(int(group.max()) + 1)
    while True:
        lower = label.copy()
        np.minimum.at(lower, a, label[b])
        np.minimum.at(lower, b, label[a])
        if (lower == label).all():
            break
        label = lower
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def sketched(texts: DataFrame, key: str, text: str, width: int, rows: int, bands: int) -> DataFrame:
    """(key, n shingles, one hash per band) of every text with words."""
    schema = T.StructType(
        [texts.schema[key], T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType(), False))]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            keys = batch.column(0)
            for start, held in text_chunks(batch.column(1)):
                points, sizes = signatures(held, width, rows * bands)
                banded = mixed((points.reshape(len(held), bands, rows) * factor).sum(axis=2, dtype=np.uint64))
                found = np.flatnonzero(sizes > 0)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(found) + 1, dtype=np.int32) * bands),
                    pa.array(banded[found].astype(np.int64).reshape(-1)),
                )
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(start, len(held)).take(pa.array(found)), pa.array(sizes[found]), lists], names=schema.names
                )

    return texts.select(key, text).mapInArrow(run, schema)


#: Columns that name a unit of work, and the parts a text plays in one.
UNIT = ["bucket", "low", "high"]
LEFT, RIGHT, BOTH = 0, 1, 2


def units_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows sorted by unit as tables of whole units, with the edges of these."""
    held: pa.Table | None = None
    for batch in batches:
        for start in range(0, batch.num_rows, 1_000):
            part = pa.Table.from_batches([batch.slice(start, 1_000)])
            held = part if held is None else pa.concat_tables([held, part])
            marks = np.stack([held.column(c).to_numpy() for c in UNIT])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            if len(cuts):
                yield held.slice(0, cuts[-1]), [0, *cuts.tolist()]
                held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held, [0, held.num_rows]


def linked(units: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b) of groups that some texts of a unit link.

    `units` has the columns of UNIT, the id and group g of a text, and its part: the left ones
    are compared with the right ones of their unit, those of both also among themselves.
    """
    schema = T.StructType([T.StructField(c, units.schema["g"].dataType) for c in ("a", "b")])
    work = units.join(texts, "id").select(*UNIT, "part", "g", "t").repartition(*UNIT).sortWithinPartitions(*UNIT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in units_of(batches):
            parts = table.column("part").to_numpy()
            names = table.column("g").combine_chunks().dictionary_encode()
            codes = names.indices.to_numpy()
            for start, end in zip(edges[:-1], edges[1:]):
                part = parts[start:end]
                left, right = np.flatnonzero(part != RIGHT), np.flatnonzero(part != LEFT)
                known, group = np.unique(codes[start:end], return_inverse=True)
                if not len(left) or not len(right) or len(known) < 2:
                    continue
                items, sizes = multisets(table.column("t").slice(start, end - start).to_pylist(), width)
                whole = np.split(items, np.cumsum(sizes)[:-1])
                chosen = [(np.concatenate([whole[i] for i in at]), sizes[at]) for at in (left, right)]
                a, b = np.nonzero(overlaps(*chosen) >= least)
                a, b = left[a], right[b]
                apart = group[a] != group[b]
                moved, label = joined_groups(group, a[apart], b[apart])
                if len(moved):
                    yield pa.RecordBatch.from_arrays(
                        [names.dictionary.take(pa.array(known[x])) for x in (moved, label)], names=["a", "b"]
                    )

    return work.mapInArrow(run, schema)


def blocks_for(load: Column, widest: Column) -> Column:
    """Blocks that texts of this load make; a block holds a few of the longest text at least."""
    return F.greatest(F.lit(1), F.ceil(load / F.greatest(F.lit(BLOCK_LOAD), 4 * widest))).cast("bigint")


def star_units(entries: DataFrame, on_way: Passing) -> DataFrame:
    """Units that compare the texts of each bucket with its head."""
    company = entries.groupBy("id").agg(F.sum("size").alias("company"))
    heads = entries.join(company, "id").groupBy("band", "value").agg(F.max(F.struct("company", "id")).getField("id").alias("head"))
    stars = on_way.settle_rows(
        entries.join(heads, ["band", "value"]).where("id <> head").select("head", "id", "load").distinct()
    )
    split = stars.groupBy("head").agg(blocks_for(F.sum("load"), F.max("load")).alias("blocks"))
    # Only a head of very many texts has more than one block.
    members = stars.join(split.where("blocks > 1"), "head", "left").select(
        F.xxhash64("head").alias("bucket"),
        F.lit(0).cast("bigint").alias("low"),
        F.pmod(F.xxhash64("id", F.lit(3)), F.coalesce("blocks", F.lit(1))).alias("high"),
        F.lit(RIGHT).alias("part"), "id", F.col("id").alias("g"),
    )
    middles = split.select(
        F.xxhash64("head").alias("bucket"),
        F.lit(0).cast("bigint").alias("low"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("high"),
        F.lit(LEFT).alias("part"), F.col("head").alias("id"), F.col("head").alias("g"),
    )
    return members.union(middles)


def open_units(entries: DataFrame, groups: DataFrame, on_way: Passing) -> DataFrame:
    """Units that compare the texts outside the largest group of a bucket with all others in it."""
    placed = entries.join(groups, F.col("id") == F.col("node"), "left").select(
        "band", "value", "id", "load", F.coalesce("component", "id").alias("g")
    )
    tally = placed.groupBy("band", "value", "g").agg(F.sum("load").alias("load"), F.max("load").alias("widest"))
    split = tally.groupBy("band", "value").agg(
        F.max(F.struct("load", "g")).alias("main"), F.sum("load").alias("load"), F.max("widest").alias("widest"), F.count(F.lit(1)).alias("groups")
    ).where("groups > 1").select(
        "band", "value", F.col("main.g").alias("main"),
        blocks_for(F.col("main.load"), F.col("widest")).alias("mains"),
        blocks_for(F.col("load") - F.col("main.load"), F.col("widest")).alias("rests"),
    )
    dealt = on_way.settle_rows(placed.join(split, ["band", "value"]).select(
        F.xxhash64("band", "value").alias("bucket"), "id", "g", (F.col("g") == F.col("main")).alias("inside"), "mains", "rests",
        F.pmod(F.xxhash64("id", F.lit(5)), F.when(F.col("g") == F.col("main"), F.col("mains")).otherwise(F.col("rests"))).alias("own"),
    ))
    # A unit is a block of the rest (low) and one of the main group (high) or, behind these, of the rest.
    inside = dealt.where("inside").select(
        "bucket", F.explode(F.expr("sequence(0L, rests - 1)")).alias("low"), F.col("own").alias("high"), F.lit(RIGHT).alias("part"), "id", "g"
    )
    outside = dealt.where("not inside").select(
        "bucket", "id", "g", "mains", "own", F.explode(F.expr("sequence(0L, mains + rests - 1)")).alias("x")
    ).where("x <> mains + own").select(
        "bucket",
        F.expr("if(x < mains, own, least(own, x - mains))").alias("low"),
        F.expr("if(x < mains, x, mains + greatest(own, x - mains))").alias("high"),
        F.expr(f"case when x = 0 then {BOTH} when x < mains or own < x - mains then {LEFT} else {RIGHT} end").alias("part"),
        "id", "g",
    )
    return inside.union(outside)


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WORDS,
    least: float = SIMILARITY,
    rows: int = ROWS,
    bands: int = BANDS,
) -> DataFrame:
    """(id, text_id, component_id, kept) of each id of the documents.

    Texts of the same words, whatever the blanks, are one text, text_id its smallest id. Two texts
    are linked if the multisets of their shingles overlap by `least` of their union; a link is
    found with probability 1 - (1 - s^rows)^bands, 0.99998 at the least similarity, and every
    pair that shares a bucket is either compared or in one group already. component_id
    is the smallest id that links reach, `kept` marks it. A null, empty or blank text links with
    nothing. An id that repeats keeps the row of its smallest digest, a text without words before
    others; rows of null id go. Other columns don't matter; an empty table gives an empty one.
    """
    key = F.trim(F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]+", " "))
    named = docs.select(F.col(doc_id).alias("id"), key.alias("t")).where("id is not null")
    digest = F.when(F.col("t") != "", F.sha2("t", 256))
    marked = settle_rows(
        named.withColumn("digest", digest).groupBy("id").agg(F.min(F.struct("digest")).getField("digest").alias("digest"))
    )
    classes = settle_rows(marked.where("digest is not null").groupBy("digest").agg(F.min("id").alias("text_id")))
    # Tables that hold texts, sketches or entries are read no more once the links are found.
    on_way = Passing(docs.sparkSession)
    texts = on_way.settle_rows(
        named.where("t <> ''").withColumn("d", F.sha2("t", 256))
        .join(classes, (F.col("id") == F.col("text_id")) & (F.col("d") == F.col("digest")))
        .dropDuplicates(["id", "d"]).select("id", "t")
    )
    sketch = on_way.settle_rows(sketched(texts, "id", "t", width, rows, bands))
    # One row for each text and band with company in it.
    banded = sketch.select("id", (F.col("n") + TEXT_LOAD).alias("load"), F.posexplode("bands").alias("band", "value"))
    sizes = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    entries = on_way.settle_rows(banded.join(sizes, ["band", "value"]))
    # Only texts with company are compared; the others are shuffled no more. Merged at every size,
    # as the ids grow with the documents.
    near = on_way.settle_rows(texts.join(entries.select("id").distinct().hint("merge"), "id", "left_semi"))
    groups = components(on_way.settle_rows(linked(star_units(entries, on_way), near, width, least)), "a", "b")
    more = components(on_way.settle_rows(linked(open_units(entries, groups, on_way), near, width, least)), "a", "b")
    on_way.remove()
    # What the second links join are groups of the first, or single texts.
    second = more.select(F.col("node").alias("g"), F.col("component").alias("further"))
    found = classes.join(groups, F.col("text_id") == F.col("node"), "left").withColumn("g", F.coalesce("component", "text_id"))
    named_classes = found.join(second, "g", "left").select(
        F.col("digest").alias("d"), "text_id", F.coalesce("further", "g").alias("component_id")
    )
    alone = marked.where("digest is null").select("id", F.col("id").alias("text_id"), F.col("id").alias("component_id"))
    placed = marked.where("digest is not null").join(named_classes, F.col("digest") == F.col("d")).select("id", "text_id", "component_id")
    return placed.union(alone).select(
        F.col("id").alias(doc_id), "text_id", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )
