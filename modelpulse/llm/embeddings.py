"""Near-duplicate vectors: learned binary codes, multi-index Hamming tables, exact cosine.

Iterative quantisation turns the principal axes of a sample so that the signs of the turned
vectors lose the least and split evenly. The bits of several such rotations are dealt to tables,
each keyed by a few bits. Tables are added until partners at exactly the wanted cosine, made from
the sample, meet in some table nearly always; where the most tables don't do, keys get shorter, down
to a single key for all. Every vector is indexed, each length by itself; all that share a key are
compared by their own numbers in double precision, scaled by powers of two beforehand, which
changes no cosine.

Equal vectors are one vector with a count. A large bucket is cut into blocks and the pairs of
blocks are the units of work, so no task holds more than two blocks. A pair is counted in the
first table in which it meets; a unit gives sums and labels, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelpulse.functions.storage import settle_rows
from modelpulse.llm.common import Shared
from modelpulse.llm.components import components

COSINE = 0.9
#: Vectors that the rotations are learned from, and rounds of learning.
SAMPLE, ROUNDS = 8_192, 30
#: Wanted share of partners at the least cosine that meet, and most tables for keys of one width.
FOUND, TABLES = 0.99, 256
BLOCK = 512
#: A length with at most this many different vectors needs no index: all of them are compared.
FEW = 2 * BLOCK


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors times powers of two, their largest component between a half and 1."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def rotation(centred: np.ndarray, bits: int, random: np.random.Generator) -> np.ndarray:
    """Directions of the bits: principal axes, turned by iterative quantisation."""
    dim = centred.shape[1]
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, : min(bits, dim)]
    projected = centred @ axes
    turn = np.linalg.qr(random.normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(ROUNDS):
        code = np.where(projected @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(code.T @ projected)
        turn = (u @ v).T
    return axes @ turn


class Index:
    """Rotations, mean, and the bits of each table, for `rows` vectors of one length."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float = COSINE, seed: int = 5):
        dim = sample.shape[1]
        self.mean, self.directions, self.tables = np.zeros(dim), np.zeros((dim, 0)), [np.zeros(0, np.int64)]
        key_bits = 0 if rows <= FEW else max(4, min(24, dim, round(math.log2(rows / 64))))
        while key_bits and not self.deal(sample, key_bits, cosine, seed):
            key_bits -= 1
        if not key_bits:
            self.directions, self.tables = np.zeros((dim, 0)), [np.zeros(0, np.int64)]

    def deal(self, sample: np.ndarray, key_bits: int, cosine: float, seed: int) -> bool:
        """Draw tables of that many bits; whether enough partners meet in them."""
        random = np.random.default_rng(seed)
        unit = scaled(sample)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        dim = unit.shape[1]
        self.mean = unit.mean(axis=0)
        # Partners of the sample at the least cosine, in random directions.
        side = random.normal(size=unit.shape)
        side -= (side * unit).sum(axis=1, keepdims=True) * unit
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
        partner = cosine * unit + math.sqrt(1 - cosine * cosine) * side if dim > 1 else unit
        self.directions, self.tables = np.zeros((dim, 0)), []
        met = np.zeros(len(unit), bool)
        while met.mean() < FOUND and len(self.tables) < TABLES:
            turned = rotation(unit - self.mean, dim, random)
            start = self.directions.shape[1]
            self.directions = np.hstack([self.directions, turned])
            apart = ((unit - self.mean) @ turned >= 0) != ((partner - self.mean) @ turned >= 0)
            order = random.permutation(turned.shape[1])
            width = min(key_bits, len(order))
            for at in range(0, len(order) - width + 1, width):
                bits = order[at : at + width]
                self.tables.append(start + bits)
                met |= ~apart[:, bits].any(axis=1)
        return met.mean() >= FOUND

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Key of each scaled vector in each table."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        bits = (unit - self.mean) @ self.directions >= 0
        return np.stack([(bits[:, t] << np.arange(len(t))).sum(axis=1) for t in self.tables], axis=1)


def linked_pairs(left: np.ndarray, right: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with at least that cosine, inside one block or between two."""
    other = left if right is None else right
    norm = np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(other, axis=1)[None, :]
    hit = left @ other.T / norm >= cosine
    return np.nonzero(np.triu(hit, 1) if right is None else hit)


def unit_links(ids, counts, keys, vectors, block, table, low, high, cosine):
    """Per vector of a unit: links found here first, and the smallest id that they reach."""
    n = len(ids)
    if low == high:
        a, b = linked_pairs(vectors, None, cosine)
    else:
        first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
        if not len(first) or not len(second):
            return None
        a, b = linked_pairs(vectors[first], vectors[second], cosine)
        a, b = first[a], second[b]
    fresh = ~(keys[a, :table] == keys[b, :table]).any(axis=1)
    a, b = a[fresh], b[fresh]
    if not len(a):
        return None
    links = np.bincount(a, counts[b], n) + np.bincount(b, counts[a], n)
    label = ids.copy()
    while True:
        lower = label.copy()
        np.minimum.at(lower, a, label[b])
        np.minimum.at(lower, b, label[a])
        if (lower == label).all():
            break
        label = lower
    found = np.flatnonzero(links)
    return ids[found], links[found].astype(np.int64), label[found]


def near_vectors(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, block: int = BLOCK
) -> DataFrame:
    """(id, n_links, component_id, kept) of every id.

    Vectors that are null, empty, zero, or hold a null or a component that isn't finite link with
    nothing; vectors of any other size link with those of their length. An id that repeats keeps
    the smallest of its vectors (a null or unsound one first), null ids go. n_links counts other
    ids linked directly. Other columns don't matter; an empty table gives an empty one.
    """
    spark = df.sparkSession
    value = F.col(vector).cast("array<double>")
    sound = (
        F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    given = df.select(F.col(vec_id).cast("bigint").alias("id"), value.alias("v")).where("id is not null")
    given = given.withColumn("v", F.when(sound, F.transform("v", lambda x: x + F.lit(0.0))))
    rows = settle_rows(given.groupBy("id").agg(F.min("v").alias("v")))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = settle_rows(classes.withColumn("d", F.size("v")))
    # A row for each length of vectors.
    lengths = classes.groupBy("d").count().orderBy("d").collect()
    alone = rows.select(
        F.col("id").alias(vec_id), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
    )
    if not lengths:
        return alone

    def fitted(length: int, count: int) -> Index:
        if count <= FEW:
            return Index(np.zeros((0, length)), count, cosine)
        sample = classes.where(F.col("d") == length).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect()
        return Index(np.array([r["v"] for r in sample]), count, cosine)

    index = Shared(spark, {r["d"]: fitted(r["d"], r["count"]) for r in lengths})

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for length in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == length)))
                flat = scaled(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                keys = index.value[int(length)].keys(flat).astype(np.int32)
                arrays = [
                    pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
                    for x in (flat, keys)
                ]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("rep", "n", "d")], *arrays], names=["rep", "n", "d", "v", "keys"])

    coded = settle_rows(
        classes.select("rep", "n", "d", "v").mapInArrow(keyed, "rep bigint, n bigint, d int, v array<double>, keys array<int>")
    )
    entries = coded.select("rep", "d", F.posexplode("keys").alias("t", "k"))
    sizes = entries.groupBy("d", "t", "k").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = entries.join(sizes, ["d", "t", "k"]).selectExpr(
        "rep", "d", "t", "k", f"cast(ceil(size / {block}) as int) as blocks"
    ).selectExpr("rep", "d", "t", "k", "blocks", "cast(pmod(xxhash64(rep, 3), blocks) as int) as own")
    units = met.select("rep", "d", "t", "k", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).selectExpr(
        "rep", "d", "t", "k", "own", "least(own, other) as lo", "greatest(own, other) as hi"
    )
    work = (
        units.join(coded.drop("d"), "rep")
        .select("d", "t", "k", "lo", "hi", "own", "rep", "n", "v", "keys")
        .repartition("d", "t", "k", "lo", "hi")
        .sortWithinPartitions("d", "t", "k", "lo", "hi")
    )

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "links", "label"]

        def settled(table: pa.Table, edges: list[int]) -> Iterator[pa.RecordBatch]:
            heads = [table.column(c).to_numpy() for c in ("t", "lo", "hi", "own", "rep", "n")]
            lists = [table.column(c).combine_chunks() for c in ("v", "keys")]
            out = []
            for start, end in zip(edges[:-1], edges[1:]):
                t, lo, hi, own, ids, n = (h[start:end] for h in heads)
                size = end - start
                flat, keys = (x.slice(start, size).flatten().to_numpy(zero_copy_only=False).reshape(size, -1) for x in lists)
                made = unit_links(ids, n, keys, flat, own, int(t[0]), lo[0], hi[0], cosine)
                if made is not None:
                    out.append(made)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            for start in range(0, batch.num_rows, 2_000):
                part = pa.Table.from_batches([batch.slice(start, 2_000)])
                held = part if held is None else pa.concat_tables([held, part])
                marks = np.stack([held.column(c).to_numpy() for c in ("d", "t", "k", "lo", "hi")])
                cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
                if len(cuts):
                    yield from settled(held.slice(0, cuts[-1]), [0, *cuts.tolist()])
                    held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from settled(held, [0, held.num_rows])

    found = settle_rows(work.mapInArrow(compared, "rep bigint, links bigint, label bigint"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.where("rep <> label"), "rep", "label").withColumnRenamed("node", "rep")
    summary = settle_rows(classes.select("v", "rep", "n").join(links, "rep", "left").join(groups, "rep", "left"))
    summary = summary.select(
        F.col("v").alias("cv"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"),
    )
    return rows.join(summary, F.col("v") == F.col("cv"), "left").select(
        F.col("id").alias(vec_id),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        (F.col("id") == F.coalesce("component", "id")).alias("kept"),
    )
