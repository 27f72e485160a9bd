"""Trie of the turns that conversations begin with, as flat arrays over perfectly hashed slots.

A prefix is known by a digest of 128 bits: the sum, per position, of hashes of (position, role,
text), so digests are running totals and a very long conversation needs no single task. Distinct
prefixes are enumerated per shard of conversations, each gets a slot of a minimal perfect hash
whose key is verified, counts are scattered into flat arrays by slot, and what a subtree holds is
added along the array of parent slots, the deepest level first. A node counts in full only in the
shard that has its smallest conversation, so sums over shards are sums over the trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelpulse.functions.joins import lookup_join
from modelpulse.functions.ordering import into_slices, number_rows, running_totals
from modelpulse.functions.storage import settle_counted, settle_rows

#: Rows of a shard, about, and shards at least.
SHARD_ROWS, SHARDS = 50_000, 32
#: Levels of a shard; deeper turns of its conversations are in further shards.
LEVELS = 1_024
#: A level of the perfect hash has so many places per key.
ROOM = 1.5

KEY = ("_a", "_b")
PARENT = ("_pa", "_pb")


# --- turns and digests ------------------------------------------------------------------------


def turns_of(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, pos, f1, f2, size) of conversations, numbered from 0 by turn, null first.

    Turns of one number come by role, then text. f1 and f2 are a fingerprint of (role, text).
    """
    own = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    numbered = number_rows(own, ["conv_id"], ["turn", "role", "text"], "pos")
    return numbered.select(
        "conv_id", "pos",
        F.xxhash64(F.lit(1), "role", F.lit(7), "text").alias("f1"),
        F.xxhash64(F.lit(2), "text", F.lit(9), "role").alias("f2"),
        F.length("text").cast("bigint").alias("size"),
    )


def with_digests(turns: DataFrame) -> DataFrame:
    """Add the digests of the prefix up to and without each turn (_a, _b and _pa, _pb).

    Takes (conv_id, depth, f1, f2, size); the turnless prefix is a row of depth 0.
    """
    def part(no: int) -> Column:
        hashed = F.xxhash64(F.lit(no // 2), "depth", "f1", "f2")
        half = F.shiftrightunsigned(hashed, 32) if no % 2 else hashed.bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(F.col("depth") > 0, half).otherwise(F.lit(0).cast("bigint"))

    names = [f"_s{k}" for k in range(4)]
    summed = running_totals(turns, ["conv_id"], ["depth"], {n: part(k) for k, n in enumerate(names)})
    upto = [F.col(n) + part(k) for k, n in enumerate(names)]
    return summed.select(
        *turns.columns,
        F.xxhash64(F.lit(1), "depth", *upto[:2]).alias("_a"),
        F.xxhash64(F.lit(2), "depth", *upto[2:]).alias("_b"),
        F.when(F.col("depth") > 0, F.xxhash64(F.lit(1), F.col("depth") - 1, *names[:2])).alias("_pa"),
        F.when(F.col("depth") > 0, F.xxhash64(F.lit(2), F.col("depth") - 1, *names[2:])).alias("_pb"),
    )


# --- slots ------------------------------------------------------------------------------------


def _mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    x = a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((seed + 1) * 0xD6E8FEB86659FD93 % 2**64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Slots:
    """Minimal perfect hash of distinct pairs of 64-bit keys, with the keys to verify it.

    A level gives each key a place; keys alone at theirs get the slot of its rank, the others go
    to the next level. All slots from 0 to n - 1 are taken.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        left = np.arange(len(a))
        slot = np.empty(len(a), np.int64)
        self.levels: list[tuple[np.ndarray, int]] = []
        given = 0
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("two prefixes share a digest")
            size = max(1, int(ROOM * len(left)))
            place = (_mixed(a[left], b[left], len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            rank = np.where(alone, np.cumsum(alone) - 1 + given, -1)
            self.levels.append((rank, size))
            done = alone[place]
            slot[left[done]] = rank[place[done]]
            given += int(alone.sum())
            left = left[~done]
        self.slot = slot
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[slot], self.b[slot] = a, b

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 where the table doesn't hold the key."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for no, (rank, size) in enumerate(self.levels):
            if not len(left):
                break
            place = (_mixed(a[left], b[left], no) % np.uint64(size)).astype(np.int64)
            out[left] = rank[place]
            left = left[rank[place] < 0]
        held = np.flatnonzero(out >= 0)
        wrong = held[(self.a[out[held]] != a[held]) | (self.b[out[held]] != b[held])]
        out[wrong] = -1
        return out


SHARD_SCHEMA = "_a bigint, _b bigint, parent_conv_id bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def _shard(table: pa.Table) -> pa.Table:
    """Parts of a shard's nodes in the sums over the trie.

    Rows that aren't `shown` are the last level of the shard above; they only count children.
    """
    column = lambda n: table.column(n).to_numpy()
    keys = lambda names: tuple(
        table.column(n).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for n in names
    )
    a, b = keys(KEY)
    slots = Slots(a, b)
    at, n = slots.slot, len(a)

    def scattered(name: str) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[at] = column(name)
        return out

    depth, conv, shown = scattered("depth"), scattered("conv_id"), scattered("shown")
    saved, leaves, owned = scattered("saved"), scattered("leaves"), scattered("owned")
    parent = np.full(n, -1, np.int64)
    parent[at] = slots.find(*keys(PARENT))
    parent[depth == 0] = -1
    if (depth[parent[parent >= 0]] != depth[parent >= 0] - 1).any():
        raise ValueError("two prefixes share a digest")
    children = np.zeros(n, np.int64)
    inside = np.flatnonzero(parent >= 0)
    np.add.at(children, parent[inside], owned[inside])
    deepest_first = inside[np.argsort(-depth[inside], kind="stable")]
    edges = np.flatnonzero(np.diff(depth[deepest_first])) + 1
    for level in np.split(deepest_first, edges):
        np.add.at(saved, parent[level], saved[level])
        np.add.at(leaves, parent[level], leaves[level])
    above = np.where(parent >= 0, conv[parent], 0)
    return pa.table(
        {
            "_a": slots.a.view(np.int64), "_b": slots.b.view(np.int64),
            "parent_conv_id": pa.array(above, mask=parent < 0), "n_children": children,
            "n_leaves": leaves * shown, "saved_tokens": saved * shown,
        }
    )


# --- ends -------------------------------------------------------------------------------------


def _hash_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per key from the parts of its list, which come in order."""
    key, state, done = None, None, []
    for batch in batches:
        for a, b, ids in zip(*(batch.column(n).to_pylist() for n in (*KEY, "ids"))):
            if (a, b) != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*KEY, "ends_sha256"])
            done = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=[*KEY, "ends_sha256"])


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """SHA-256 (_a, _b, ends_sha256) of the ascending conversations that end at each node.

    The list of a node is cut along the order of its conversations into parts of at most a slice;
    only the parts meet in one task, which hashes them one after the other and holds none back.
    """
    sliced = into_slices(ends.select(*KEY, "conv_id"), KEY, ["conv_id"])
    parts = sliced.groupBy(*KEY, "_slice").agg(
        F.min("conv_id").alias("first"),
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"),
    )
    dealt = parts.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids")
    return dealt.mapInArrow(_hash_parts, "_a bigint, _b bigint, ends_sha256 string")


# --- trie -------------------------------------------------------------------------------------


def _below(rows: DataFrame, nodes: DataFrame, shard: Column) -> DataFrame:
    """What conversations of more than LEVELS turns hold below the last level of each shard.

    Their turns are summed per block of levels, the blocks below are added up, and the sum goes
    to the node at the bottom of the block.
    """
    long = rows.groupBy("conv_id").agg(F.max("depth").alias("_end")).where(F.col("_end") >= LEVELS).select("conv_id")
    deep = lookup_join(rows, settle_rows(long), ["conv_id"], "left_semi").select("conv_id", "depth", "size", *KEY)
    owner = nodes.select(*KEY, F.col("conv_id").alias("_owner"), "childless")
    own = F.col("conv_id") == F.col("_owner")
    block = F.floor(F.col("depth") / F.lit(LEVELS)).cast("bigint")
    per_block = (
        deep.join(owner, list(KEY))
        .groupBy("conv_id", block.alias("_block"))
        .agg(
            F.sum(F.when(own, 0).otherwise(F.col("size"))).alias("_saved"),
            F.sum((own & F.col("childless")).cast("bigint")).alias("_leaves"),
            F.max_by(F.struct(*KEY), "depth").alias("_bottom"),
        )
    )
    later = "over (partition by conv_id order by _block desc rows between unbounded preceding and 1 preceding)"
    carried = per_block.selectExpr(
        "*", f"sum(_saved) {later} as _more_saved", f"sum(_leaves) {later} as _more_leaves"
    ).where("_more_saved is not null")
    return (
        carried.select(shard.alias("_shard"), "_block", "_bottom.*", "_more_saved", "_more_leaves")
        .groupBy("_shard", "_block", *KEY)
        .agg(F.sum("_more_saved").alias("_more_saved"), F.sum("_more_leaves").alias("_more_leaves"))
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of (conv_id, depth, f1, f2, size, last).

    A conversation has a row of depth 0 (size 0) and one for each turn from depth 1; `last` marks
    its deepest. Returns _a, _b (digest of the prefix), conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. An empty table has
    no nodes, not even a root.
    """
    rows = settle_rows(with_digests(turns))
    known = rows.agg(F.count(F.lit(1)), F.max("depth")).first()
    shards = max(SHARDS, -(-known[0] // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("conv_id"), F.lit(shards))
    # The last level of a shard stands in the shard below it too, as the parents of its first.
    block = F.floor(F.col("depth") / F.lit(LEVELS)).cast("bigint")
    stands = F.when((F.col("depth") + 1) % LEVELS == 0, F.array(block, block + 1)).otherwise(F.array(block))
    local = settle_rows(
        rows.groupBy(shard.alias("_shard"), "depth", *KEY, *PARENT).agg(
            F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("_least"), F.min("size").alias("size"),
            F.sum(F.col("last").cast("bigint")).alias("_ends"),
            F.min("f1").alias("_f1"), F.max("f1").alias("_f2"),
        )
    )
    same = F.min("_f1") == F.max("_f2")
    for c in PARENT:
        same = same & F.min(c).eqNullSafe(F.max(c))
    nodes = settle_rows(
        local.groupBy(*KEY).agg(
            F.when(same, F.min("_least")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("bigint")).alias("conv_id"),
            F.min("depth").alias("depth"),
            F.sum("n").alias("n_convs"),
            (F.sum("n") == F.sum("_ends")).alias("childless"),
        )
    )
    owner = nodes.select(*KEY, F.col("conv_id"), "childless")
    owned = F.col("_least") == F.col("conv_id")
    flagged = local.join(owner, list(KEY)).select(
        "_shard", "depth", *KEY, *PARENT, "conv_id", F.explode(stands).alias("_block"),
        (F.col("n") * F.col("size") - F.when(owned, F.col("size")).otherwise(0)).alias("_saved"),
        (owned & F.col("childless")).cast("bigint").alias("_leaves"),
        owned.cast("bigint").alias("_owned"),
    )
    if (known[1] or 0) >= LEVELS:
        flagged = flagged.join(_below(rows, nodes, shard), ["_shard", "_block", *KEY], "left")
    else:
        flagged = flagged.withColumn("_more_saved", F.lit(None)).withColumn("_more_leaves", F.lit(None))
    at_home = F.col("_block") == block
    amount = lambda c, more: F.when(at_home, F.col(c) + F.coalesce(F.col(more), F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    summed = (
        flagged.select(
            "_shard", "_block", "depth", "conv_id", *KEY, *PARENT, amount("_saved", "_more_saved").alias("saved"),
            amount("_leaves", "_more_leaves").alias("leaves"), "_owned", at_home.cast("bigint").alias("shown"),
        )
        .withColumnRenamed("_owned", "owned")
        .groupBy("_shard", "_block")
        .applyInArrow(_shard, SHARD_SCHEMA)
        .groupBy(*KEY)
        .agg(
            F.min("parent_conv_id").alias("parent_conv_id"),
            *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
        )
    )
    hashed = digests_of_ends(rows.where("last"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.join(summed, list(KEY))
        .join(hashed, list(KEY), "left")
        .select(
            *KEY, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )


def own_turns(conversations: DataFrame) -> DataFrame:
    """Conversations as they are, in the form that `prefix_trie` takes."""
    turns = turns_of(conversations)
    sizes, n = settle_counted(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total")))
    return _with_roots(
        lookup_join(turns, sizes, ["conv_id"], rows=n, spread_by=["pos"]).select(
            "conv_id", (F.col("pos") + 1).alias("depth"), "f1", "f2", "size", "total"
        ),
        sizes,
    )


def _with_roots(turns: DataFrame, totals: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    roots = totals.select(
        "conv_id", zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), zero.alias("size"), "total"
    )
    return turns.unionByName(roots).select(
        "conv_id", "depth", "f1", "f2", "size", (F.col("depth") == F.col("total")).alias("last")
    )


def rebuilt_turns(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Conversations that begin like the first of their group, in the form `prefix_trie` takes.

    Conversation c begins with the first h = crc32(c) % heads turns of c - c % group, as many as
    it has, and goes on with its own turns after its first h. A null role or text is empty; rows
    of null conv_id are left out; repeated rows are turns of their own.
    """
    turns = turns_of(conversations)
    hashed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    entry = F.struct("pos", "f1", "f2", "size")
    first = (
        turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < heads - 1))
        .groupBy(F.col("conv_id").alias("_base"))
        .agg(F.sort_array(F.collect_list(entry)).alias("_head"))
    )
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_own"))
    with_base = convs.withColumn("_base", F.col("conv_id") - F.col("conv_id") % group).join(first, "_base", "left")
    begun = F.when(F.col("_head").isNull(), F.array().cast("array<struct<pos:bigint,f1:bigint,f2:bigint,size:bigint>>"))
    begun = begun.otherwise(F.slice("_head", F.lit(1), F.col("_h").cast("int")))
    told, n = settle_counted(
        with_base.withColumn("_h", hashed)
        .withColumn("_head", begun)
        .withColumn("_taken", F.size("_head").cast("bigint"))
        .select("conv_id", "_h", "_head", "_taken", (F.col("_taken") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))).alias("total"))
    )
    taken = told.select("conv_id", "total", F.inline("_head")).select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "f1", "f2", "size", "total"
    )
    rest = (
        lookup_join(turns, told.drop("_head"), ["conv_id"], rows=n, spread_by=["pos"])
        .where(F.col("pos") >= F.col("_h"))
        .select("conv_id", (F.col("pos") - F.col("_h") + F.col("_taken") + 1).alias("depth"), "f1", "f2", "size", "total")
    )
    return _with_roots(taken.unionByName(rest), told)
