"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a chunk of texts lie behind one another in one array of symbols. A
round looks up the rank of every pair of neighbours, finds the lowest rank in each sequence and
merges that pair in all sequences at once, wherever it stands in them. Sequences without a pair
to merge leave. What is left of each is its count; no ids are kept.

A round touches all symbols of the sequences still in it, which would take the square of a very
long one. Such a sequence is merged by itself: the places of its pairs are kept per rank, a round takes
the lowest rank there is and looks at the neighbours of what it merged only.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelpulse.llm.common import Shared, with_arrow_columns
from modelpulse.llm.pretokens import PreTokenizer, byte_symbols, load

#: Stretches whose count a worker keeps; beyond, it starts anew.
KEPT_WORDS = 500_000
NONE = np.iinfo(np.int64).max
#: Bytes from which a pre-token is merged by itself.
LONG = 1_024


class Counter:
    """A tokenizer file as arrays: sorted keys of the pairs, their ranks and what they become."""

    def __init__(self, spec: dict):
        self.pre = PreTokenizer(spec)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        self.keys = np.append(keys, -1)
        self.tables = self._hashed(keys)
        self.becomes = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.known: dict[str, int] = {}

    @staticmethod
    def _hashed(keys: np.ndarray) -> list[tuple[np.uint64, np.ndarray]]:
        """Tables from a pair's hash to its rank; what a table has no room for is in the next."""
        tables, left, bits = [], np.arange(len(keys)), 20
        while len(left):
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * len(tables))
            slot = (keys[left].astype(np.uint64) * factor) >> np.uint64(64 - bits)
            table = np.full(1 << bits, len(keys), np.int32)
            table[slot] = left
            tables.append((factor, table))
            left = left[table[slot] != left]
            bits = 16
        return tables

    def rank_of(self, key: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NONE for a pair that doesn't merge."""
        rank = np.full(len(key), NONE, np.int64)
        hashed = key.astype(np.uint64)
        for factor, table in self.tables:
            bits = len(table).bit_length() - 1
            at = table[(hashed * factor) >> np.uint64(64 - bits)]
            found = self.keys[at] == key
            rank[found] = at[found]
        return rank

    def merged(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        raw = [w.encode("utf-8") for w in words]
        out = np.zeros(len(raw), np.int64)
        short = [i for i, r in enumerate(raw) if len(r) < LONG]
        if short:
            out[short] = self._side_by_side([raw[i] for i in short])
        for i, r in enumerate(raw):
            if len(r) >= LONG:
                out[i] = self._alone(r)
        return out

    def _alone(self, raw: bytes) -> int:
        """Surviving symbols of one long pre-token; work grows with its merges, not with rounds times length."""
        data = np.frombuffer(raw, np.uint8)
        symbols = self.inner[data]
        symbols[-1] = self.last[data[-1]]
        n = len(symbols)
        # Neighbours of each symbol that is left; n stands for none on either side.
        after, before = np.arange(1, n + 1), np.append(np.arange(-1, n - 1), n)
        before[0] = n
        gone = np.zeros(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def rank_at(places: np.ndarray) -> np.ndarray:
            return self.rank_of(symbols[places] * self.width + symbols[after[places]])

        def wait(places: np.ndarray) -> None:
            places = places[after[places] < n]
            rank = rank_at(places)
            places, rank = places[rank < NONE], rank[rank < NONE]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            starts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else rank
            for r, group in zip(rank[starts].tolist(), np.split(places, starts[1:])):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(group)

        wait(np.arange(n - 1))
        while ranks:
            rank = heapq.heappop(ranks)
            # Places may have been merged away or have another pair by now.
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[~gone[places]]
            places = places[after[places] < n]
            places = places[rank_at(places) == rank]
            if not len(places):
                continue
            # Of touching pairs (a a a) every second from the left is merged.
            touches = np.append(False, after[places[:-1]] == places[1:])
            run = np.maximum.accumulate(np.where(touches, 0, np.arange(len(places))))
            places = places[(np.arange(len(places)) - run) % 2 == 0]
            eaten = after[places]
            symbols[places] = self.becomes[rank]
            gone[eaten] = True
            after[places] = after[eaten]
            before[after[places]] = places
            left = before[places]
            wait(np.unique(np.concatenate([places, left[left < n]])))
        return n - int(gone.sum())

    def _side_by_side(self, raw: list[bytes]) -> np.ndarray:
        """Surviving symbols of each of many pre-tokens, every one not empty."""
        counts = np.array([len(r) for r in raw], np.int64)
        done = counts.copy()
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(counts) - 1
        symbols[ends] = self.last[data[ends]]
        owner = np.repeat(np.arange(len(raw)), counts)
        while len(symbols) > 1:
            # Rank of the pair that begins at each place.
            key = symbols[:-1] * self.width + symbols[1:]
            rank = np.append(self.rank_of(key), NONE)
            rank[:-1][owner[:-1] != owner[1:]] = NONE
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(first, len(owner)))
            lowest = np.minimum.reduceat(rank, first)
            alive = lowest < NONE
            done[owner[first]] = size
            if not alive.any():
                break
            hit = (rank == np.repeat(lowest, size)) & (rank < NONE)
            # Of touching pairs (a a a) every second from the left is merged.
            touching = np.flatnonzero(hit[1:] & hit[:-1]) + 1
            if len(touching):
                run = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
                places = np.flatnonzero(hit)
                since = places - run[np.searchsorted(run, places, "right") - 1]
                hit[places[since % 2 == 1]] = False
            where = np.flatnonzero(hit)
            symbols[where] = self.becomes[rank[where]]
            stay = np.repeat(alive, size)
            done[owner[first]] -= np.add.reduceat(hit.astype(np.int64), first)
            stay[where + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return done

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, special strings in it included."""
        known, fixed, held = self.known, [], []
        for text in texts:
            specials, chunks = 0, []
            for segment in self.pre.segments(text):
                if isinstance(segment, int):
                    specials += 1
                else:
                    chunks += self.pre.chunks(segment)
            fixed.append(specials)
            held.append(chunks)
        new = list({c for chunks in held for c in chunks if c not in known})
        if new:
            if len(known) + len(new) > KEPT_WORDS:
                known.clear()
                new = list({c for chunks in held for c in chunks})
            parts = [self.pre.split(c) for c in new]
            sizes = self.merged(words) if (words := [w for p in parts for w in p]) else np.zeros(0, np.int64)
            before = np.concatenate([[0], np.cumsum(sizes)])
            edge = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            known.update(zip(new, (before[edge[1:]] - before[edge[:-1]]).tolist()))
        return [n + sum(map(known.__getitem__, chunks)) for n, chunks in zip(fixed, held)]


def count_tokens(spark: SparkSession, df: DataFrame, text: str, path: str, limit: int = 2048) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit) to every row.

    Null and empty texts have 0 of either. Columns of these names are replaced; repeated rows
    are counted each.
    """
    counter = Shared(spark, Counter(load(path)))

    def work(texts: list[str]) -> list[list]:
        return [counter.value.count(texts)]

    sized = with_arrow_columns(df, text, {"n_tokens": T.LongType()}, work)
    return sized.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint"),
            "over_limit": F.col("n_tokens") > limit,
        }
    )
