"""BPE as an automaton over tokens: encoding by table-driven transitions, decoding by labels.

The merges are compiled in order of rank. At first one state has an arc to itself for every
base symbol. The gadget of a merge u v -> w works on the state q that arcs labelled u lead to:
an arc labelled w is laid from each state with an arc u to where the arc v of q leads, q is
copied without its arc v, and the arcs labelled u lead to the copy. A path then spells a word
exactly in the tokens that the merges, each applied from the left, would make of it, so every
word has one path.

All arcs with the same label lead to the same state, so a label names its state, and a gadget
is one entry: from the state of u, v is gone since that rank. What else a state lacks follows
from the state it was copied from.

A word is encoded by following its path: the longest label that fits comes first, a shorter one
where no arc carries it or where it leads nowhere. A trie of the labels gives those that fit;
which arcs pass is kept in a table, so nearly every step is one lookup.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelpulse.llm.common import Shared, with_arrow_columns
from modelpulse.llm.pretokens import PreTokenizer, byte_symbols, load

#: Words whose path a worker keeps, and arcs whose passes it keeps; beyond, it starts anew.
KEPT_WORDS = 500_000
KEPT_ARCS = 500_000
NEVER = 1 << 40


class Automaton:
    """A tokenizer file, compiled."""

    def __init__(self, spec: dict):
        self.pre = PreTokenizer(spec)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.labels = [""] * (max([*vocab.values(), *self.pre.special.values()]) + 1)
        for label, no in [*vocab.items(), *self.pre.special.items()]:
            self.labels[no] = label
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.suffix] for s in symbols]
        self._compile(vocab, model["merges"])
        self._trie()
        self.paths: dict[str, tuple[int, ...]] = {}
        self.arcs: dict[int, bool] = {}

    def _compile(self, vocab: dict[str, int], merges: list) -> None:
        base = {*self.inner, *self.last}
        self.parts: dict[int, tuple[int, int]] = {}
        # Of each label: itself and its right (left) part, the right part of that, ..., each
        # with the rank of the merge that put it into the one before.
        self.right = {t: ((t, NEVER),) for t in base}
        self.left = dict(self.right)
        self.gone: dict[int, int] = {}
        self.width = len(self.labels)
        for rank, merge in enumerate(merges):
            u, v = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            w = vocab[self.labels[u] + self.labels[v]]
            if u not in self.right or v not in self.right or not self.leaves(u, v):
                continue  # no path has these two next to each other
            if w in self.right:
                raise ValueError("a token made by two merges")
            self.gone[u * self.width + v] = rank
            self.parts[w] = (u, v)
            self.right[w] = ((w, NEVER), (v, rank), *self.right[v][1:])
            self.left[w] = ((w, NEVER), (u, rank), *self.left[u][1:])

    def leaves(self, state: int, token: int) -> bool:
        """Whether an arc `token` leaves the state that arcs labelled `state` lead to.

        The state of a token is that of its right part when it was made, so what was taken
        from that part earlier is missing here too. The arc of a token was laid from where its
        left part could leave, so it is missing where that part went earlier - or by the same
        merge, which is applied from the left.
        """
        gone, width, opening = self.gone, self.width, self.left[token]
        for u, ends in self.right[state]:
            row = u * width
            for v, bound in opening:
                rank = gone.get(row + v)
                if rank is not None and rank < ends and rank <= bound:
                    return False
        return True

    def _trie(self) -> None:
        """Trie over the symbols of the labels: node -> symbol -> node, and the label at a node."""
        spelled: dict[int, list[int]] = {t: [t] for t in self.right if t not in self.parts}
        for t, (u, v) in self.parts.items():
            spelled[t] = spelled[u] + spelled[v]
        self.step: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for t, symbols in spelled.items():
            node = 0
            for s in symbols:
                if s not in self.step[node]:
                    self.step.append({})
                    self.ends.append(-1)
                    self.step[node][s] = len(self.step) - 1
                node = self.step[node][s]
            self.ends[node] = t

    def _fitting(self, symbols: list[int], at: int) -> list[tuple[int, int]]:
        """Labels that spell the symbols from `at` on, with where they end, shortest first."""
        step, ends, node, found = self.step, self.ends, 0, []
        for place in range(at, len(symbols)):
            node = step[node].get(symbols[place])
            if node is None:
                break
            if ends[node] >= 0:
                found.append((ends[node], place + 1))
        return found

    def path(self, word: str) -> tuple[int, ...]:
        """Labels of the only path that spells the pre-token."""
        raw = word.encode("utf-8")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        arcs, width, size = self.arcs, self.width, len(symbols)
        path: list[int] = []
        reached: list[int] = []
        waiting = [self._fitting(symbols, 0)]
        dead: set[tuple[int, int]] = set()
        while True:
            fitting = waiting[-1]
            while fitting:
                token, end = fitting.pop()
                if path:
                    key = path[-1] * width + token
                    passes = arcs.get(key)
                    if passes is None:
                        if len(arcs) >= KEPT_ARCS:
                            arcs.clear()
                        passes = arcs[key] = self.leaves(path[-1], token)
                    if not passes or (dead and (token, end) in dead):
                        continue
                path.append(token)
                reached.append(end)
                if end == size:
                    return tuple(path)
                waiting.append(self._fitting(symbols, end))
                break
            else:
                # Nothing goes on from here: back to the label before.
                waiting.pop()
                dead.add((path.pop(), reached.pop()))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; a null text has none."""
        out: list[int] = []
        paths = self.paths
        for segment in self.pre.segments(text or ""):
            if isinstance(segment, int):
                out.append(segment)
                continue
            for chunk in self.pre.chunks(segment):
                ids = paths.get(chunk)
                if ids is None:
                    if len(paths) >= KEPT_WORDS:
                        paths.clear()
                    words = self.pre.split(chunk)
                    ids = paths[chunk] = sum(map(self.path, words), ()) if len(words) != 1 else self.path(words[0])
                out += ids
        return out

    def decode(self, ids) -> str:
        """The labels of the arcs, joined by a space as the library does without a decoder."""
        labels = self.labels
        return " ".join([labels[i] for i in ids])


def compiled(spark: SparkSession, path: str) -> Shared:
    """The automaton of a tokenizer file, sent to the executors. Its size is that of the file."""
    return Shared(spark, Automaton(load(path)))


def encode(df: DataFrame, text: str, automaton: Shared, out: str = "ids") -> DataFrame:
    """Add the ids of every text. Null and empty texts have an empty array; rows are kept."""

    def work(texts: list[str]) -> list[list]:
        machine = automaton.value
        return [[machine.encode(t) for t in texts]]

    return with_arrow_columns(df, text, {out: T.ArrayType(T.IntegerType(), False)}, work)


def round_trip(df: DataFrame, text: str, automaton: Shared, out: str = "ids", back: str = "decoded") -> DataFrame:
    """Add the ids of every text and the text that they decode to, by one pass through Python."""

    def work(texts: list[str]) -> list[list]:
        machine = automaton.value
        ids = [machine.encode(t) for t in texts]
        return [ids, [machine.decode(i) for i in ids]]

    return with_arrow_columns(df, text, {out: T.ArrayType(T.IntegerType(), False), back: T.StringType()}, work)


def decode(ids: str, automaton: Shared) -> Column:
    """The text that the ids stand for; null for null, empty for no ids."""

    @F.pandas_udf(T.StringType())
    def labels(batch: pd.Series) -> pd.Series:
        machine = automaton.value
        return batch.map(lambda x: None if x is None else machine.decode(x.tolist()))

    return labels(F.col(ids))
