"""Stretches of text that repeat with a period, found in a grammar of the words.

Words become numbers and Re-Pair folds the most frequent neighbours into rules until no pair comes
twice. A run that lies in the expansion of a rule but in neither half crosses the border between
the halves, so it is looked for there, once per rule, however often the rule is used. What is left
of the sequence is halved like a rule. The runs of a rule are then put down at every place where
the rule stands, and of the stretches of one period only those stay that no other contains.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from modelpulse.llm.common import with_arrow_columns

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Every stretch of so many words of a run comes in the run again, one period on or back.
GRAM = 4
#: Up to so many periods are measured one by one at a border, more of them by one pass for all.
FEW = 8

RUN = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]), False
)
ADDED = {"n_runs": T.LongType(), "runs": RUN, "strongest": RUN.elementType, "collapsed": T.StringType()}

Run = tuple[int, int, int]  # start, end, period


# --- words that can lie in a run ------------------------------------------------------------


def candidate_stretches(ids: np.ndarray, text_of: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) of the words of several texts that can hold a run.

    In a run of period q every GRAM words come again q words on or back, and its stretch holds
    LEAST_TIMES periods. Words without that are cut out, again for what is left, until nothing
    changes. Equal hashes of different words only leave a stretch standing.
    """
    if len(ids) < LEAST_WORDS:
        return []
    gram = np.zeros(len(ids) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - GRAM + 1 + k].astype(np.uint64)
        gram ^= gram >> np.uint64(29)
    at = np.flatnonzero(text_of[: len(gram)] == text_of[GRAM - 1 :])
    while len(at):
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (text_of[at[1:]] != text_of[at[:-1]])
        part = np.cumsum(new) - 1
        length = np.bincount(part) + GRAM - 1
        order = np.lexsort((gram[at], part))
        same = (part[order][1:] == part[order][:-1]) & (gram[at[order]][1:] == gram[at[order]][:-1])
        step = np.where(same, np.diff(at[order]), len(ids))
        nearest = np.full(len(at), len(ids))
        nearest[order[1:]] = step
        nearest[order[:-1]] = np.minimum(nearest[order[:-1]], step)
        kept = (LEAST_TIMES * nearest <= length[part]) & (length[part] >= LEAST_WORDS)
        if kept.all():
            first = np.flatnonzero(new)
            return [(int(at[f]), int(at[f]) + int(n)) for f, n in zip(first, length)]
        at = at[kept]
    return []


# --- grammar ----------------------------------------------------------------------------------


class Grammar:
    """Rules over a sequence: symbol `base + k` stands for the pair `rules[k]`.

    `places[k]` is one place where rule k stands, `spans[k]` the words it covers; `top` has the
    symbols that are left, `starts` where they begin. Pairs of one frequency are folded in the
    order in which they came up, which keeps rules balanced inside a repeated stretch.
    """

    def __init__(self, ids: list[int]):
        n, self.base = len(ids), max(ids) + 1
        self.rules: list[tuple[int, int]] = []
        self.places: list[int] = []
        self.spans: list[int] = []
        symbol, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, pair in enumerate(pairwise(symbol)):
            where[pair].append(i)
        count = {pair: len(at) for pair, at in where.items()}
        queue = [(-c, k, pair) for k, (pair, c) in enumerate(count.items()) if c > 1]
        heapify(queue)
        turn = len(count)
        while queue:
            c, since, pair = heappop(queue)
            now = count.get(pair, 0)
            if now < 2:
                continue
            if now < -c:
                heappush(queue, (-now, since, pair))
                continue
            (left, right), made = pair, self.base + len(self.rules)
            del count[pair]
            first, came = -1, {}
            for i in where.pop(pair):
                j = after[i]
                if symbol[i] != left or j >= n or symbol[j] != right:
                    continue
                first = i if first < 0 else first
                h, k = before[i], after[j]
                symbol[i], symbol[j], after[i] = made, -1, k
                if h >= 0:
                    if (old := (symbol[h], left)) in count:
                        count[old] -= 1
                    new = (symbol[h], made)
                    came[new] = count[new] = count.get(new, 0) + 1
                    where[new].append(h)
                if k < n:
                    before[k] = i
                    if (old := (right, symbol[k])) in count:
                        count[old] -= 1
                    new = (made, symbol[k])
                    came[new] = count[new] = count.get(new, 0) + 1
                    where[new].append(i)
            for new in came:
                if count[new] > 1:
                    turn += 1
                    heappush(queue, (-count[new], turn, new))
            if first < 0:
                continue
            self.rules.append(pair)
            self.places.append(first)
            self.spans.append(self.span(left) + self.span(right))
        self.top, self.starts, i = [], [], 0
        while i < n:
            self.top.append(symbol[i])
            self.starts.append(i)
            i = after[i]
        self.starts.append(n)

    def span(self, symbol: int) -> int:
        return 1 if symbol < self.base else self.spans[symbol - self.base]


# --- runs at a border -------------------------------------------------------------------------


def _equal_ahead(w: np.ndarray, i: int, j: int, end: int) -> int:
    """Words from i on that equal those from j on, j the later, up to `end`."""
    done, step = 0, 64
    while j + done < end:
        a, b = w[i + done : i + min(done + step, end - j)], w[j + done : min(j + done + step, end)]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return done + int(differ[0])
        done, step = done + len(b), 2 * step
    return done


def _prefix_matches(s: list[int]) -> list[int]:
    """Per place, how far the list from there equals its beginning."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def runs_at(w: np.ndarray, lo: int, mid: int, hi: int) -> list[Run]:
    """Runs (start, end, period) of w[lo:hi] that hold the words on both sides of `mid`.

    The two words at the border come again one period on or back, which names the periods to
    measure. Each is measured to the right and to the left of the border.
    """
    most = (hi - lo) // LEAST_TIMES
    on, back = min(most, hi - 1 - mid), min(most, mid - 1 - lo)
    a, b = w[mid - 1], w[mid]
    later = np.flatnonzero((w[mid + 1 : mid + 1 + on] == b) & (w[mid : mid + on] == a)) + 1 if on > 0 else ()
    earlier = ()
    if back > 0:
        earlier = np.flatnonzero((w[mid - back : mid] == b)[::-1] & (w[mid - 1 - back : mid - 1] == a)[::-1]) + 1
    if not len(later) and not len(earlier):
        return []
    found: dict[tuple[int, int], int] = {}

    def note(start: int, end: int, q: int) -> None:
        if end - start >= max(LEAST_WORDS, LEAST_TIMES * q):
            found[start, end] = min(q, found.get((start, end), q))

    if len(later) + len(earlier) <= FEW:
        turned = w[::-1]
        n = len(w)
        for q in map(int, later):
            before = _equal_ahead(turned, n - mid - q, n - mid, n - lo)
            note(mid - before, mid + q + _equal_ahead(w, mid, mid + q, hi), q)
        for q in map(int, earlier):
            before = _equal_ahead(turned, n - mid, n - mid + q, n - lo)
            note(mid - q - before, mid + _equal_ahead(w, mid - q, mid, hi), q)
        return [(s, e, q) for (s, e), q in found.items()]
    whole = w[lo:hi].tolist()
    cut = mid - lo
    ahead, behind = whole[cut:], whole[:cut][::-1]
    from_mid = _prefix_matches(ahead)
    to_mid = _prefix_matches(behind)
    if len(later):
        # How far the words before mid equal those before mid + q, seen backwards.
        match = _prefix_matches([*behind, -1, *whole[::-1]])
        for q in map(int, later):
            before = match[cut + 1 + len(whole) - (cut + q)]
            note(mid - before, mid + q + from_mid[q], q)
    if len(earlier):
        match = _prefix_matches([*ahead, -1, *whole])
        for q in map(int, earlier):
            note(mid - q - to_mid[q], mid + match[len(ahead) + 1 + cut - q], q)
    return [(s, e, q) for (s, e), q in found.items()]


def _in_stretch(w: np.ndarray) -> set[Run]:
    """Runs of one stretch, some of them as parts of longer ones."""
    grammar = Grammar(w.tolist())
    rules, base, spans = grammar.rules, grammar.base, grammar.spans
    own: list[list[Run]] = []
    needed: list[bool] = []
    for (left, right), place, span in zip(rules, grammar.places, spans):
        mid = place + grammar.span(left)
        own.append(runs_at(w, place, mid, place + span) if span >= LEAST_WORDS else [])
        needed.append(bool(own[-1]) or any(s >= base and needed[s - base] for s in (left, right)))
    found: set[Run] = set()
    stands: list[list[int]] = [[] for _ in rules]
    for symbol, start in zip(grammar.top, grammar.starts):
        if symbol >= base and needed[symbol - base]:
            stands[symbol - base].append(start)
    for k in range(len(rules) - 1, -1, -1):
        if not needed[k]:
            continue
        (left, right), place = rules[k], grammar.places[k]
        for s, e, q in own[k]:
            found.update((at + s - place, at + e - place, q) for at in stands[k])
        if left >= base and needed[left - base]:
            stands[left - base].extend(stands[k])
        if right >= base and needed[right - base]:
            begin = grammar.span(left)
            stands[right - base].extend(at + begin for at in stands[k])
        stands[k] = []
    # What no rule folds is halved, so every border is crossed in one stretch of words.
    starts, halves = grammar.starts, [(0, len(grammar.top))]
    while halves:
        i, j = halves.pop()
        if j - i > 1 and starts[j] - starts[i] >= LEAST_WORDS:
            k = (i + j) // 2
            found.update(runs_at(w, starts[i], starts[k], starts[j]))
            halves += [(i, k), (k, j)]
    return found


def maximal(found: set[Run]) -> list[Run]:
    """Of the stretches of one period those that no other contains, by start, then period."""
    kept, last, upto = [], 0, -1
    for s, e, q in sorted(found, key=lambda r: (r[2], r[0], -r[1])):
        if q != last or e > upto:
            kept.append((s, e, q))
            last, upto = q, e
    return sorted(kept, key=lambda r: (r[0], r[2]))


def runs_of_texts(words: list[list[bytes]]) -> list[list[Run]]:
    """Runs of each text, its words numbered from 0."""
    sizes = np.array([len(x) for x in words], np.int64)
    out: list[list[Run]] = [[] for _ in words]
    if sizes.sum() < LEAST_WORDS:
        return out
    flat = pa.array([w for x in words for w in x], pa.binary())
    ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    text_of, begin = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
    for start, end in candidate_stretches(ids, text_of):
        no = text_of[start]
        # Numbers that are dense in the stretch; the runs don't depend on which they are.
        _, dense = np.unique(ids[start:end], return_inverse=True)
        shift = int(start - begin[no])
        out[no] += [(s + shift, e + shift, q) for s, e, q in maximal(_in_stretch(dense))]
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def _collapsed(words: list[bytes], runs: list[Run]) -> str:
    kept = np.ones(len(words), bool)
    for s, e, q in runs:
        kept[s + q : e] = False
    left = words if kept.all() else [words[i] for i in np.flatnonzero(kept)]
    return b" ".join(left).decode()


def _work(texts: list[str]) -> list[list]:
    words = [t.encode("utf-8", "replace").split() for t in texts]
    found = runs_of_texts(words)
    listed = [[(s, e - s, q) for s, e, q in runs] for runs in found]
    best = [_strongest(runs) for runs in listed]
    return [[len(r) for r in found], listed, best, [_collapsed(w, r) for w, r in zip(words, found)]]


def _strongest(runs: list[Run]) -> Run | None:
    """Of (start, length, period) the one that holds most periods; the first of equal ones."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def periodic_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the runs of every text: n_runs, runs (start, length, period), strongest, collapsed.

    Words are what blanks (space, tab to carriage return) part, numbered from 0. A run is a stretch
    with smallest period q, of at least max(6, 4q) words, that no neighbouring word extends. `runs`
    is sorted by start, then period; `strongest` has the greatest length/period, of equal ones the
    first; `collapsed` is the text of the words that no run repeats, joined by one space.

    A null or empty text has no runs, no strongest and an empty `collapsed`. Every row is worked on
    by itself, so repeated rows give equal results and an empty table an empty one. Columns with the
    names of the added ones, in any case, are replaced; other columns stay. Time and memory grow
    with the words of a text, long texts included, times the logarithm of what no rule folds.
    """
    clash = [c for c in df.columns if c.lower() in ADDED and c != text]
    if text.lower() in ADDED:
        raise ValueError(f"the text column can't be called {text}")
    return with_arrow_columns(df.drop(*clash), text, ADDED, _work)
