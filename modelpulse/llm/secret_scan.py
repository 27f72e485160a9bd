"""Credentials in texts: fixed forms, and strings of high entropy in any place.

A string of the characters of a class is a candidate. A window slides over it, and the number of
each character in the window changes by the one that enters and the one that leaves, and so does
the entropy. Windows with enough bits, joined where they touch, are reported unless the candidate
has a form that is known to be harmless. All of it is columns of the text; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelpulse.llm.common import fresh, let

# Fixed forms of the base kinds.
_EITHER = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_NAMES = "|".join(_EITHER(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = f"(?:{_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 12
#: A run of capitals and digits that is too short at its first AKIA is so at every later one.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class Charset:
    """Characters that make a candidate, and the bits per character from which a window counts.

    `window` characters are looked at together; shorter strings are no candidates.
    """

    kind: str
    characters: str
    pattern: str
    window: int
    bits: float


DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CHARSETS = (
    Charset("hex_entropy", DIGITS + LOWER[:6] + LOWER[:6].upper(), "[0-9A-Fa-f]", 24, 3.1),
    Charset("base64_entropy", DIGITS + LOWER + LOWER.upper() + "+/_-", "[A-Za-z0-9+/_-]", 24, 3.9),
)
#: Candidates that hold one of these are left out: ids and numbers, words, counted alphabets,
#: placeholders.
ALLOWED = (
    "^[0-9]+$",
    "^[A-Z]?[a-z]+$",
    "^[A-Z]+$",
    "^([A-Za-z]+[_/-])*[A-Za-z]+$",
    "0123456789|abcdefghij|ABCDEFGHIJ",
    "[eE][xX][aA][mM][pP][lL][eE]|[sS][aA][mM][pP][lL][eE]|[pP][lL][aA][cC][eE][hH][oO][lL][dD]|[xX]{6}",
    "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
)
#: n * log2(n) is held in whole parts of this size, so that sums are exact in any order.
PARTS = 1_000_000
#: Matches that are added up together; the blocks are added up after that.
BLOCK = 256


def weight(n: int) -> int:
    """n * log2(n) in whole parts."""
    return round(PARTS * n * log2(n)) if n > 1 else 0


def most_weight(charset: Charset) -> int:
    """Sum of weights up to which a window has enough bits."""
    return int(PARTS * charset.window * (log2(charset.window) - charset.bits))


# --- places of matches ------------------------------------------------------------------------


def _starts(gaps: Column, sizes: Column, n: Column) -> Column:
    """Place of each match from the lengths of what stands before it and of the matches."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")),
        lambda b: F.aggregate(
            F.zip_with(
                F.slice(gaps, b * BLOCK + 1, BLOCK), F.slice(sizes, b * BLOCK + 1, BLOCK),
                lambda gap, size: F.struct(gap.alias("gap"), size.alias("size")),
            ),
            F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("at")),
            lambda s, x: F.struct(
                (s["upto"] + x["gap"] + x["size"]).alias("upto"), F.concat(s["at"], F.array(s["upto"] + x["gap"])).alias("at")
            ),
        ),
    )
    return let(
        blocks,
        lambda done: let(
            F.aggregate(
                done,
                F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("at")),
                lambda s, x: F.struct((s["upto"] + x["upto"]).alias("upto"), F.concat(s["at"], F.array(s["upto"])).alias("at")),
            )["at"],
            lambda before: F.flatten(F.zip_with(done, before, lambda x, add: F.transform(x["at"], lambda a: a + add))),
        ),
    )


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches that don't overlap: array of (start, end, body), in code points.

    `body` is the group of that number.
    """
    none = F.array().cast("array<struct<start:int,end:int,body:string>>")

    def placed(found: Column) -> Column:
        sizes = F.transform(found, F.length)
        # One more piece stands after the last match.
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found))
        bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        return let(
            sizes,
            lambda size: F.zip_with(
                F.zip_with(_starts(gaps, size, F.size(size)), size, lambda at, n: F.struct(at.alias("start"), (at + n).alias("end"))),
                bodies,
                lambda x, body: F.struct(x["start"].alias("start"), x["end"].alias("end"), body.alias("body")),
            ),
        )

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)),
    )


# --- entropy ----------------------------------------------------------------------------------


def dense_windows(body: Column, charset: Charset) -> Column:
    """Stretches (from, to) of a candidate that windows of enough bits cover, joined where they touch."""
    width = charset.window
    of = F.array(*[F.lit(weight(n)).cast("bigint") for n in range(width + 1)])
    step = lambda n: F.element_at(of, n + 2) - F.element_at(of, n + 1)  # noqa: E731  from n of a character to n + 1
    stretch = "array<struct<from:int,to:int>>"
    places = F.array(*[F.lit(c) for c in charset.characters])
    codes = F.transform(F.slice(F.split(body, ""), F.lit(1), F.length(body)), lambda c: F.array_position(places, c).cast("int"))

    def slide(code: Column) -> Column:
        begin = F.struct(
            F.array_repeat(F.lit(0), len(charset.characters)).alias("count"),
            F.lit(0).cast("bigint").alias("sum"),
            F.lit(-1).alias("from"),
            F.lit(-1).alias("to"),
            F.array().cast(stretch).alias("done"),
        )

        def move(s: Column, i: Column) -> Column:
            enters = F.element_at(code, i)
            leaves = F.when(i > width, F.element_at(code, F.greatest(i - width, F.lit(1)))).otherwise(F.lit(0))
            more = step(F.element_at(s["count"], enters))
            less = F.when(leaves > 0, step(F.element_at(s["count"], F.greatest(leaves, F.lit(1))) - 1)).otherwise(F.lit(0))
            moved = F.transform(s["count"], lambda n, j: n + (j + 1 == enters).cast("int") - (j + 1 == leaves).cast("int"))
            # A character that enters as its like leaves changes nothing.
            return let(
                F.when(enters == leaves, s["sum"]).otherwise(s["sum"] + more - less),
                lambda now: let(
                    (i >= width) & (now <= most_weight(charset)),
                    lambda hit: let(
                        hit & (s["to"] >= i - width),
                        lambda joins: F.struct(
                            F.when(enters == leaves, s["count"]).otherwise(moved).alias("count"),
                            now.alias("sum"),
                            F.when(hit & ~joins, i - width).otherwise(s["from"]).alias("from"),
                            F.when(hit, i).otherwise(s["to"]).alias("to"),
                            F.when(hit & ~joins & (s["to"] >= 0), _and_open(s)).otherwise(s["done"]).alias("done"),
                        ),
                    ),
                ),
            )

        def _and_open(s: Column) -> Column:
            return F.concat(s["done"], F.array(F.struct(s["from"].alias("from"), s["to"].alias("to"))))

        end = lambda s: F.when(s["to"] >= 0, _and_open(s)).otherwise(s["done"])
        return F.aggregate(F.sequence(F.lit(1), F.size(code)), begin, move, end)

    return let(codes, slide)


def entropy_spans(text: Column, charset: Charset, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Spans (start, end) of a text that are dense enough, candidates of harmless forms left out."""
    harmless = lambda c: reduce(or_, [c["body"].rlike(p) for p in allowed], F.lit(False))
    found = F.filter(matches(text, f"{charset.pattern}{{{charset.window},}}"), lambda c: ~harmless(c))
    inner = lambda c: F.transform(
        dense_windows(c["body"], charset),
        lambda d: F.struct((c["start"] + d["from"]).alias("start"), (c["start"] + d["to"]).alias("end")),
    )
    return F.flatten(F.transform(found, inner))


# --- scan -------------------------------------------------------------------------------------


def scan(
    docs: DataFrame, text: str = "text", charsets: tuple[Charset, ...] = CHARSETS, allowed: tuple[str, ...] = ALLOWED
) -> DataFrame:
    """Add `base_spans` and `spans`: arrays of (start, kind_no, end, kind) in code points, sorted.

    Base kinds: assign (a name of a credential given a value of 12 characters or more), access
    (AKIA and 14 or more capitals and digits) and hex (16 or more of 0-9a-f), each leftmost and
    without overlaps inside its kind. `spans` has them and the dense stretches of each charset, which
    may lie over base spans. A span ends before `end`; equal starts come in the order of kinds.

    A null text is an empty one and has no spans. A text is scanned whole, whatever its length; the
    work is in proportion to it. Rows are worked on one by one: repeated rows give equal results and
    an empty table an empty one. Columns called like the added ones, in any case, are replaced; other
    columns stay.
    """
    added = ("base_spans", "spans")
    if text.lower() in added:
        raise ValueError(f"the text column can't be called {text}")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    kinds = [*BASE_KINDS, *[c.kind for c in charsets]]
    given = fresh(docs.columns, "scanned")
    whole = F.col(given)

    def named(spans: Column, kind: str) -> Column:
        return F.transform(
            spans,
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(kinds.index(kind)).alias("kind_no"), m["end"].alias("end"), F.lit(kind).alias("kind")
            ),
        )

    assigned = F.filter(matches(whole, ASSIGN, 1), lambda m: F.length(m["body"]) >= ASSIGN_LEAST)
    base = F.concat(named(assigned, "assign"), named(matches(whole, ACCESS), "access"), named(matches(whole, HEX), "hex"))
    dense = [named(entropy_spans(whole, c, allowed), c.kind) for c in charsets]
    found = docs.withColumn(given, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    found = found.withColumn("base_spans", F.array_sort(base))
    found = found.withColumn("spans", F.array_sort(F.concat("base_spans", *dense)))
    return found.drop(given)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
