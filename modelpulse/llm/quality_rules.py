"""Quality rules: a table of thresholds compiled into one projection.

Each rule bounds a ratio of counts of the text from below or above. The counts are columns of the
same projection; a window of words that repeats is found by sorting the text's own windows. Main
path: DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelpulse.llm.common import besides, fresh, let, words_of

#: Frequent words of the languages at hand.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this at from or an"
    " der die und den das von mit des sich ist dem nicht ein eine auf für im zu"
    " le la les et des du un une que qui dans pour par sur pas au avec est en"
    " el los las y del que una un por con para es se no lo como su al de"
).split()
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """`count` divided by `of` must not lie below `low` or above `high`."""

    name: str
    count: str
    of: str
    low: float | None = None
    high: float | None = None


#: Texts with less than 50 words or with over half their words in repeated windows are out
#: beforehand (base_failed). A rule whose divisor is 0 passes.
RULES = (
    Rule("length", "n_words", "one", 50, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 2, 15),
    Rule("symbols", "n_symbols", "n_words", None, 0.3),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
    Rule("loud_words", "n_loud_words", "n_words", None, 0.5),
)


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of `width` words found twice or more in the array."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (width - 1)),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(width)]).alias("h"), i.alias("i")),
    )

    def places(ordered: Column) -> Column:
        """Places of windows equal to a neighbour in the sorted array."""
        before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), ordered)
        return F.filter(
            F.zip_with(
                F.zip_with(ordered, F.slice(before, F.lit(1), F.size(ordered)), lambda x, y: F.struct(
                    x["i"].alias("i"), x["h"].alias("h"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("same"))),
                F.slice(ordered, F.lit(2), F.size(ordered)),
                lambda x, y: F.when(x["same"] | F.coalesce(x["h"] == y["h"], F.lit(False)), x["i"]),
            ),
            lambda i: i.isNotNull(),
        )

    covered = let(
        F.sort_array(let(F.sort_array(windows), places)),
        lambda at: F.aggregate(
            F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width))),
            F.lit(0),
            lambda acc, x: acc + x,
        ),
    )
    return F.when(F.size(words) >= width + 1, covered).otherwise(0)


def counts(text: Column) -> Column:
    """Struct of all counts of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    bare = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))
    long = lambda c: c.cast("bigint")
    return let(
        words_of(text),
        lambda words: let(
            lines,
            lambda kept: F.struct(
                F.lit(1).cast("bigint").alias("one"),
                long(F.size(words)).alias("n_words"),
                long(F.length(F.translate(text, BLANKS, ""))).alias("word_chars"),
                long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
                long(F.size(kept) - F.size(F.array_distinct(kept))).alias("n_dup_lines"),
                long(repeated_window_words(words)).alias("n_repeat_words"),
                long(F.size(F.filter(words, lambda w: F.array_contains(stop, bare(w))))).alias("n_stop_words"),
                long(F.size(F.filter(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1)))).alias("n_loud_words"),
                long(F.size(kept)).alias("n_lines"),
                long(F.size(F.filter(kept, lambda x: x.rlike(r"^[\x20\x09]*[-*•]")))).alias("n_bullet_lines"),
                long(F.size(F.filter(kept, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")))).alias("n_ellipsis_lines"),
            ),
        ),
    )


def passes(rule: Rule, value) -> Column:
    """Whether a rule holds, in whole numbers times the threshold."""
    count, of = value(rule.count), value(rule.of)
    held = F.lit(True)
    if rule.low is not None:
        held = held & (count >= F.lit(rule.low) * of)
    if rule.high is not None:
        held = held & (count <= F.lit(rule.high) * of)
    return (of == 0) | held


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the counts, base_failed, the rules a text breaks, and kept.

    A null, empty or blank text has no words and fails the base; long texts are judged whole. Rows
    are judged one by one, so repeated ones alike, and an empty table stays empty. Rows and other
    columns stay; added columns replace those of their names, whatever the case. Stop words are a
    fixed list of four languages: prose in others fails that rule unless `rules` leaves it out.
    """
    held = fresh(docs.columns, "rule_counts")
    measured = docs.withColumn(held, counts(F.col(text)))
    value = lambda name: F.col(f"{held}.{name}")
    base = (value("n_words") < 50) | (100 * value("n_repeat_words") > 50 * value("n_words"))
    broken = F.filter(F.array(*[F.when(~passes(r, value), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_loud_words", "n_lines")
    added = {n: value(n) for n in shown} | {"base_failed": base, "broken_rules": broken}
    added["kept"] = ~base & (F.size(broken) == 0)
    own = [F.col(f"`{c}`") for c in besides(docs.columns, added)]
    return measured.select(*own, *[c.alias(n) for n, c in added.items()])
