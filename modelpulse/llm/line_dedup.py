"""Repeated runs of lines across documents, found by winnowing and deleted but for the first.

A window is a stretch of lines of as few lines as make `least` words, from each line forwards and
from each line backwards; blank lines stand apart and don't count. Of every window the smallest
line hash is selected. Two equal runs of at least `least` words hold an equal window, and equal
windows select the same hash, so the selected hashes - about one for every two windows - are
guaranteed to meet: only where a selected hash stands in two places is anything compared.
From such a place the match is extended both ways over all windows around it. Every window that
an earlier place has too is deleted; the windows of a run overlap, so together they are the run.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelpulse.functions.storage import Passing, settle_rows
from modelpulse.llm.common import WORD, besides, fresh, let

#: Words of a run that counts as a passage.
LEAST = 50


def _windows(lines, step: str, least: int):
    """Per line the window that starts (or, on a reversed array, ends) there: lines it takes.

    A line that counts has a word, so a window has at most `least` lines.
    """
    def length(i):
        near = F.slice(lines, i, F.lit(least))
        return F.aggregate(
            near,
            F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")),
            lambda acc, x: F.when(acc["words"] >= least, acc).otherwise(
                F.struct((acc["words"] + x["words"]).alias("words"), (acc["n"] + 1).alias("n"))
            ),
        )

    return F.filter(
        F.transform(
            # Counts down to 0 without lines, where no window can begin.
            F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines))).otherwise(F.array().cast("array<int>")),
            lambda i: let(
                length(i),
                lambda w: F.when(
                    w["words"] >= least,
                    let(
                        F.transform(F.slice(lines, i, w["n"]), lambda x: x["hash"]),
                        lambda h: F.struct(
                            (i if step == "forward" else F.size(lines) - i - w["n"] + 2).alias("start"),
                            w["n"].alias("n"),
                            F.xxhash64(h if step == "forward" else F.reverse(h)).alias("content"),
                            F.array_min(h).alias("mark"),
                            (
                                i + F.array_position(h, F.array_min(h)) - 1
                                if step == "forward"
                                else F.size(lines) - i - F.array_position(h, F.array_min(h)) + 2
                            ).cast("int").alias("mark_at"),
                        ),
                    ),
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )


def repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST
) -> DataFrame:
    """(id, text hash, places) of the documents with lines to delete; places count from 1.

    Order of places: id, text hash, line. A run that repeats inside one document counts too.
    """
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where("t is not null and id is not null")
    split = source.select(
        "id",
        F.xxhash64("t").alias("version"),
        F.filter(
            F.transform(
                F.split("t", "\n", -1),
                lambda line, i: F.struct(
                    F.regexp_count(line, F.lit(WORD)).alias("words"), F.xxhash64(line).alias("hash"), (i + 1).alias("place")
                ),
            ),
            lambda x: x["words"] > 0,
        ).alias("lines"),
    )
    # A text too short for a window needs no array work.
    long_enough = F.aggregate("lines", F.lit(0), lambda acc, x: acc + x["words"]) >= least
    lines = split.where(long_enough)
    both = lines.select(
        "id",
        "version",
        F.transform("lines", lambda x: x["place"]).alias("places"),
        F.array_distinct(
            F.concat(let(F.col("lines"), lambda r: _windows(r, "forward", least)), let(F.reverse("lines"), lambda r: _windows(r, "backward", least)))
        ).alias("windows"),
    )
    # The outer form, as the other adds a filter on the windows that would be worked out once more
    # below, from the whole text at each line.
    on_way = Passing(docs.sparkSession)
    cells = on_way.settle_rows(
        both.select("id", "version", "places", F.explode_outer("windows").alias("w")).where("w is not null").select(
            "id", "version", "w.*", F.slice("places", F.col("w.start"), F.col("w.n")).alias("covers")
        )
    )
    at = F.struct("id", "version", "start")
    # Marks that stand in two places or more; partly summed before the shuffle.
    place = F.struct("id", "version", "mark_at")
    marks = cells.groupBy("mark").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("mark")
    near = cells.join(marks, "mark", "left_semi")
    heads = near.groupBy("content", "n").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    later = near.join(heads.drop("times"), ["content", "n"]).where(at > F.col("first"))
    found = settle_rows(
        later.groupBy("id", "version").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("covers")))).alias("places")
        )
    )
    on_way.remove()
    return found


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST
) -> DataFrame:
    """The documents with their text without later repeated runs, n_lines and n_removed added.

    Null texts stay null with 0 lines, empty ones have one line. Rows equal in id and text are
    one document and get the same result each; rows of null id stay as they are. Other columns
    stay; columns named n_lines or n_removed are replaced.
    """
    found = repeated_lines(docs, doc_id, text, least)
    key = fresh(docs.columns, "line_version")
    places = fresh(docs.columns, "line_places")
    gone_id, gone_version = fresh(docs.columns, "gone_id"), fresh(docs.columns, "gone_version")
    gone = found.select(F.col("id").alias(gone_id), F.col("version").alias(gone_version), F.col("places").alias(places))
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    # Merged at every size: lists of places have no bound that a broadcast could rely on.
    joined = rows.join(gone.hint("merge"), (F.col(doc_id) == F.col(gone_id)) & (F.col(key) == F.col(gone_version)), "left")
    lines = F.split(F.col(text), "\n", -1)
    # Runs of places to keep: what lies between the deleted ones.
    kept = let(
        F.concat(F.array(F.lit(0)), F.col(places), F.array(F.size(lines) + 1)),
        lambda edges: let(
            lines,
            lambda all_lines: F.flatten(
                F.zip_with(
                    F.slice(edges, F.lit(1), F.size(edges) - 1),
                    F.slice(edges, F.lit(2), F.size(edges) - 1),
                    lambda a, b: F.slice(all_lines, a + 1, b - a - 1),
                )
            ),
        ),
    )
    own = besides(docs.columns, ("n_lines", "n_removed"))
    others = [c for c in own if c != text]
    out = joined.select(
        *[F.col(f"`{c}`") for c in others],
        F.when(F.col(places).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(places), F.lit(0)).cast("bigint").alias("n_removed"),
    )
    return out.select(*[F.col(f"`{c}`") for c in own], "n_lines", "n_removed")
