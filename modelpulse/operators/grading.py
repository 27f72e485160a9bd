"""Grading of vitals: bands around the baseline, direction, persistence, overall status."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelpulse.functions.joins import lookup_join
from modelpulse.functions.ordering import number_rows, overlapped, own_rows, running_totals
from modelpulse.functions.storage import settle_counted, settle_rows
from modelpulse.operators.batching import keep_latest
from modelpulse.spec import DIRECTIONS, DOMAINS

HISTORY = 5


def _lookup(key: Column, values: Mapping[str, object]) -> Column:
    """CASE over a short fixed table; NULL for other keys."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def domain_k(domain: Column) -> Column:
    return _lookup(domain, {d: c["k"] for d, c in DOMAINS.items()})


def domain_persistence(domain: Column) -> Column:
    return _lookup(domain, {d: c["persistence"] for d, c in DOMAINS.items()})


def direction_of(metric: Column, directions: Mapping[str, str] = DIRECTIONS) -> Column:
    """Side on which a metric alarms; metrics not in the table alarm above."""
    return F.coalesce(_lookup(metric, directions), F.lit("upper"))


def join_baseline(
    metrics: DataFrame, summary: DataFrame, domain: str | Column, model: str = "model_id"
) -> DataFrame:
    """Attach mean, std, domain and k; metrics without a baseline keep NULL there.

    The summary has a few rows per model; hand it in settled, since its size is checked
    before it is broadcast.
    """
    table = summary.select(model, "metric", "mean", "std")
    joined = lookup_join(metrics, table, [model, "metric"], "left", spread_by=metrics.columns)
    domain = F.lit(domain) if isinstance(domain, str) else domain
    with_domain = joined.withColumn("domain", domain)
    return with_domain.withColumn("k", domain_k(F.col("domain")))


# Status from value, mean, std, k and direction alone. NULL where the direction or the domain
# is unknown. A NaN never exceeds a limit.
RAW_STATUS = """
    case when mean is null or std is null then 'no_baseline'
         when k is null then null
         when std = 0 then 'normal'
         when direction not in ('upper', 'lower', 'two-sided') then null
         when isnan(value) or isnan(mean) or isnan(std) then 'normal'
         when direction <> 'lower' and value > mean + k * std then 'critical'
         when direction <> 'upper' and value < mean - k * std then 'critical'
         when direction <> 'lower' and value > mean + (k - 1) * std then 'warning'
         when direction <> 'upper' and value < mean - (k - 1) * std then 'warning'
         else 'normal' end"""


def grade_raw(
    metrics: DataFrame,
    summary: DataFrame,
    domain: str | Column = "standard",
    directions: Mapping[str, str] = DIRECTIONS,
    model: str = "model_id",
) -> DataFrame:
    """Grade every value by itself, without a history."""
    joined = join_baseline(metrics, summary, domain, model)
    side = direction_of(F.col("metric"), directions)
    return joined.withColumn("direction", side).withColumn("raw", F.expr(RAW_STATUS))


def grading_errors(graded: DataFrame) -> DataFrame:
    """Values that could not be graded: unknown domain or direction."""
    reason = F.when(
        F.col("k").isNull(), F.concat(F.lit("Unsupported domain: "), F.col("domain"))
    ).otherwise(F.concat(F.lit("Invalid direction: "), F.col("direction")))
    return graded.where(F.col("raw").isNull()).withColumn("message", reason)


def persist_filter(
    graded: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    epoch: str | None = None,
    seq: str | None = None,
) -> DataFrame:
    """Final status from the raw ones of the batches before.

    With persistence N > 0 an alarm is `critical` if the value lies beyond three times the
    critical distance above the mean, or if all N statuses before it alarmed too; else it is
    `warning`. A filtered status alarms exactly when its raw one does, so the history is a
    frame of N rows over the raw statuses and needs no recursion.

    `epoch` names a column that changes where the history was cleared. `seq` names a column
    that already holds the position in the (keys) series; without it rows are numbered here.
    """
    depth = max(c["persistence"] for c in DOMAINS.values())
    columns = graded.columns
    if seq is None:
        seq = "_seq"
        graded = number_rows(graded, keys, order, seq)
    blocks = overlapped(graded, seq, depth).withColumn("_need", domain_persistence(F.col("domain")))
    series = ", ".join([*keys, *([epoch] if epoch else []), "_block"])
    alarm = "raw in ('warning', 'critical')"
    levels = sorted({c["persistence"] for c in DOMAINS.values()} - {0})
    before = " ".join(
        f"when _need = {n} then count_if({alarm}) over (partition by {series} order by {seq}"
        f" rows between {n} preceding and 1 preceding)"
        for n in levels
    )
    counted = own_rows(blocks.selectExpr("*", f"case {before} end as _before"))
    status = f"""
        case when raw is null then null
             when not ({alarm}) or _need = 0 then raw
             when not isnan(value) and value > mean + k * 3 * std then 'critical'
             when coalesce(_before, 0) < _need then 'warning'
             else 'critical' end as status"""
    return counted.selectExpr(*columns, status)


def regrade_late(
    stored: DataFrame, late: DataFrame, keys: Sequence[str], order: Sequence[str], salts: int = 64
) -> DataFrame:
    """What changes when rows come late: they, and the rows after each that look back on it.

    `stored` has final statuses and `late` raw ones (the columns of `grade_raw`). A late row with the keys
    and order of a stored one replaces it. Returned are the late rows and, of their series, the
    N rows after each, N being the longest persistence, with `status` anew and `late` true for
    the late ones; all other statuses stay as they are. Read are the stored rows
    from the first late one of a series on and the newest N before, never a whole history.
    """
    keys, order = list(keys), list(order)
    depth = max(c["persistence"] for c in DOMAINS.values())
    columns = [c for c in stored.columns if c != "status"]
    fresh = settle_rows(late.select(*columns))
    at = F.struct(*order)
    first, series = settle_counted(fresh.groupBy(*keys).agg(F.min(at).alias("_from")))
    rest = stored.select(*columns).join(fresh.select(*keys, *order), [*keys, *order], "left_anti")
    touched = lookup_join(rest, first, keys, spread_by=order, rows=series).withColumn("_after", at >= F.col("_from"))
    before = keep_latest(touched.where("not _after"), keys, order, depth, [*keys, *order], salts)
    seen = before.unionByName(touched.where("_after")).select(*columns, F.lit(False).alias("late"))
    numbered = settle_rows(number_rows(seen.unionByName(fresh.withColumn("late", F.lit(True))), keys, order, "_seq"))
    judged = overlapped(persist_filter(numbered, keys, order, seq="_seq"), "_seq", depth)
    back = Window.partitionBy(*keys, "_block").orderBy("_seq").rowsBetween(-depth, 0)
    marked = own_rows(judged.withColumn("_near", F.max("late").over(back)))
    return marked.where("_near").select(*columns, "status", "late")


def with_regraded(stored: DataFrame, regraded: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The stored rows with what `regrade_late` returned in place of its rows."""
    old = stored.join(regraded.select(*keys, *order), [*keys, *order], "left_anti")
    return old.unionByName(regraded.select(*stored.columns))


def grade(
    metrics: DataFrame,
    summary: DataFrame,
    domain: str | Column = "standard",
    by: Sequence[str] = ("model_id", "batch"),
    directions: Mapping[str, str] = DIRECTIONS,
    with_history: bool = True,
    epoch: str | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Graded vitals (keys, metric, value, mean, std, domain, k, raw, status).

    The history of a metric runs in `order`, columns of `metrics` that end with the batch key; by
    default it is that key alone, which sorts numbered names as text.
    """
    model, order = by[0], list(by[1:] if order is None else order)
    graded = grade_raw(metrics, summary, domain, directions, model)
    if not with_history:
        return graded.withColumn("status", F.col("raw"))
    return persist_filter(graded, [model, "metric"], order, epoch)


def severity(status: Column) -> Column:
    return F.when(status == "critical", 2).when(status == "warning", 1).otherwise(0)


def overall_status(evaluated: DataFrame, by: Sequence[str], name: str = "status") -> DataFrame:
    """Worst status of a batch; values without a baseline do not count."""
    worst = F.max(severity(F.col("status")))
    return evaluated.groupBy(*by).agg(
        F.when(worst == 2, "critical").when(worst == 1, "warning").otherwise("normal").alias(name)
    )


def status_history(
    evaluated: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int = HISTORY
) -> DataFrame:
    """The last `limit` stored statuses of a metric up to each batch, oldest first."""
    stored = evaluated.where(F.col("status") != "no_baseline")
    blocks = overlapped(number_rows(stored, keys, order, "_seq"), "_seq", limit - 1)
    frame = Window.partitionBy(*keys, "_block").orderBy("_seq").rowsBetween(1 - limit, 0)
    listed = own_rows(blocks.withColumn("history", F.collect_list("status").over(frame)))
    return listed.select(*evaluated.columns, "history")


def reset_epochs(
    rows: DataFrame, resets: DataFrame, keys: Sequence[str], at: str, name: str = "epoch"
) -> DataFrame:
    """Number of resets of the same key before or at each row; `resets` has keys and `at`.

    Both tables are merged in time order and the resets are counted by running totals.
    """
    marked = rows.withColumn("_row", F.struct(*rows.columns)).select(
        *keys, at, F.lit(1).alias("_kind"), "_row"
    )
    points = resets.select(*keys, at, F.lit(0).alias("_kind")).withColumn(
        "_row", F.lit(None).cast(marked.schema["_row"].dataType)
    )
    # The hash tells rows of one moment apart; their order does not change the count.
    both = marked.unionByName(points).withColumn("_tie", F.xxhash64("_row"))
    is_reset = F.when(F.col("_kind") == 0, 1).otherwise(0).cast("bigint")
    counted = running_totals(both, keys, [at, "_kind", "_tie"], {name: is_reset})
    return counted.where(F.col("_kind") == 1).select("_row.*", name)
