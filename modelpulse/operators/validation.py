"""Checks of scored batches: every violation as a row, from one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelpulse.functions.joins import lookup_join
from modelpulse.functions.scalars import is_numeric, missing, zero_one
from modelpulse.spec import DOMAINS, BatchSpec, Protected

MIN_GROUPS, MAX_GROUPS = 2, 20


@dataclass
class _Rule:
    rule_no: int
    column: str
    message: str
    # An aggregate that is true where the batch breaks the rule; None if it always does.
    broken: Column | None = None


def _schema_and_value_rules(df: DataFrame, spec: BatchSpec) -> list[_Rule]:
    """The rules in the order in which a batch is checked; order and wording are fixed values."""
    have = set(df.columns)
    # A name that occurs twice is reported as such; nothing else can be asked of it.
    single = {c for c in have if df.columns.count(c) == 1}
    rules: list[_Rule] = []

    def add(column: str, message: str, broken: Column | None = None):
        rules.append(_Rule(len(rules) + 1, column, message, broken))

    def only_null(c: str) -> Column:
        return F.count_if(~missing(df, c)) == 0

    if spec.domain not in DOMAINS:
        add("", f"Invalid domain '{spec.domain}'.")
    for c in sorted({c for c in df.columns if df.columns.count(c) > 1}):
        add(c, "Duplicate columns detected.")
    for c in spec.features:
        if c not in have:
            add(c, f"Feature column '{c}' missing in data.")
    for c in sorted(set(spec.numerical) & set(spec.categorical)):
        add(c, f"Column '{c}' cannot be both numerical and categorical.")
    for c in spec.numerical:
        if c not in have:
            add(c, f"Numerical feature '{c}' missing in data.")
        elif c in single and not is_numeric(df.schema[c].dataType):
            add(c, f"Numerical feature '{c}' must be numeric.")
    for c in spec.categorical:
        if c not in have:
            add(c, f"Categorical feature '{c}' missing in data.")
    for c in spec.quasi:
        if c not in have:
            add(c, f"Quasi identifier column '{c}' missing in data.")
        elif c in single:
            add(c, f"Quasi identifier column '{c}' contains only null values.", only_null(c))
    protected = spec.protected
    required = [*spec.features, spec.prediction, *(protected.columns if protected else ())]
    for c in dict.fromkeys(required):
        if c not in have:
            add(c, f"Missing required column: '{c}'")
    for c in dict.fromkeys(required):
        if c in single:
            add(c, f"Column '{c}' contains only null values.", only_null(c))
    p = spec.prediction
    if p in single:
        holes = F.count_if(missing(df, p)) > 0
        add(p, f"Prediction column '{p}' contains null values.", holes)
        if not is_numeric(df.schema[p].dataType):
            add(p, f"Prediction column '{p}' must be numeric.")
    if protected is not None:
        _protected_rules(df, protected, single, add)
    return rules


def _protected_rules(df: DataFrame, protected: Protected, single: set[str], add) -> None:
    columns = list(protected.columns)
    there = [c for c in columns if c in single]
    if protected.kind not in ("categorical", "one_hot"):
        add("", "Protected attribute type must be 'categorical' or 'one_hot'.")
    if not columns:
        add("", "Protected attribute 'columns' must be a non-empty list.")
    if protected.kind == "categorical" and columns:
        if len(columns) != 1:
            add("", "Categorical protected attribute must contain exactly one column.")
        if there:
            c = there[0]
            groups = F.count_distinct(F.when(~missing(df, c), F.col(c)))
            add(c, f"Protected attribute '{c}' must contain at least two groups.",
                groups < MIN_GROUPS)
            add(c, f"Protected attribute '{c}' has too many unique values.", groups > MAX_GROUPS)
    if protected.kind == "one_hot" and columns:
        if len(columns) < 2:
            add("", "One-hot protected attributes must contain at least two columns.")
        for c in there:
            strange = F.count_if(~missing(df, c) & ~zero_one(df, c).isin(0, 1)) > 0
            add(c, f"One-hot column '{c}' must contain only 0/1 values.", strange)
        if there == columns:
            filled = [F.when(missing(df, c), 0).otherwise(zero_one(df, c)) for c in columns]
            total = sum(filled[1:], filled[0])
            add("", "Invalid one-hot encoding: each row must belong to exactly one group.",
                F.count_if(total != 1) > 0)


def _text(value: str) -> str:
    """SQL literal of a text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def check_batches(
    df: DataFrame,
    spec: BatchSpec,
    expected: DataFrame | None = None,
    profiled: DataFrame | None = None,
) -> DataFrame:
    """Violations (keys, rule_no, column, message) of every batch.

    Rules on the schema cost no job; all value rules share one aggregation by batch.
    `expected` lists batches that should be there; those without rows are reported empty.
    `profiled` lists the models with a usable baseline; batches of others are reported last.
    """
    aggregates = [c.alias(n) for n, c in rule_facts(df, spec).items()]
    per_batch = df.groupBy(*spec.by).agg(F.count(F.lit(1)).alias("_n"), *aggregates)
    return violations_of(per_batch, df, spec, expected, profiled)


def rule_facts(df: DataFrame, spec: BatchSpec) -> dict[str, Column]:
    """Aggregates of a batch, one per rule on values: `_r<rule_no>`, true where it is broken."""
    rules = _schema_and_value_rules(df, spec)
    return {f"_r{r.rule_no}": r.broken for r in rules if r.broken is not None}


def violations_of(
    per_batch: DataFrame,
    df: DataFrame,
    spec: BatchSpec,
    expected: DataFrame | None = None,
    profiled: DataFrame | None = None,
) -> DataFrame:
    """Violations from the facts of each batch; of `df` only the schema is looked at."""
    rules = _schema_and_value_rules(df, spec)
    by = spec.by
    if profiled is not None:
        last = _Rule(len(rules) + 1, "", "Baseline distribution missing or not finite.", F.lit(True))
        rules.append(last)
        # One row per batch is left here; adaptive execution broadcasts the models if few.
        known = profiled.select(spec.model, F.lit(True).alias("_known"))
        flag = F.col("_known").isNull().alias(f"_r{last.rule_no}")
        per_batch = per_batch.join(known, spec.model, "left").select("*", flag)
    listed = ", ".join(
        f"if({'true' if r.broken is None else f'_r{r.rule_no}'}, named_struct("
        f"'rule_no', {r.rule_no}, 'column', {_text(r.column)}, 'message', {_text(r.message)}), null)"
        for r in rules
    )
    violations = per_batch.selectExpr(*by, f"inline(array_compact(array({listed})))")
    if expected is not None:
        empty = expected.select(*by).distinct().join(per_batch.select(*by), by, "left_anti")
        violations = violations.unionByName(
            empty.select(
                *by,
                F.lit(0).alias("rule_no"),
                F.lit("").alias("column"),
                F.lit("Input is empty.").alias("message"),
            )
        )
    return violations


def first_errors(violations: DataFrame, spec: BatchSpec) -> DataFrame:
    """The violation a batch is rejected for: the one with the lowest rule number."""
    first = F.min_by(F.struct("rule_no", "column", "message"), "rule_no").alias("_v")
    return violations.groupBy(*spec.by).agg(first).select(*spec.by, "_v.*")


def failures(
    violations: DataFrame, spec: BatchSpec, stage: str, at: str | Column | None = None
) -> DataFrame:
    """Rejected batches as failure records (keys, failure STRUCT)."""
    when = F.current_timestamp() if at is None else (F.col(at) if isinstance(at, str) else at)
    errors = first_errors(violations, spec)
    if isinstance(at, str) and at not in errors.columns:
        told = violations.groupBy(*spec.by).agg(F.min(at).alias(at))
        errors = errors.join(told, spec.by)
    return errors.select(
        *spec.by,
        F.struct(
            F.lit("inference_crash").alias("failure_type"),
            F.col("message"),
            F.lit(stage).alias("stage"),
            F.lit("critical").alias("severity"),
            when.alias("timestamp"),
        ).alias("failure"),
    )


def accepted(
    df: DataFrame,
    rejected: DataFrame,
    by: Sequence[str],
    spread_by: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """Rows of the batches that are not rejected.

    `rejected` is settled, `rows` its size if known. A short list is broadcast, so that the
    scored rows stay where they are.
    """
    return lookup_join(
        df, rejected.select(*by), by, "left_anti", spread_by=spread_by, rows=rows
    )
