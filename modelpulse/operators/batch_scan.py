"""All vitals of all batches from few scans of the scored rows.

One scan takes the facts of a batch that need nothing else: what the validation rules ask for, the
first moment, totals of the attributions, one-hot parity. A second one, with those totals and a
baseline profile of one row per model beside each row, counts drift bins of all features and sums
the entropy of the attributions, without a row per feature. Two more count the values of the
predictions for Gini, and groups of quasi-identifier and protected value for privacy and parity.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelpulse.functions.joins import lookup_join
from modelpulse.functions.scalars import missing
from modelpulse.functions.storage import settle_counted
from modelpulse.operators.drift import _bin_shares, _edge, _psi
from modelpulse.operators.explain import SCORE
from modelpulse.operators.fairness import gini, one_hot_facts, one_hot_spread
from modelpulse.operators.validation import rule_facts
from modelpulse.spec import EPSILON, LOG_EPSILON, OOD_Z, PARITY, PSI_BINS, BatchSpec

#: Features whose bins one aggregation counts; a model with more of them is scanned once for each
#: such part, which reads only the columns of that part.
FEATURES_AT_ONCE = 12
DRIFT = ("psi", "linf", "ood_score")


# --- facts ------------------------------------------------------------------------------------


def _cells(df: DataFrame, shap: str) -> Column:
    """Absolute attributions of a row, as an array."""
    cells = F.col(shap) if df.schema[shap].dataType.typeName() == "array" else F.array(shap)
    absolute = F.transform(cells.cast("array<double>"), F.abs)
    # A row without an array is a row with one missing cell.
    return F.when(F.size(cells) > 0, absolute).otherwise(F.array(F.lit(None).cast("double")))


def _given(cells: Column) -> Column:
    return F.filter(cells, lambda v: v.isNotNull() & ~F.isnan(v))


def attribution_facts(df: DataFrame, shap: str) -> dict[str, Column]:
    """Aggregates of a batch that its attribution score needs before the entropy."""
    is_array = df.schema[shap].dataType.typeName() == "array"
    if not is_array:
        v = F.abs(F.col(shap).cast("double"))
        real = v.isNotNull() & ~F.isnan(v)
        value = F.when(real, v)
        return {
            "_rows": F.count(F.lit(1)), "_cells": F.count(F.lit(1)), "_given": F.count_if(real),
            "_total": F.coalesce(F.sum(value), F.lit(0.0)), "_peak": F.coalesce(F.max(value), F.lit(0.0)),
        }
    cells = _cells(df, shap)
    real = _given(cells)
    total = F.aggregate(real, F.lit(0.0), lambda a, v: a + v)
    return {
        "_rows": F.count(F.lit(1)), "_cells": F.sum(F.size(cells)).cast("bigint"), "_given": F.sum(F.size(real)).cast("bigint"),
        "_total": F.coalesce(F.sum(total), F.lit(0.0)), "_peak": F.coalesce(F.max(F.array_max(real)), F.lit(0.0)),
    }


def batch_facts(live: DataFrame, spec: BatchSpec) -> DataFrame:
    """One row per batch: keys, `_n`, `_ts` (its first moment), `_r<no>` for each validation rule
    that looks at values, attribution totals and one-hot parity. One scan, partial aggregation."""
    facts = {"_n": F.count(F.lit(1)), **rule_facts(live, spec)}
    if spec.ts in live.columns:
        facts["_ts"] = F.min(spec.ts)
    if spec.shap and spec.shap in live.columns:
        facts |= attribution_facts(live, spec.shap)
    if spec.protected is not None and spec.protected.kind == "one_hot" and set(spec.protected.columns) <= set(live.columns):
        facts |= one_hot_facts(live, spec.prediction, spec.protected.columns)
    return live.groupBy(*spec.by).agg(*[c.alias(n) for n, c in facts.items()])


# --- drift of all features beside the entropy ---------------------------------------------------


def wide_profile(profile: DataFrame, features: Sequence[str], model: str) -> DataFrame:
    """One row per model with a struct `_f<i>` per feature, null where the profile lacks it."""
    body = "named_struct('mean', mean, 'std', std, 'edge_lo', edge_lo, 'edge_hi', edge_hi, 'p', p)"
    return profile.groupBy(model).agg(
        *[F.expr(f"max_by({body}, feature) filter (where feature = '{f}') as _f{i}") for i, f in enumerate(features)]
    )


def _bins(i: int, bins: int) -> tuple[str, str]:
    """First guess of the bin of feature i, and the guess mended by its edges (see drift.with_bin)."""
    x, of = f"_x{i}", f"_f{i}."
    edge = lambda k: _edge(k, bins).replace("edge_", f"{of}edge_")
    width = f"(({of}edge_hi - {of}edge_lo) / {float(bins)}D)"
    inside = f"{x} >= {of}edge_lo and {x} <= {of}edge_hi and not isnan({x})"
    guess = f"if({inside}, cast(greatest(0, least(floor(({x} - {of}edge_lo) / {width}), {bins - 1})) as int), null)"
    g = f"_g{i}"
    fixed = (
        f"case when {x} < {edge(g)} then {g} - 1 when {g} < {bins - 1} and {x} >= {edge(f'{g} + 1')} then {g} + 1 else {g} end"
    )
    return f"{guess} as {g}", f"{fixed} as _bin{i}"


def drift_and_entropy(
    live: DataFrame, profile: DataFrame, facts: DataFrame, spec: BatchSpec, models: int, batches: int, bins: int = PSI_BINS
) -> DataFrame:
    """Keys, psi, linf, ood_score (null for models without a profile) and shap_importance.

    `profile` is wide and of `models` rows, `facts` of `batches` rows.
    """
    by, features = spec.by, list(spec.numerical)
    parts = [range(k, min(k + FEATURES_AT_ONCE, len(features))) for k in range(0, len(features), FEATURES_AT_ONCE)]
    out = facts
    for no, part in enumerate(parts):
        entropy = bool(spec.shap) and no == 0
        names = [c for c in dict.fromkeys([*spec.row_id, *by]) if c in live.columns]
        rows = live.selectExpr(
            *[f"`{c}`" for c in names],
            *[f"cast(`{features[i]}` as double) as _x{i}" for i in part],
            *([f"`{spec.shap}` as _shap"] if entropy else []),
        )
        rows = lookup_join(rows, profile, [spec.model], "left", spread_by=spec.row_id, rows=models)
        if entropy:
            sums = facts.where("_total > 0").select(*by, "_total")
            rows = lookup_join(rows, sums, by, "left", spread_by=spec.row_id, rows=batches)
        guesses, fixed = zip(*[_bins(i, bins) for i in part])
        binned = rows.selectExpr("*", *guesses).selectExpr("*", *fixed)
        counts: list[Column] = []
        for i in part:
            real = f"_x{i} is not null and not isnan(_x{i})"
            far = f"abs(_x{i} - _f{i}.mean) / (_f{i}.std + {EPSILON}D) > {OOD_Z}D"
            counts += [
                F.expr(f"max(abs(_x{i} - _f{i}.mean)) as _off{i}"), F.expr(f"count_if({real}) as _real{i}"),
                F.expr(f"count_if({real} and {far}) as _far{i}"),
                *[F.expr(f"count_if(_bin{i} = {b}) as _b{i}_{b}") for b in range(bins)],
            ]
        if entropy:
            counts.append(_entropy(rows).alias("_entropy"))
        # The totals of a batch are joined to what is left of it: one row.
        out = out.join(binned.groupBy(*by).agg(*counts), by, "left")
    scored = lookup_join(out, profile, [spec.model], "left", spread_by=by, rows=models)
    psi, linf, ood = [], [], []
    for i in range(len(features)):
        shares = _bin_shares(bins).replace("_b", f"_b{i}_").replace("/ n", "/ _n")
        scored = scored.selectExpr("*", f"{shares} as _q{i}")
        psi.append(f"({_psi(bins).replace('p[', f'_f{i}.p[').replace('q[', f'_q{i}[')})")
        linf.append(f"if(_real{i} < _n, double('nan'), _off{i} / (_f{i}.std + {EPSILON}D))")
        ood.append(f"_far{i} / _n")
    mean = lambda cells: f"({' + '.join(cells)}) / {len(cells)}"
    known = " and ".join(f"_f{i} is not null" for i in range(len(features)))
    score = SCORE if spec.shap else "0D"
    averaged = scored.selectExpr(
        *by, *[c for c in facts.columns if c not in by], f"{known} as _known", f"{mean(psi)} as _psi", f"{mean(linf)} as linf",
        f"{mean(ood)} as ood_score", f"{score} as shap_importance",
    )
    return averaged.selectExpr(
        *[c for c in averaged.columns if c not in ("_psi", "linf", "ood_score", "_known")],
        "if(_known, if(isnan(_psi), _psi, least(_psi, 1D)), null) as psi",
        "if(_known, linf, null) as linf", "if(_known, ood_score, null) as ood_score",
    )


def _entropy(rows: DataFrame) -> Column:
    """Sum of p ln p over the attributions of a batch, p being their share in its total."""
    term = lambda v: v / F.col("_total") * F.ln(v / F.col("_total") + LOG_EPSILON)
    if rows.schema["_shap"].dataType.typeName() == "array":
        terms = F.transform(F.filter(_given(_cells(rows, "_shap")), lambda v: v > 0), term)
        return F.sum(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))
    v = F.abs(F.col("_shap").cast("double"))
    return F.sum(F.when(~F.isnan(v) & (v > 0), term(v)))


# --- groups -----------------------------------------------------------------------------------


def privacy_and_parity(live: DataFrame, spec: BatchSpec) -> DataFrame:
    """Keys, privacy_score and, for a categorical protected column, statistical_parity.

    Rows are counted by quasi-identifiers and protected value at once. Those groups are then
    counted twice, by the quasi-identifiers and by the protected value, in one grouping.
    """
    by = spec.by
    protected = spec.protected if spec.protected is not None and spec.protected.kind == "categorical" else None
    whole = reduce(lambda a, b: a & b, [~missing(live, c) for c in spec.quasi])
    quasi = [F.col(c).alias(f"_q{i}") for i, c in enumerate(spec.quasi)]
    if protected is None:
        group = F.lit(None).cast("string")
    else:
        c = protected.columns[0]
        group = F.when(~missing(live, c), F.col(c))
    names = [*[f"_q{i}" for i in range(len(quasi))], "_whole"]
    fine = (
        live.select(*by, *quasi, whole.alias("_whole"), group.alias("_group"), F.col(spec.prediction).cast("double").alias("_x"))
        .groupBy(*by, *names, "_group")
        .agg(F.count(F.lit(1)).alias("_c"), F.sum("_x").alias("_s"), F.count("_x").alias("_with"))
    )
    sides = [[*by, *names], *([[*by, "_group"]] if protected else [])]
    both = fine.groupingSets(
        [[F.col(f"`{c}`") for c in side] for side in sides], *[F.col(f"`{c}`") for c in [*by, *names, "_group"]]
    ).agg(
        F.sum("_c").alias("_c"), F.sum("_s").alias("_s"), F.sum("_with").alias("_with"), F.grouping("_whole").alias("_by_group")
    )
    here = F.col("_by_group") == 0
    unique = F.count_if(here & F.col("_whole") & (F.col("_c") == 1))
    measured = [(1 - unique / F.sum(F.when(here, F.col("_c")))).alias("privacy_score")]
    if protected:
        named = ~here & F.col("_group").isNotNull()
        rate = F.when(named & (F.col("_with") > 0), F.col("_s") / F.col("_with"))
        spread = F.max(rate) - F.min(rate)
        measured.append(F.when(F.count_if(named) < 2, F.lit(0.0)).otherwise(spread).alias(PARITY))
    return both.groupBy(*by).agg(*measured)


# --- all of them ------------------------------------------------------------------------------


def vitals_of(live: DataFrame, profile: DataFrame, facts: DataFrame, spec: BatchSpec, batches: int) -> DataFrame:
    """Long table (keys, metric, value) of the vitals of the batches in `facts` (settled, `batches`
    rows), from three scans of the live rows. Models without a profile have no drift vitals but
    all others; without attributions their score is 0 for every batch."""
    by = spec.by
    pivoted, models = settle_counted(wide_profile(profile, list(spec.numerical), spec.model))
    wide = drift_and_entropy(live, pivoted, facts, spec, models, batches)
    names = [*DRIFT, "shap_importance"]
    if spec.protected is not None and spec.protected.kind == "one_hot":
        wide = wide.withColumn(PARITY, one_hot_spread(len(spec.protected.columns)))
        names.append(PARITY)
    groups = privacy_and_parity(live, spec)
    known = F.col("value").isNotNull() | ~F.col("metric").isin(*DRIFT)
    parts = [
        _long(wide, by, names).where(known),
        _long(gini(live, spec.prediction, by), by, ["gini"]),
        _long(groups, by, [c for c in groups.columns if c not in by]),
    ]
    return reduce(DataFrame.unionByName, parts)


def _long(df: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    cells = ", ".join(f"'{n}', {n}" for n in names)
    return df.selectExpr(*[f"`{c}`" for c in by], f"stack({len(names)}, {cells}) as (metric, value)")
