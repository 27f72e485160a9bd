"""Drift and robustness vitals against a baseline profile: PSI, L-infinity, out of distribution.

All of them come from one aggregation of the live rows by (batch, feature); the baseline is
a profile of a few numbers per feature, never the raw values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelpulse.functions.joins import BROADCAST_ROWS, lookup_join
from modelpulse.functions.storage import settle, settle_counted
from modelpulse.spec import EPSILON, OOD_Z, PSI_BINS, BatchSpec

def long_features(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, feature) with the value as double."""
    pairs = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
    return df.selectExpr(*keep, f"stack({len(features)}, {pairs}) as (feature, x)")


def _edge(i: str, bins: int) -> str:
    """Edge i of `bins` equal-width bins; the last edge is the upper end itself."""
    step = f"((edge_hi - edge_lo) / {float(bins)}D)"
    return f"if(({i}) >= {bins}, edge_hi, ({i}) * {step} + edge_lo)"


def with_bin(df: DataFrame, bins: int) -> DataFrame:
    """Add _bin, the bin of x among equal-width bins [e_i, e_i+1), the last one closed; NULL
    outside.

    The quotient gives a first guess, which rounding can put one bin off; comparing x with
    the two edges of that bin settles it.
    """
    width = f"((edge_hi - edge_lo) / {float(bins)}D)"
    inside = "x >= edge_lo and x <= edge_hi and not isnan(x)"
    guess = f"cast(greatest(0, least(floor((x - edge_lo) / {width}), {bins - 1})) as int)"
    fixed = (
        f"case when x < {_edge('_guess', bins)} then _guess - 1"
        f" when _guess < {bins - 1} and x >= {_edge('_guess + 1', bins)} then _guess + 1"
        f" else _guess end"
    )
    guessed = df.selectExpr("*", f"if({inside}, {guess}, null) as _guess")
    return guessed.selectExpr("*", f"{fixed} as _bin")


FINITE = "x is not null and not isnan(x) and abs(x) <> double('infinity')"


def _bin_counts(bins: int) -> list[Column]:
    return [F.expr(f"count_if(_bin = {i}) as _b{i}") for i in range(bins)]


def _bin_shares(bins: int) -> str:
    return "array(" + ", ".join(f"_b{i} / n" for i in range(bins)) + ")"


def baseline_profile(
    df: DataFrame,
    features: Sequence[str],
    model: str = "model_id",
    bins: int = PSI_BINS,
    row_id: Sequence[str] = (),
) -> DataFrame:
    """Per (model, feature): n, mean, population std, range and shares of the equal-width bins.

    `usable` is false where the baseline holds a missing or infinite value, which leaves no
    range to cut into bins. Settled, since every later batch is compared with it.
    """
    long = long_features(df, features, [model, *[c for c in row_id if c != model]])
    stats = long.groupBy(model, "feature").agg(
        F.expr("count(*) as n"),
        F.expr("avg(x) as mean"),
        F.expr("stddev_pop(x) as std"),
        F.expr("min(x) as lo"),
        F.expr("max(x) as hi"),
        F.expr(f"bool_and({FINITE}) as usable"),
    )
    stats, rows = settle_counted(
        stats.selectExpr(
            model,
            "feature",
            "n",
            "if(lo = hi, lo, mean) as mean",
            "if(lo = hi, 0D, std) as std",
            "lo",
            "hi",
            "if(lo = hi, lo - 0.5D, lo) as edge_lo",
            "if(lo = hi, hi + 0.5D, hi) as edge_hi",
            "usable",
        )
    )
    ranged = lookup_join(
        long, stats.select(model, "feature", "edge_lo", "edge_hi"), [model, "feature"],
        spread_by=row_id, rows=rows,
    )
    counted = with_bin(ranged, bins).groupBy(model, "feature").agg(*_bin_counts(bins))
    joined = lookup_join(counted, stats, [model, "feature"], rows=rows)
    return settle(joined.selectExpr(*stats.columns, f"{_bin_shares(bins)} as p"))


def unusable_profiles(profile: DataFrame, model: str = "model_id") -> DataFrame:
    """(model, feature) pairs without a usable baseline."""
    return profile.where(~F.col("usable")).select(model, "feature")


def _psi(bins: int) -> str:
    """Sum over bins of (q - p) ln(q / p), with empty bins raised to a small share."""

    def share(side: str, i: int) -> str:
        return f"if({side}[{i}] = 0, {EPSILON}D, {side}[{i}])"

    pairs = [(share("p", i), share("q", i)) for i in range(bins)]
    return " + ".join(f"({q} - {p}) * ln({q} / {p})" for p, q in pairs)


def drift_by_feature(
    live: DataFrame,
    profile: DataFrame,
    features: Sequence[str],
    by: Sequence[str],
    bins: int = PSI_BINS,
    threshold: float = OOD_Z,
    row_id: Sequence[str] = (),
) -> DataFrame:
    """Per (batch, feature): psi, linf, ood (z-score over 3) and ood_band (outside the band).

    Missing values fall in no bin and are no outlier, but stay in the row count; they make
    linf NaN. `by` starts with the model key of the profile.
    """
    by = list(by)
    model = by[0]
    long = long_features(live, features, [*by, *[c for c in row_id if c not in by]])
    limits = profile.select(model, "feature", "mean", "std", "edge_lo", "edge_hi")
    rows = profile.limit(BROADCAST_ROWS + 1).count()
    joined = lookup_join(long, limits, [model, "feature"], spread_by=row_id, rows=rows)
    real = "x is not null and not isnan(x)"
    band = f"{float(threshold)}D * std"
    cells = with_bin(joined, bins).selectExpr(
        *by,
        "feature",
        "_bin",
        "abs(x - mean) as _off",
        f"{real} as _real",
        f"{real} and abs(x - mean) / (std + {EPSILON}D) > {OOD_Z}D as _far",
        f"{real} and std <> 0 and (x < mean - {band} or x > mean + {band}) as _out",
    )
    counted = cells.groupBy(*by, "feature").agg(
        F.expr("count(*) as n"),
        F.expr("max(_off) as _off"),
        F.expr("count_if(_real) as _real"),
        F.expr("count_if(_far) as _far"),
        F.expr("count_if(_out) as _out"),
        *_bin_counts(bins),
    )
    with_shares = counted.selectExpr(
        *by, "feature", "n", "_off", "_real", "_far", "_out", f"{_bin_shares(bins)} as q"
    )
    scored = lookup_join(
        with_shares, profile.select(model, "feature", "std", "p"), [model, "feature"],
        spread_by=by, rows=rows,
    )
    return scored.selectExpr(
        *by,
        "feature",
        "n",
        f"{_psi(bins)} as psi",
        f"if(_real < n, double('nan'), _off / (std + {EPSILON}D)) as linf",
        "_far / n as ood",
        "_out / n as ood_band",
    )


def drift_metrics(per_feature: DataFrame, by: Sequence[str]) -> DataFrame:
    """Batch values: mean over the features, psi capped at 1 (NaN stays NaN)."""
    means = per_feature.groupBy(*by).agg(
        F.avg("psi").alias("_psi"), F.avg("linf").alias("linf"), F.avg("ood").alias("ood_score")
    )
    capped = "if(isnan(_psi), _psi, least(_psi, 1D)) as psi"
    return means.selectExpr(*by, capped, "linf", "ood_score")


def drift(live: DataFrame, profile: DataFrame, spec: BatchSpec, bins: int = PSI_BINS) -> DataFrame:
    per_feature = drift_by_feature(
        live, profile, spec.numerical, spec.by, bins, row_id=spec.row_id
    )
    return drift_metrics(per_feature, spec.by)


def security(per_feature: DataFrame, by: Sequence[str]) -> DataFrame:
    """Single-feature view: distance of the farthest row and share outside the band."""
    pair = "named_struct('linf', linf, 'ood_score', ood_band) as security"
    return per_feature.selectExpr(*by, "feature", pair)
