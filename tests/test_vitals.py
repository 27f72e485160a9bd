"""Vitals on small inputs with known results, and the policy for missing values."""

import math

import pytest
from pyspark.sql import functions as F

from modelpulse.operators import drift as dr
from modelpulse.operators import explain, fairness, privacy

NAN = float("nan")


def one(df, column):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][column]


def parity(spark, groups, scores):
    df = spark.createDataFrame(list(zip(groups, scores)), "g string, p double").withColumn("b", F.lit(1))
    return one(fairness.parity_categorical(df, "p", "g", ["b"]), "statistical_parity")


@pytest.mark.parametrize(
    "groups, scores, wanted",
    [
        ("MMFF", [1, 0, 1, 0], 0.0),
        ("MMFF", [1, 1, 0, 0], 1.0),
        ("AABBCC", [1, 1, 0, 0, 1, 0], 1.0),
        ("MMM", [1, 0, 1], 0.0),
    ],
)
def test_parity_categorical(spark, groups, scores, wanted):
    assert parity(spark, groups, [float(s) for s in scores]) == wanted


def test_parity_ignores_rows_without_group(spark):
    assert parity(spark, ["M", "F", None], [1.0, 0.5, 9.0]) == 0.5
    assert parity(spark, [None, None], [1.0, 0.5]) == 0.0


def test_parity_one_hot(spark):
    df = spark.createDataFrame(
        [(1, 1, 0, 0, 1.0), (1, 1, 0, 0, 0.0), (1, 0, 1, 0, 1.0), (1, 0, 1, 0, 0.0)],
        "b int, male int, female int, other int, p double",
    )
    assert one(fairness.parity_one_hot(df, "p", ["male", "female", "other"], ["b"]), "statistical_parity") == 0.0
    assert one(fairness.parity_one_hot(df, "p", ["male", "other"], ["b"]), "statistical_parity") == 0.0


def gini(spark, values):
    df = spark.createDataFrame([(1, v) for v in values], "b int, p double")
    return one(fairness.gini(df, "p", ["b"]), "gini")


@pytest.mark.parametrize(
    "values, wanted",
    [
        ([0.5] * 4, 0.0),
        ([0.0] * 4, 0.0),
        ([0.0, 0.0, 1.0, 1.0], 0.5),
        ([0.0, 0.0, 0.0, 1.0], 0.75),
        ([-1.0, 1.0], 0.0),
        ([-1.0, -3.0, 1.0], -0.8888888888888888),
    ],
)
def test_gini(spark, values, wanted):
    assert gini(spark, values) == pytest.approx(wanted, abs=1e-12)


def test_gini_equals_all_pairs(spark):
    import random

    random.seed(3)
    values = [random.choice([0.1, 0.2, random.random()]) for _ in range(300)]
    n, mean = len(values), sum(values) / len(values)
    pairs = sum(abs(a - b) for a in values for b in values)
    assert gini(spark, values) == pytest.approx(pairs / (2 * n * n * mean), rel=1e-12)


def test_gini_missing_value_is_nan(spark):
    assert math.isnan(gini(spark, [0.5, NAN]))
    assert math.isnan(gini(spark, [0.5, None]))


def test_gini_empty_batch_has_no_row(spark):
    df = spark.createDataFrame([], "b int, p double")
    assert fairness.gini(df, "p", ["b"]).count() == 0


def test_gini_multiclass(spark):
    rows = [(1, [0.1, 0.7, 0.2]), (1, [0.6, 0.2, 0.2]), (1, [0.3, 0.3, 0.4])]
    df = spark.createDataFrame(rows, "b int, p array<double>")
    assert one(fairness.gini(df, "p", ["b"]), "gini") == pytest.approx(0.11764705882352941)


@pytest.mark.parametrize(
    "rows, wanted",
    [
        ([(25, "a"), (25, "a"), (30, "b"), (30, "b")], 1.0),
        ([(1, "a"), (2, "b"), (3, "c")], 0.0),
        ([(1, "a"), (1, "a"), (2, "b"), (3, "c")], 0.5),
        ([(1, "a")], 0.0),
        ([(1, "a")] * 3 + [(2, "b"), (3, "c")], 0.6),
        ([(1, "1"), (None, "1"), (None, "2"), (2, "2")], 0.5),
    ],
)
def test_privacy(spark, rows, wanted):
    df = spark.createDataFrame(rows, "age int, city string").withColumn("b", F.lit(1))
    assert one(privacy.privacy_score(df, ["age", "city"], ["b"]), "privacy_score") == pytest.approx(wanted)


def drifted(spark, expected, actual, **kw):
    base = spark.createDataFrame([("m", v) for v in expected], "model_id string, f double")
    live = spark.createDataFrame([("m", 1, v) for v in actual], "model_id string, batch int, f double")
    profile = dr.baseline_profile(base, ["f"])
    return dr.drift_by_feature(live, profile, ["f"], ["model_id", "batch"], **kw).collect()[0]


@pytest.mark.parametrize(
    "expected, actual, wanted",
    [
        ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5], 0.0),
        ([1] * 5, [10] * 5, 13.815496742453716),
        ([1, 2, 3, 4, 5], [5] * 5, 11.052359622080838),
        ([0, 0, 0, 0, 1], [0, 0, 0, 1, 1], 0.1961658506023453),
        ([1, 2, 3], [4, 5, 6], 12.716860118601357),
        ([5] * 4, [5] * 4, 0.0),
    ],
)
def test_psi(spark, expected, actual, wanted):
    row = drifted(spark, [float(v) for v in expected], [float(v) for v in actual])
    assert row.psi == pytest.approx(wanted, abs=1e-9)


@pytest.mark.parametrize(
    "expected, actual, wanted",
    [
        ([1, 2, 3], [1, 2, 3], 1.2247433713934262),
        ([1, 2, 3], [1, 2, 4], 2.4494867427868523),
        ([1, 2, 3], [2, 3, 10], 9.79794697114741),
        ([1, 1, 1], [10, 10, 10], 9000000.0),
    ],
)
def test_linf(spark, expected, actual, wanted):
    row = drifted(spark, [float(v) for v in expected], [float(v) for v in actual])
    assert row.linf == pytest.approx(wanted, rel=1e-9)


def test_missing_live_values(spark):
    row = drifted(spark, [0.0, 1.0, 2.0, 3.0], [0.0, None, NAN, 100.0])
    assert math.isnan(row.linf)
    # Both missing values stay in the denominator and are no outliers.
    assert row.n == 4 and row.ood == 0.25 and row.ood_band == 0.25


def test_missing_baseline_is_unusable(spark):
    base = spark.createDataFrame(
        [("m", 1.0), ("m", None), ("o", 1.0), ("o", NAN), ("i", float("inf")), ("k", 2.0)],
        "model_id string, f double",
    )
    profile = dr.baseline_profile(base, ["f"])
    bad = {r.model_id for r in dr.unusable_profiles(profile).collect()}
    assert bad == {"m", "o", "i"}


def test_constant_baseline_has_no_band(spark):
    row = drifted(spark, [0.1] * 7, [0.1, 5.0])
    assert row.ood_band == 0.0 and row.ood == 0.5


def test_bins_match_exact_edges(spark):
    import random

    import numpy as np

    random.seed(5)
    for _ in range(4):
        lo, hi = sorted((random.uniform(-5, 5), random.uniform(-5, 5)))
        edges = np.linspace(lo, hi, 11)
        expected = [lo, hi] + [random.uniform(lo, hi) for _ in range(50)]
        actual = [float(e) for e in edges] + [float(np.nextafter(e, lo - 1)) for e in edges]
        p = np.histogram(expected, edges)[0] / len(expected)
        q = np.histogram(actual, edges)[0] / len(actual)
        p, q = np.where(p == 0, 1e-6, p), np.where(q == 0, 1e-6, q)
        row = drifted(spark, expected, actual)
        assert row.psi == pytest.approx(float(np.sum((q - p) * np.log(q / p))), abs=1e-9)


def shap(spark, cells, kind="double"):
    df = spark.createDataFrame([(1, c) for c in cells], f"b int, s {kind}")
    return one(explain.shap_score(df, "s", ["b"]), "shap_importance")


@pytest.mark.parametrize(
    "cells, wanted",
    [
        ([5.0], -0.99999980000004),
        ([0.0, 0.0], 0.0),
        ([None, None], 0.0),
    ],
)
def test_shap(spark, cells, wanted):
    assert shap(spark, cells) == pytest.approx(wanted, rel=1e-9)


@pytest.mark.parametrize(
    "cells, wanted",
    [
        ([[0.1, -0.2], [0.3, -0.1]], 1.0747128261690273),
        ([[10.0, -10.0], [20.0, -20.0]], 1.4387217982388736),
        ([[-1.0, -2.0], [-3.0, -4.0]], 1.1540242974741197),
        ([[1.0, 1.0], [1.0, 1.0]], 1.9999979927885319),
        ([[10.0, 0.0], [10.0, 0.0]], 0.4999999481966364),
    ],
)
def test_shap_matrix(spark, cells, wanted):
    assert shap(spark, cells, "array<double>") == pytest.approx(wanted, rel=1e-9)


def test_feature_importance(spark):
    df = spark.createDataFrame([(1, [1.0, -3.0, 0.0]), (1, [1.0, 3.0, 0.0])], "b int, s array<double>")
    rows = explain.feature_importance_topk(df, "s", ["b"], k=2).orderBy("rank").collect()
    assert [(r.feature, r.mean_abs, r.weight) for r in rows] == [(1, 3.0, 0.75), (0, 1.0, 0.25)]


def test_minmax_of_constant_set_is_null(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", 1.0)], "m string, p double")
    rows = {(r.m, r.p): r.x for r in fairness.minmax_normalize(df, "p", ["m"], "x").collect()}
    assert rows == {("a", 2.0): 0.0, ("a", 4.0): 1.0, ("b", 1.0): None}
