"""Late batches against a step-by-step fold; profiles merged from days against whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from modelpulse.operators import grading, profiles
from modelpulse.operators.drift import baseline_profile
from modelpulse.spec import DOMAINS, BatchSpec
from modelpulse.streaming import batches as st
from tests.test_grading import folded

SPEC = BatchSpec(numerical=("x",), prediction="x", quasi=("x",), keys=("model_id", "batch"))
SERIES, ORDER = ["model_id", "metric"], ["at", "batch"]
METRICS = "model_id string, metric string, at int, batch string, value double"


def series(rng, batches):
    """(model, metric, at, name, value): names that don't sort as their times do."""
    values = [0.0, 0.0, 1.8, 2.7, 3.5, 50.0]
    return [
        (f"m{m}", metric, at, f"m-{at}", rng.choice(values))
        for m in range(3) for metric in ("u", "v") for at in range(batches)
    ]


def wanted_of(rows, domain):
    k, out = DOMAINS[domain]["k"], {}
    for name in {r[:2] for r in rows}:
        own = sorted(r for r in rows if r[:2] == name)
        raw = ["critical" if r[4] > k else "warning" if r[4] > k - 1 else "normal" for r in own]
        final = folded([(s, r[4], 0.0, 1.0) for s, r in zip(raw, own)], domain)
        out.update({(*name, r[3]): s for r, s in zip(own, final)})
    return out


def summary_of(spark):
    rows = [(f"m{m}", metric, 0.0, 1.0) for m in range(3) for metric in ("u", "v")]
    return spark.createDataFrame(rows, "model_id string, metric string, mean double, std double")


@pytest.mark.parametrize("domain", ["finance", "standard"])
def test_epochs_with_late_batches_equal_a_fold(spark, tmp_path, domain):
    rng = random.Random(domain)
    rows = series(rng, 14)
    # "m-2" and "m-10" of every series come last, and so does all of one model before its sixth batch.
    epoch = {r: 1 if r[2] in (2, 10) or (r[0] == "m1" and r[2] < 6) else 0 for r in rows}
    first = [r for r in rows if epoch[r] == 0]
    changed = ("m0", "u", 5, "m-5", 50.0)
    second = [r for r in rows if epoch[r] == 1] + [changed]
    for no, part in enumerate([first, second, second]):
        metrics = spark.createDataFrame(part, METRICS)
        st.grade_epoch_late(metrics, summary_of(spark), SPEC, str(tmp_path), min(no, 1), ORDER, domain)
    final = [r for r in rows if r[:4] != changed[:4]] + [changed]
    now = st.current_grades(spark, str(tmp_path), SERIES, ORDER).collect()
    assert {(r.model_id, r.metric, r.batch): r.status for r in now} == wanted_of(final, domain)
    assert len(now) == len(rows)
    written = spark.read.parquet(f"{tmp_path}/evaluated/epoch=1")
    near = {(r.model_id, r.metric, r["at"]): r.late for r in written.collect()}
    assert {a for m, x, a in near if (m, x) == ("m2", "v")} == {2, 3, 4, 5, 10, 11, 12, 13}
    assert sum(near.values()) == len(second)


def test_nothing_late_changes_nothing(spark):
    raw = grading.grade_raw(spark.createDataFrame(series(random.Random(2), 5), METRICS), summary_of(spark))
    stored = grading.persist_filter(raw, SERIES, ORDER)
    assert grading.regrade_late(stored, raw.limit(0), SERIES, ORDER).count() == 0
    empty = grading.regrade_late(stored.limit(0), raw, SERIES, ORDER)
    assert sorted(r.status for r in empty.collect()) == sorted(r.status for r in stored.collect())


def test_profile_of_days_equals_the_whole(spark):
    rng = random.Random(8)
    rows = []
    for i in range(6_000):
        day, whole = i % 10, rng.randrange(100)
        far, wide = 1e9 + rng.random(), rng.gauss(0, 40)
        gap = None if day == 3 and i % 7 == 0 else float(whole)
        rows.append((f"m{i % 2}", day, float(whole), far, wide, 5.0, gap, rng.choice([0.0, -0.0, 5e-324, -1e308, 1e308])))
    features = ["whole", "far", "wide", "same", "gap", "ends"]
    df = spark.createDataFrame(rows, "model_id string, day int, " + ", ".join(f"{f} double" for f in features))
    cells = profiles.profile_cells(df, features, ["model_id", "day"])
    some = profiles.merge_cells(cells.where("day < 4"), ["model_id"])
    parts = cells.where("day >= 4").drop("day").unionByName(some)
    usual = features[:5]
    full = {(r.model_id, r.feature): r for r in baseline_profile(df, usual).collect()}
    found = {(r.model_id, r.feature): r for r in profiles.profile_from_cells(parts).collect()}
    assert len(found) == 12
    for key, want in full.items():
        got = found[key]
        assert (got.n, got.lo, got.hi, got.usable) == (want.n, want.lo, want.hi, want.usable)
        assert got["mean"] == pytest.approx(want["mean"], rel=1e-9)
        assert got["std"] == pytest.approx(want["std"], rel=1e-9 if key[1] != "far" else 1e-6)
        off = max(abs(a - b) for a, b in zip(got.p, want.p))
        assert off <= got.slack + 1e-12
        if key[1] in ("whole", "same"):
            assert got.slack == 0 and off == 0
        if key[1] == "wide":
            assert 0 < got.slack < 0.2
    assert not found["m1", "gap"].usable and found["m0", "ends"].n == 3_000
    assert (found["m0", "ends"].lo, found["m0", "ends"].hi) == (-1e308, 1e308)


def test_profile_of_no_rows(spark):
    df = spark.createDataFrame([], "model_id string, x double")
    assert profiles.profile_from_cells(profiles.profile_cells(df, ["x"], ["model_id"])).count() == 0
    none = spark.createDataFrame([("m", None), ("m", float("nan"))], "model_id string, x double")
    row = profiles.profile_from_cells(profiles.profile_cells(none, ["x"], ["model_id"])).first()
    assert (row.n, row.usable) == (2, False)
