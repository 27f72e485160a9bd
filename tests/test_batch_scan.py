"""The shared scans give what the single vitals give, from few scans; batches run in time order."""

import dataclasses
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from modelpulse.functions.storage import settle_counted
from modelpulse.operators import baseline as base
from modelpulse.operators import batch_scan, explain, fairness, privacy, reporting
from modelpulse.operators import drift as dr
from modelpulse.plans import monitor
from modelpulse.sources import tables as t
from modelpulse.spec import BatchSpec, Protected

START = datetime(2024, 1, 1)


def apart(live, profile, spec):
    """Every vital by its own operator, over its own scan."""
    by = spec.by
    found = {}

    def note(df, *names):
        for r in df.collect():
            for n in names:
                found[tuple(r[k] for k in by) + (n,)] = r[n]

    note(fairness.gini(live, spec.prediction, by), "gini")
    note(privacy.privacy_score(live, spec.quasi, by), "privacy_score")
    note(dr.drift(live, profile, spec), "psi", "linf", "ood_score")
    note(explain.shap_score(live, spec.shap, by), "shap_importance")
    note(fairness.statistical_parity(live, spec), "statistical_parity")
    return found


def same(rows, wanted, by):
    found = {tuple(r[k] for k in by) + (r.metric,): r.value for r in rows}
    assert set(found) == set(wanted)
    for k, v in wanted.items():
        w = found[k]
        assert (v is None and w is None) or (v != v and w != w) or abs(v - w) < 1e-9, (k, v, w)


def table(spark, seed, array, models=("a", "b")):
    rng = random.Random(seed)
    rows = []
    for m in models:
        for b in range(4):
            for i in range(rng.randrange(1, 40)):
                g = rng.choice(["x", "y", None])
                shap = None if rng.random() < 0.1 else rng.gauss(0, 1)
                shap = [shap, rng.gauss(0, 1)] if array and shap is not None else None if array else shap
                f = rng.choice([rng.gauss(0, 2), 1.0, None if b == 3 else 2.0, float("nan") if b == 2 else 3.0])
                rows.append((m, f"d{b}", START + timedelta(hours=b, seconds=i), f, rng.random(), rng.randrange(4) / 4,
                             g, int(g == "x"), int(g == "y"), shap))
    kind = "array<double>" if array else "double"
    return spark.createDataFrame(
        rows, f"model_id string, batch string, ts timestamp, f double, h double, prediction double, g string, gx int, gy int, s {kind}"
    )


SPEC = BatchSpec(
    numerical=("f", "h"), prediction="prediction", quasi=("g", "h"), protected=Protected("categorical", ("g",)), shap="s",
    row_id=("ts",),
)


@pytest.mark.parametrize("array", [False, True])
@pytest.mark.parametrize("at_once", [1, 12])
@pytest.mark.parametrize("kind", ["categorical", "one_hot"])
def test_shared_scans_equal_single_vitals(spark, monkeypatch, array, at_once, kind):
    """Also when the features of a model take several aggregations."""
    monkeypatch.setattr(batch_scan, "FEATURES_AT_ONCE", at_once)
    spec = SPEC if kind == "categorical" else dataclasses.replace(SPEC, protected=Protected("one_hot", ("gx", "gy")))
    live = table(spark, 5, array)
    before = table(spark, 6, array).where("f is not null and not isnan(f)")
    profile = dr.baseline_profile(before, spec.numerical)
    same(monitor.vitals_metrics(live, profile, spec).collect(), apart(live, profile, spec), spec.by)


def test_a_model_without_a_profile_keeps_its_other_vitals(spark):
    live = table(spark, 5, False, ("a", "new"))
    profile = dr.baseline_profile(table(spark, 6, False, ("a",)).where("f is not null and not isnan(f)"), SPEC.numerical)
    rows = monitor.vitals_metrics(live, profile, SPEC).where("model_id = 'new' and batch = 'd0'").collect()
    assert {r.metric for r in rows} == {"gini", "privacy_score", "shap_importance", "statistical_parity"}


def test_no_more_than_four_scans(spark, sf_dir):
    """Facts, drift with entropy, Gini, groups; looked up in the plans of the parts that run."""
    live = t.live_rows(t.scored_events(spark, sf_dir))
    spec = dataclasses.replace(t.EVENTS_SPEC, shap="k")
    before = t.baseline_rows(t.scored_events(spark, sf_dir))
    profile = dr.baseline_profile(before, spec.numerical)

    def scans(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return len(re.findall(r"FileScan parquet.*events\.parquet", plan))

    facts = batch_scan.batch_facts(live, spec)
    settled, n = settle_counted(facts)
    assert scans(facts) == 1
    assert scans(monitor.vitals_metrics(live, profile, spec, settled, n)) == 3


def sequence(spark, names):
    """Batches of one model at ascending moments; from the third on its groups are treated apart."""
    rng = random.Random(1)
    rows = []
    for i, b in enumerate(names):
        for k in range(20):
            prediction = 0.5 if i < 2 else (0.9, 0.1)[k % 2]
            rows.append(("m", b, START + timedelta(hours=i, seconds=k), rng.random(), prediction, "xy"[k % 2]))
    return spark.createDataFrame(rows, "model_id string, batch string, ts timestamp, f double, prediction double, g string")


def test_batches_run_in_the_order_of_time_whatever_their_names(spark):
    spec = BatchSpec(numerical=("f",), prediction="prediction", quasi=("g",), protected=Protected("categorical", ("g",)))
    before = sequence(spark, ["b1", "b2"])
    statuses = {}
    for names in (["m-1", "m-2", "m-3", "m-9", "m-10", "m-11"], ["m-01", "m-02", "m-03", "m-09", "m-10", "m-11"]):
        run = monitor.run_batches(sequence(spark, names), before, spec)
        told = {(r.batch, r.metric): r.status for r in run.evaluated.collect()}
        statuses[names[0]] = [told[b, "statistical_parity"] for b in names]
        asked = {r.batch: r.seq for r in run.requests.collect()}
        assert [asked[b] for b in names] == [START + timedelta(hours=i) for i in range(6)]
    assert statuses["m-1"] == statuses["m-01"]
    # Three alarms are warnings, the fourth in time is critical, whether its name sorts before them or not.
    assert statuses["m-1"] == ["normal", "normal", "warning", "warning", "warning", "critical"]


def test_rejected_batches_count_nothing_in_averages(spark):
    done = spark.createDataFrame([("m", 1, "gini", 0.4), ("m", 1, "psi", 0.2)], "model_id string, batch int, metric string, value double")
    asked = spark.createDataFrame([("m", 1), ("m", 2), ("n", 1)], "model_id string, batch int")
    rows = {r.model_id: r for r in reporting.vitals_summary(done, ["model_id", "batch"], batches=asked).collect()}
    assert (rows["m"].batches, rows["m"].avg_gini, rows["m"].avg_psi) == (2, 0.2, 0.1)
    assert (rows["n"].batches, rows["n"].avg_gini) == (1, 0.0)


def test_a_run_goes_through_the_graph(spark):
    spec = BatchSpec(numerical=("f",), prediction="prediction", quasi=("g",), protected=Protected("categorical", ("g",)), domain="healthcare")
    live = sequence(spark, ["m-1", "m-2", "m-3", "m-10"])
    edges = spark.createDataFrame([("m", "report", 0.9), ("report", "archive", 0.2)], "src string, dst string, weight double")
    until = F.lit(START + timedelta(hours=9))
    run, told = monitor.run_pipeline(live, sequence(spark, ["b"]), spec, edges, timeout_seconds=3 * 3600, until=until)
    asked = {r.batch: r.req_status for r in run.requests.collect()}
    rows = {(r.node, r.seq): (r.request, r.passed, r.status) for r in told.collect()}
    critical = [b for b, s in asked.items() if s == "critical"]
    assert critical and all(rows["report", b] == (None, "critical", "critical") for b in critical)
    assert rows["m", ""] == ("grey", None, "grey") and not any(n == "archive" for n, _ in rows)
