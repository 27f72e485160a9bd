"""The paths taken when no lookup table is small enough to broadcast give the same results."""

import dataclasses

from modelpulse.functions import joins
from modelpulse.operators import drift as dr
from modelpulse.operators import explain, validation
from modelpulse.plans import monitor
from modelpulse.sources import tables as t


def metrics(spark, sf_dir):
    spec = dataclasses.replace(t.EVENTS_SPEC, shap="shap")
    scored = t.scored_events(spark, sf_dir)
    before = t.baseline_rows(scored)
    live = t.with_shap(t.live_rows(scored), before, spec)
    profile = dr.baseline_profile(before, spec.numerical, row_id=spec.row_id)
    rows = monitor.vitals_metrics(live, profile, spec).collect()
    return {(r.model_id, r.batch, r.metric): round(r.value, 9) for r in rows}


def test_vitals_without_broadcast(spark, sf_dir, monkeypatch):
    small = metrics(spark, sf_dir)
    how, spread, _, _, rows = joins.lookup_join.__defaults__
    monkeypatch.setattr(joins.lookup_join, "__defaults__", (how, spread, 0, 4, rows))
    monkeypatch.setattr(explain, "BROADCAST_ROWS", 0)
    assert metrics(spark, sf_dir) == small and small


def test_rejecting_without_broadcast(spark):
    df = spark.createDataFrame([("m", b, i) for b in range(3) for i in range(20)], "model_id string, batch int, id int")
    bad = spark.createDataFrame([("m", 1)], "model_id string, batch int")
    few = validation.accepted(df, bad, ["model_id", "batch"])
    many = validation.accepted(df, bad, ["model_id", "batch"], ["id"], rows=joins.BROADCAST_ROWS + 1)
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 40
