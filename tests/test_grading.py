"""Bands, directions, persistence against a step-by-step fold, history and epochs."""

import random

import pytest
from pyspark.sql import functions as F

from modelpulse.functions import ordering
from modelpulse.operators import grading
from modelpulse.spec import DOMAINS


def graded(spark, value, mean, std, direction="upper", domain="standard"):
    metrics = spark.createDataFrame([("m", 1, "x", value)], "model_id string, batch int, metric string, value double")
    summary = spark.createDataFrame([("m", "x", mean, std)], "model_id string, metric string, mean double, std double")
    return grading.grade_raw(metrics, summary, domain, {"x": direction}).collect()[0].raw


@pytest.mark.parametrize(
    "value, mean, std, direction, domain, wanted",
    [
        (0.06, 0.05, 0.01, "upper", "standard", "normal"),
        (0.071, 0.05, 0.01, "upper", "standard", "warning"),
        (0.085, 0.05, 0.01, "upper", "standard", "critical"),
        (0.82, 0.80, 0.05, "lower", "standard", "normal"),
        (0.69, 0.80, 0.05, "lower", "standard", "warning"),
        (0.60, 0.80, 0.05, "lower", "standard", "critical"),
        (0.09, 0.05, 0.01, "two-sided", "standard", "critical"),
        (0.071, 0.05, 0.01, "upper", "healthcare", "critical"),
        (0.06, 0.05, 0.0, "upper", "standard", "normal"),
        (0.06, 0.05, 0.01, "sideways", "standard", None),
        (0.06, 0.05, 0.01, "upper", "unknown", None),
        (float("nan"), 0.05, 0.01, "upper", "standard", "normal"),
        (float("nan"), 0.05, 0.01, "lower", "standard", "normal"),
    ],
)
def test_bands(spark, value, mean, std, direction, domain, wanted):
    assert graded(spark, value, mean, std, direction, domain) == wanted


def test_missing_baseline_is_kept_apart(spark):
    assert graded(spark, 0.1, None, None) == "no_baseline"


def folded(rows, domain):
    """Statuses of one series computed batch by batch."""
    need, k, history, out = DOMAINS[domain]["persistence"], DOMAINS[domain]["k"], [], []
    for raw, value, mean, std in rows:
        status = raw
        if need > 0 and raw in ("warning", "critical"):
            failures = sum(h in ("warning", "critical") for h in history[-need:])
            if value > mean + k * 3 * std:
                status = "critical"
            else:
                status = "warning" if failures < need else "critical"
        history.append(status)
        out.append(status)
    return out


@pytest.mark.parametrize("block", [3, 7, 100_000])
def test_persistence_equals_fold(spark, block, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", block)
    monkeypatch.setattr(ordering.overlapped, "__defaults__", (block,))
    random.seed(block)
    data, wanted = [], {}
    for domain in DOMAINS:
        for series in range(4):
            name, rows = f"{domain}{series}", []
            for batch in range(60):
                value = random.choice([0.0, 0.0, 1.5, 2.6, 3.5, 50.0])
                rows.append((name, "x", batch, domain, value))
            data += rows
            k = DOMAINS[domain]["k"]
            raw = ["critical" if v > k else "warning" if v > k - 1 else "normal" for *_, v in rows]
            final = folded([(r, row[4], 0.0, 1.0) for r, row in zip(raw, rows)], domain)
            wanted.update({(name, b): s for b, s in enumerate(final)})
    metrics = spark.createDataFrame(data, "model_id string, metric string, batch int, dom string, value double")
    summary = metrics.select("model_id", "metric", F.lit(0.0).alias("mean"), F.lit(1.0).alias("std")).distinct()
    out = grading.grade(metrics, summary, F.col("dom"), ["model_id", "batch"]).collect()
    assert {(r.model_id, r.batch): r.status for r in out} == wanted


def test_persistence_examples(spark):
    def run(raws, domain):
        rows = [("m", "x", i, v) for i, v in enumerate(raws)]
        metrics = spark.createDataFrame(rows, "model_id string, metric string, batch int, value double")
        summary = spark.createDataFrame([("m", "x", 0.0, 1.0)], "model_id string, metric string, mean double, std double")
        out = grading.grade(metrics, summary, domain, ["model_id", "batch"])
        return [r.status for r in out.orderBy("batch").collect()]

    assert run([4.0] * 5, "standard") == ["warning"] * 3 + ["critical"] * 2
    assert run([2.0, 2.0], "finance") == ["warning", "critical"]
    assert run([4.0, 4.0], "healthcare") == ["critical", "critical"]


def test_history_without_persistence(spark):
    rows = [("m", "x", i, 4.0) for i in range(3)]
    metrics = spark.createDataFrame(rows, "model_id string, metric string, batch int, value double")
    summary = spark.createDataFrame([("m", "x", 0.0, 1.0)], "model_id string, metric string, mean double, std double")
    out = grading.grade(metrics, summary, "standard", ["model_id", "batch"], with_history=False)
    assert {r.status for r in out.collect()} == {"critical"}


def test_status_history_keeps_five(spark):
    rows = [("m", "x", i, "normal" if i % 2 else "warning") for i in range(7)] + [("m", "y", 0, "no_baseline")]
    df = spark.createDataFrame(rows, "model_id string, metric string, batch int, status string")
    out = grading.status_history(df, ["model_id", "metric"], ["batch"]).orderBy("batch").collect()
    assert len(out) == 7
    assert out[1].history == ["warning", "normal"]
    assert out[6].history == ["warning", "normal", "warning", "normal", "warning"]


def test_reset_epochs(spark):
    rows = spark.createDataFrame([("m", i) for i in range(6)] + [("o", 1)], "model_id string, batch int")
    resets = spark.createDataFrame([("m", 2), ("m", 4), ("m", 4)], "model_id string, batch int")
    out = grading.reset_epochs(rows, resets, ["model_id"], "batch").collect()
    assert {(r.model_id, r.batch): r.epoch for r in out} == {
        ("m", 0): 0, ("m", 1): 0, ("m", 2): 1, ("m", 3): 1, ("m", 4): 3, ("m", 5): 3, ("o", 1): 0,
    }


def test_overall(spark):
    rows = [(1, "normal"), (1, "warning"), (2, "critical"), (2, "warning"), (3, "no_baseline")]
    df = spark.createDataFrame(rows, "b int, status string")
    out = {r.b: r.status for r in grading.overall_status(df, ["b"]).collect()}
    assert out == {1: "warning", 2: "critical", 3: "normal"}
