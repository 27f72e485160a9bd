"""Specs, baselines, validation, telemetry and the vitals table."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from modelpulse.operators import baseline, validation
from modelpulse.operators.drift import baseline_profile
from modelpulse.sources import store, telemetry
from modelpulse.sources.tables import scored_source
from modelpulse.spec import BatchSpec, Protected, SpecError

SPEC = BatchSpec(
    numerical=("feature1", "feature2"),
    prediction="prediction",
    quasi=("feature1",),
    protected=Protected("categorical", ("gender",)),
    keys=("model_id", "batch"),
)
SCHEMA = (
    "model_id string, batch int, feature1 int, feature2 int, prediction double, gender string,"
    " gender_m int, gender_f int"
)
GOOD = [("m", 1, 1, 2, 0.5, "M", 1, 0), ("m", 1, 3, 4, 0.7, "F", 0, 1)]


def problems(spark, rows, spec=SPEC, drop=()):
    df = spark.createDataFrame(rows, SCHEMA).drop(*drop)
    return [r.message for r in validation.check_batches(df, spec).orderBy("rule_no").collect()]


def with_value(index, value):
    return [(*r[:index], value, *r[index + 1:]) for r in GOOD]


def test_good_batch(spark):
    assert problems(spark, GOOD) == []
    one_hot = dataclasses.replace(SPEC, protected=Protected("one_hot", ("gender_m", "gender_f")))
    assert problems(spark, GOOD, one_hot) == []


@pytest.mark.parametrize(
    "rows, spec, drop, text",
    [
        (GOOD, SPEC, ("feature2",), "Feature column 'feature2' missing in data."),
        (with_value(4, None), SPEC, (), "Column 'prediction' contains only null values."),
        ([GOOD[0], (*GOOD[1][:4], float("nan"), *GOOD[1][5:])], SPEC, (), "Prediction column 'prediction' contains null values."),
        (with_value(5, "M"), SPEC, (), "Protected attribute 'gender' must contain at least two groups."),
        (with_value(6, 2), dataclasses.replace(SPEC, protected=Protected("one_hot", ("gender_m", "gender_f"))), (), "One-hot column 'gender_m' must contain only 0/1 values."),
        (with_value(6, None), dataclasses.replace(SPEC, protected=Protected("one_hot", ("gender_m", "gender_f"))), (), "Invalid one-hot encoding: each row must belong to exactly one group."),
        (GOOD, dataclasses.replace(SPEC, protected=Protected("numeric", ("gender",))), (), "Protected attribute type must be 'categorical' or 'one_hot'."),
        (GOOD, dataclasses.replace(SPEC, domain="retail"), (), "Invalid domain 'retail'."),
        (GOOD, dataclasses.replace(SPEC, numerical=("gender",), features=("gender",)), (), "Numerical feature 'gender' must be numeric."),
        (GOOD, dataclasses.replace(SPEC, categorical=("feature1",)), (), "Column 'feature1' cannot be both numerical and categorical."),
        (with_value(2, None), SPEC, (), "Quasi identifier column 'feature1' contains only null values."),
        (GOOD, dataclasses.replace(SPEC, protected=Protected("categorical", ("gender", "gender_m"))), (), "Categorical protected attribute must contain exactly one column."),
        (GOOD, dataclasses.replace(SPEC, protected=Protected("one_hot", ("gender_m",))), (), "One-hot protected attributes must contain at least two columns."),
    ],
)
def test_violations(spark, rows, spec, drop, text):
    assert text in problems(spark, rows, spec, drop)


def test_many_groups_and_first_error(spark):
    rows = [("m", 1, i, i, 0.1, f"g{i}", 1, 0) for i in range(21)]
    assert problems(spark, rows) == ["Protected attribute 'gender' has too many unique values."]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("prediction", F.lit(None).cast("double"))
    first = validation.first_errors(validation.check_batches(df, SPEC), SPEC).collect()
    assert [r.message for r in first] == ["Column 'prediction' contains only null values."]


def test_duplicate_columns(spark):
    df = spark.createDataFrame(GOOD, SCHEMA)
    twice = df.select("*", "gender")
    found = [r.message for r in validation.check_batches(twice, SPEC).collect()]
    assert found == ["Duplicate columns detected."]


def test_empty_batch_is_reported(spark):
    df = spark.createDataFrame(GOOD, SCHEMA)
    expected = spark.createDataFrame([("m", 1), ("m", 2)], "model_id string, batch int")
    out = validation.check_batches(df, SPEC, expected).collect()
    assert [(r.batch, r.message) for r in out] == [(2, "Input is empty.")]


def test_rejected_batches_leave(spark):
    rows = GOOD + [("m", 2, 1, 1, None, "M", 1, 0), ("m", 2, 1, 1, 0.3, "F", 0, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    failed = validation.failures(validation.check_batches(df, SPEC), SPEC, "stage", F.lit("2024-01-01").cast("timestamp"))
    record = failed.first()
    assert record.batch == 2 and record.failure.failure_type == "inference_crash"
    assert record.failure.severity == "critical" and record.failure.stage == "stage"
    assert {r.batch for r in validation.accepted(df, failed, SPEC.by).collect()} == {1}


def test_spec_checks():
    for bad in (dict(numerical=()), dict(quasi=()), dict(prediction_type="other"), dict(keys=())):
        with pytest.raises(SpecError):
            dataclasses.replace(SPEC, **bad)


def test_baseline_summary(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0), ("m", 3.0, 2.0)], "model_id string, prediction double, feature1 double")
    rows = {r.metric: (r.mean, r.std) for r in baseline.baseline_summary(df, SPEC).collect()}
    assert rows["gini"] == (2.0, 1.0) and rows["psi"] == (0.1, 0.05) and len(rows) == 7
    off = dataclasses.replace(SPEC, protected=None)
    assert "statistical_parity" not in {r.metric for r in baseline.baseline_summary(df, off).collect()}
    profile = baseline_profile(df, ["feature1", "prediction"])
    same = {r.metric: (r.mean, r.std) for r in baseline.summary_from_profile(profile, SPEC).collect()}
    assert same == rows


def test_baseline_check(spark):
    models = spark.createDataFrame([("m",)], "model_id string")
    summary = baseline.baseline_defaults(models, fairness=False).where("metric <> 'psi'")
    bad = summary.withColumn("std", F.expr("if(metric = 'linf', -1D, std)"))
    out = {(r.metric, r.problem) for r in baseline.check_baseline(bad, models, True).collect()}
    assert out == {
        ("gini", "missing metric"), ("psi", "missing metric"), ("statistical_parity", "missing metric"), ("linf", "negative std"),
    }


def test_scored_source_prunes(spark):
    df = spark.createDataFrame(GOOD, SCHEMA).withColumn("extra", F.lit(1))
    assert "extra" not in scored_source(df, SPEC).columns


def test_telemetry_round_trip(spark):
    rows = [(1, i, "m1", f"2024-01-01T00:00:{i:02d}.000Z", i + 0.25, '{"a":1,"b":"x"}', "3") for i in range(7)]
    df = spark.createDataFrame(rows, "user int, id int, modelId string, timestamp string, latency double, input string, output string")
    raw = telemetry.pack_telemetry(df, ["user"], ["timestamp", "id"], size=3)
    assert raw.count() == 3
    out = telemetry.explode_telemetry(raw).orderBy("batch_id", "pos").collect()
    assert len(out) == 7 and out[0].input == '{"a":1,"b":"x"}' and out[0].output == "3"
    assert [r.latency for r in out] == [i + 0.25 for i in range(7)]
    assert telemetry.malformed_telemetry(raw).count() == 0


def test_malformed_telemetry(spark):
    raw = spark.createDataFrame([("no json",), ('{"batchId":"x"}',), ('{"batchId":"y","payload":[]}',)], "value string")
    assert telemetry.malformed_telemetry(raw).count() == 2
    assert telemetry.explode_telemetry(raw).count() == 0


def test_schema_mismatch(spark):
    rows = [("b1", '{"x":1,"y":2}'), ("b1", '{"x":1}'), ("b2", "7")]
    df = spark.createDataFrame(rows, "batch_id string, input string")
    out = {r.batch_id: r.message for r in telemetry.schema_mismatch(df, 2).collect()}
    assert out == {
        "b1": "Schema mismatch: expected 2 features, but received 1.",
        "b2": "Schema mismatch: expected 2 features, but received 0.",
    }


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "normal"), ("b", 3, "critical"), ("a", 2, "warning")], "model_id string, s int, status string")
    df = df.withColumn("time", F.timestamp_seconds(F.col("s") * 86_400))
    path = str(tmp_path / "vitals")
    store.append_vitals(df.where("s < 3"), path)
    store.append_vitals(df.where("s = 3"), path)
    back = spark.read.parquet(path)
    assert back.count() == 3 and "date" in back.columns
    assert store.latest_vitals(back).first().status == "critical"
    assert {r.model_id: r.s for r in store.latest_per_model(back).collect()} == {"a": 2, "b": 3}
    empty = store.latest_vitals(back.where("s > 9")).collect()
    assert len(empty) == 1 and empty[0].status == "no_data"


def test_run_quarantines_bad_batches(spark):
    """A batch without predictions and a model without a finite baseline are set aside."""
    from modelpulse.plans.monitor import record_with_trace, run_batches

    schema = "model_id string, batch date, f double, prediction double, g string"
    day = [__import__("datetime").date(2024, 1, d) for d in range(1, 6)]
    before = [("m", day[0], float(i), i / 10, "ab"[i % 2]) for i in range(10)]
    before += [("n", day[0], float("nan"), 0.5, "a"), ("n", day[0], 1.0, 0.5, "b")]
    live = [("m", day[1], float(i), i / 10, "ab"[i % 2]) for i in range(10)]
    live += [("m", day[2], 1.0, None, "a"), ("m", day[2], 2.0, 0.1, "b")]
    live += [("m", day[3], 1.0, 0.2, "a"), ("m", day[3], 2.0, 0.1, "b")]
    live += [("n", day[1], 1.0, 0.5, "a"), ("n", day[1], 1.0, 0.5, "b")]
    spec = BatchSpec(
        numerical=("f",), prediction="prediction", quasi=("g",), protected=Protected("categorical", ("g",))
    )
    run = run_batches(spark.createDataFrame(live, schema), spark.createDataFrame(before, schema), spec)
    failed = {(r.model_id, r.batch): r.failure.message for r in run.failures.collect()}
    assert failed == {
        ("m", day[2]): "Prediction column 'prediction' contains null values.",
        ("n", day[1]): "Baseline distribution missing or not finite.",
    }
    assert {(r.model_id, r.batch) for r in run.records.collect()} == {("m", day[1]), ("m", day[3])}
    assert {r.req_status for r in run.requests.collect() if r.seq.day == 3} == {"critical"}
    nodes = spark.createDataFrame([("In", "x"), ("Out", "y")], "node string, owner string")
    edges = spark.createDataFrame([("In", "Out", 0.5)], "src string, dst string, weight double")
    traced = record_with_trace(run, spec, nodes, edges, "In")
    last = traced.where(F.col("batch") == F.lit(day[3])).select(
        F.get_json_object("wdag_trace", "$.Out.status").alias("out"),
        F.get_json_object("wdag_trace", "$.In.downstream[0]").alias("down"),
    ).first()
    # The failed batch struck the stage below, and nothing cleared it since.
    assert (last.out, last.down) == ("critical", "Out")
