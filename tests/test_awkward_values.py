"""Keys and columns that the friendly tables don't hold."""

import json

from modelpulse.operators import fairness
from modelpulse.sources.telemetry import explode_telemetry, pack_telemetry


def test_pack_escapes_keys_and_takes_broken_json(spark):
    rows = [('a"b\\', 1, "m", "2024-01-01T00:00:00.000Z", 1.0, '{"x":1}', "{broken")]
    df = spark.createDataFrame(rows, "k string, n int, modelId string, timestamp string, latency double, input string, output string")
    packed = pack_telemetry(df, ["k"], ["n"])
    doc = json.loads(packed.collect()[0]["value"])
    assert doc["batchId"] == 'a"b\\-0' and doc["payload"][0]["input"] == {"x": 1}
    (row,) = explode_telemetry(packed).collect()
    assert row["batch_id"] == 'a"b\\-0' and row["output"] is None


def test_one_hot_of_booleans(spark):
    rows = [("b", 1.0, True, False), ("b", 0.0, False, True), ("b", 0.0, None, True)]
    df = spark.createDataFrame(rows, "b string, p double, x boolean, y boolean")
    (row,) = fairness.parity_one_hot(df, "p", ["x", "y"], ["b"]).collect()
    assert row["statistical_parity"] == 1.0
