"""Captured prediction records as JSON envelopes: unpack, pack, and check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelpulse.functions.ordering import number_rows
from modelpulse.spec import BATCH_ROWS

# Fixed format of an envelope; input and output may be any JSON and are kept as text.
ENVELOPE = (
    "batchId string, payload array<struct<modelId: string, timestamp: string,"
    " latency: double, input: string, output: string>>, _corrupt string"
)


def _parsed(raw: DataFrame, value: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return raw.withColumn("_doc", F.from_json(value, ENVELOPE, options))


def _broken() -> Column:
    return (
        F.col("_doc").isNull() | F.col("_doc._corrupt").isNotNull() | F.col("_doc.payload").isNull()
    )


def explode_telemetry(raw: DataFrame, value: str = "value") -> DataFrame:
    """One row per captured record, with the id of its envelope and its place in it."""
    good = _parsed(raw, value).where(~_broken())
    rows = good.select(
        F.col("_doc.batchId").alias("batch_id"), F.posexplode("_doc.payload").alias("pos", "_r")
    )
    return rows.select(
        "batch_id",
        "pos",
        F.col("_r.modelId").alias("model_id"),
        F.expr("try_to_timestamp(_r.timestamp)").alias("ts"),
        F.col("_r.latency").alias("latency"),
        F.col("_r.input").alias("input"),
        F.col("_r.output").alias("output"),
    )


def malformed_telemetry(raw: DataFrame, value: str = "value") -> DataFrame:
    """Envelopes that are no JSON of the fixed format, for the quarantine table."""
    return _parsed(raw, value).where(_broken()).drop("_doc")


def pack_telemetry(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = BATCH_ROWS
) -> DataFrame:
    """Envelopes of at most `size` records in arrival order (keys, batch_no, value).

    df has the columns modelId, timestamp, latency, input and output, the last two as JSON;
    one that is no JSON is left out of its record.
    """
    numbered = number_rows(df, keys, order, "_pos")
    record = F.struct(
        F.col("modelId"),
        F.col("timestamp"),
        F.round("latency", 4).alias("latency"),
        F.try_parse_json("input").alias("input"),
        F.try_parse_json("output").alias("output"),
    )
    # The JSON text is built per record: a variant cannot be sorted, its text after the
    # position can.
    parts = numbered.select(
        *keys,
        F.floor(F.col("_pos") / F.lit(size)).cast("bigint").alias("batch_no"),
        F.struct("_pos", F.to_json(record).alias("text")).alias("_part"),
    )
    packed = parts.groupBy(*keys, "batch_no").agg(F.array_sort(F.collect_list("_part")).alias("_p"))
    batch_id = F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.col("batch_no"))
    # An object of the id alone, without its frame: the id as JSON text.
    quoted = F.regexp_extract(F.to_json(F.struct(batch_id.alias("i"))), r'(?s)^\{"i":(.*)\}$', 1)
    payload = F.array_join(F.col("_p.text"), ",")
    return packed.select(
        *keys,
        "batch_no",
        batch_id.alias("batch_id"),
        F.concat(
            F.lit('{"batchId":'), quoted, F.lit(',"payload":['), payload, F.lit("]}")
        ).alias("value"),
    )


def event_records(events: DataFrame) -> DataFrame:
    """Events as capture records of the model of their user."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return events.select(
        "user_id",
        "event_id",
        F.concat(F.lit("m"), F.pmod("user_id", F.lit(4)).cast("string")).alias("modelId"),
        stamp.alias("timestamp"),
        F.col("value").alias("latency"),
        F.to_json(F.struct("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")))
        .alias("input"),
        F.col("props").alias("output"),
    )


def schema_mismatch(telemetry: DataFrame, expected: int, stage: str = "inference") -> DataFrame:
    """Failure records of envelopes with inputs of another number of features.

    One row per envelope and number received. A record whose input is no object has none.
    """
    received = F.coalesce(F.size(F.json_object_keys("input")), F.lit(0))
    counted = telemetry.groupBy("batch_id", received.alias("received")).agg(
        F.count(F.lit(1)).alias("records")
    )
    message = F.concat(
        F.lit(f"Schema mismatch: expected {expected} features, but received "),
        F.col("received").cast("string"),
        F.lit("."),
    )
    return counted.where(F.col("received") != expected).select(
        "batch_id",
        "records",
        F.lit("schema_mismatch").alias("failure_type"),
        message.alias("message"),
        F.lit(stage).alias("stage"),
        F.lit("critical").alias("severity"),
    )
