"""Captured envelopes as they come: every record judged by itself, repeats taken once, rows typed.

An envelope is {"batchId": ..., "payload": [record, ...]}, a record {"modelId", "timestamp",
"latency", "input", "output"}. It is read as a variant, so a record of another form spoils neither
its neighbours nor its envelope. What can't be used goes to quarantine with the reason; every
envelope gives at least one row there or here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelpulse.spec import BatchSpec

RECORD = ("batch_id", "pos", "model_id", "ts", "latency", "input", "output")


def _field(of: str, name: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({of}, '$.{name}', '{kind}')")


def judged(raw: DataFrame, value: str = "value") -> DataFrame:
    """One row per record, and one for an envelope without records: RECORD, `reason`, `text`.

    `reason` is null for records that can be used; `text` is the record, or the envelope, as JSON.
    """
    doc = raw.select(F.col(value).alias("_text"), F.try_parse_json(value).alias("_doc"))
    shape = F.expr("schema_of_variant(_doc)")
    listed = F.expr("try_variant_get(_doc, '$.payload', 'array<variant>')")
    opened = doc.select(
        "_text", _field("_doc", "batchId", "string").alias("batch_id"), listed.alias("_payload"),
        F.coalesce(shape.startswith("OBJECT"), F.lit(False)).alias("_object"),
    )
    whole = (
        F.when(~F.col("_object"), "no JSON object")
        .when(F.col("batch_id").isNull(), "batchId missing")
        .when(F.col("_payload").isNull(), "payload missing")
        .when(F.size("_payload") == 0, "payload empty")
    )
    records = opened.withColumn("_whole", whole).select(
        "batch_id", "_whole", "_text",
        F.posexplode_outer(F.when(F.col("_whole").isNull(), F.col("_payload"))).alias("pos", "_r"),
    )
    latency = F.expr("variant_get(_r, '$.latency', 'variant')")
    typed = records.select(
        "batch_id",
        "pos",
        _field("_r", "modelId", "string").alias("model_id"),
        F.try_to_timestamp(_field("_r", "timestamp", "string")).alias("ts"),
        _field("_r", "latency", "double").alias("latency"),
        F.to_json(F.expr("variant_get(_r, '$.input', 'variant')")).alias("input"),
        F.to_json(F.expr("variant_get(_r, '$.output', 'variant')")).alias("output"),
        "_whole",
        F.coalesce(F.expr("schema_of_variant(_r)").startswith("OBJECT"), F.lit(False)).alias("_object"),
        (latency.isNotNull() & ~F.coalesce(F.is_variant_null(latency), F.lit(False))).alias("_timed"),
        F.when(F.col("_whole").isNull(), F.to_json("_r")).otherwise(F.col("_text")).alias("text"),
    )
    reason = (
        F.when(F.col("_whole").isNotNull(), F.col("_whole"))
        .when(~F.col("_object"), "record is no object")
        .when(F.col("model_id").isNull(), "modelId missing")
        .when(F.col("ts").isNull(), "timestamp missing or invalid")
        .when(F.col("_timed") & F.col("latency").isNull(), "latency is no number")
    )
    return typed.withColumn("reason", reason).select(*RECORD, "reason", "text")


def records(raw: DataFrame, value: str = "value") -> DataFrame:
    """The usable records of envelopes, each place (batch_id, pos) once however often it was sent."""
    return judged(raw, value).where("reason is null").select(*RECORD).dropDuplicates(["batch_id", "pos"])


def quarantined(raw: DataFrame, value: str = "value") -> DataFrame:
    """What can't be used: (batch_id, pos, reason, text); pos is null for a whole envelope."""
    return judged(raw, value).where("reason is not null").select("batch_id", "pos", "reason", "text")


def stream_records(stream: DataFrame, value: str = "value", watermark: str = "10 minutes") -> DataFrame:
    """`records` of a stream; a place is known again as long as the watermark hasn't passed it."""
    usable = judged(stream, value).where("reason is null").select(*RECORD)
    return usable.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["batch_id", "pos"])


def scored(rows: DataFrame, spec: BatchSpec, kinds: Mapping[str, str]) -> DataFrame:
    """Records as scored rows: the model key, the time, and the columns in `kinds` with their types.

    A column of the spec's outputs (prediction and attributions) is read from `output`, any other
    from `input`. A value that is missing or of another type is null, for validation to judge.
    """
    answers = {spec.prediction, spec.shap}
    opened = rows.select(
        "*", F.try_parse_json("input").alias("_in"), F.try_parse_json("output").alias("_out")
    )
    return opened.select(
        F.col("model_id").alias(spec.model), F.col("ts").alias(spec.ts), "latency",
        *[_field("_out" if c in answers else "_in", c, kind).alias(c) for c, kind in kinds.items()],
    )
