"""Scored tables built from the warehouse tables, in the shape the monitoring operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelpulse.functions.joins import lookup_join
from modelpulse.functions.storage import settle_counted
from modelpulse.spec import BatchSpec, Protected

LIVE_FROM = "2024-01-11"
LINEITEM_LIVE_FROM = "1998-01-01"

EVENTS_SPEC = BatchSpec(
    numerical=("value", "k"),
    categorical=("event_type",),
    prediction="prediction",
    quasi=("user_id", "event_type"),
    protected=Protected("categorical", ("event_type",)),
    row_id=("event_id",),
)
LINEITEM_SPEC = BatchSpec(
    numerical=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    prediction="prediction",
    quasi=("l_suppkey", "l_quantity"),
    protected=Protected("categorical", ("l_returnflag",)),
    row_id=("l_orderkey", "l_linenumber"),
)
DOCS_SPEC = BatchSpec(
    numerical=("n_chars",),
    prediction="quality",
    quasi=("source", "lang"),
    protected=Protected("one_hot", ("is_en", "is_fr", "is_de", "is_es")),
    prediction_type="binary",
    row_id=("doc_id",),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_source(df: DataFrame, spec: BatchSpec) -> DataFrame:
    """Only the columns a spec names, so the scan reads no others."""
    protected = spec.protected.columns if spec.protected else ()
    wanted = [
        *spec.row_id, spec.ts, *spec.keys, *spec.features, *spec.numerical, spec.prediction,
        *protected, *spec.quasi, *([spec.shap] if spec.shap else []),
    ]
    return df.select(*dict.fromkeys(c for c in wanted if c in df.columns))


def score_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        "event_id",
        "ts",
        F.concat(F.lit("m"), F.pmod("user_id", F.lit(4)).cast("string")).alias("model_id"),
        F.to_date("ts").alias("batch"),
        "value",
        k.alias("k"),
        "event_type",
        "user_id",
        (k / 100).alias("prediction"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_events(table(spark, sf_dir, "events"))


def baseline_rows(df: DataFrame, start: str = LIVE_FROM, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) < F.lit(start).cast("timestamp_ntz"))


def live_rows(df: DataFrame, start: str = LIVE_FROM, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))


def with_shap(live: DataFrame, baseline: DataFrame, spec: BatchSpec, name: str = "shap") -> DataFrame:
    """Attribution of a linear model of one feature: prediction minus its baseline mean."""
    means, rows = settle_counted(
        baseline.groupBy(spec.model).agg(F.avg(spec.prediction).alias("_mean"))
    )
    joined = lookup_join(live, means, [spec.model], "left", spread_by=spec.row_id, rows=rows)
    return joined.withColumn(name, F.col(spec.prediction) - F.col("_mean")).drop("_mean")


def scored_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").alias("ts"),
        F.col("l_linestatus").alias("model_id"),
        F.date_format("l_shipdate", "yyyy-MM").alias("batch"),
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
        (F.col("l_discount") * 10 + 0.0).alias("prediction"),
    )


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    flags = [
        F.when(F.col("lang") == c, 1).otherwise(0).cast("tinyint").alias(f"is_{c}")
        for c in ("en", "fr", "de", "es")
    ]
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return joined.select("*", *flags)


def prob_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Region, nation, customer and order as stages of one large dependency graph."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")

    def named(prefix: str, key: str):
        return F.concat(F.lit(prefix), F.col(key).cast("string"))

    def nodes_of(df: DataFrame, prefix: str, key: str, owner: str) -> DataFrame:
        return df.select(named(prefix, key).alias("node"), F.lit(owner).alias("owner"))

    nodes = (
        nodes_of(region, "region_", "r_regionkey", "region")
        .unionByName(nodes_of(nation, "nation_", "n_nationkey", "nation"))
        .unionByName(nodes_of(customer, "customer_", "c_custkey", "customer"))
        .unionByName(nodes_of(orders, "order_", "o_orderkey", "orders"))
    )

    def edge(df: DataFrame, src, dst, weight) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), weight.alias("weight"))

    edges = (
        edge(nation, named("region_", "n_regionkey"), named("nation_", "n_nationkey"), F.lit(1.0))
        .unionByName(
            edge(customer, named("nation_", "c_nationkey"), named("customer_", "c_custkey"),
                 F.pmod("c_custkey", F.lit(10)) / 10)
        )
        .unionByName(
            edge(orders, named("customer_", "o_custkey"), named("order_", "o_orderkey"),
                 F.pmod("o_orderkey", F.lit(10)) / 10)
        )
    )
    return nodes, edges


def node_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status requests per event type, cut from the value bands of the events."""
    value = F.col("value")
    status = F.when(value >= 60, "critical").when(value >= 40, "warning").otherwise("green")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("node"), "ts", F.col("event_id").alias("seq"),
        status.alias("req_status"),
    )
