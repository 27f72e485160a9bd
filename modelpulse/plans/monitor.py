"""From scored rows to graded vitals, node states and records, for all models and batches."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelpulse.functions.joins import lookup_join
from modelpulse.functions.storage import settle_counted
from modelpulse.operators import baseline as base
from modelpulse.operators import drift as dr
from modelpulse.operators import batch_scan, graph, grading, reporting, series, validation
from modelpulse.sources.tables import scored_source
from modelpulse.spec import DIRECTIONS, BatchSpec


def vitals_metrics(
    live: DataFrame, profile: DataFrame, spec: BatchSpec, facts: DataFrame | None = None, batches: int | None = None
) -> DataFrame:
    """Long table (keys, metric, value) of the seven vitals; parity only with protected columns.

    `facts` are the settled facts of the batches and `batches` their number; without them they are
    taken here. Together with them the live rows are scanned four times. Without attributions
    the score is 0 for every batch and still graded; a model without a profile has no drift vitals.
    """
    live = scored_source(live, spec)
    if facts is None:
        facts, batches = settle_counted(batch_scan.batch_facts(live, spec))
    return batch_scan.vitals_of(live, profile, facts, spec, batches)


def _moment(facts: DataFrame, spec: BatchSpec) -> Column:
    """First moment of a batch; without a time column its key, where that is a time."""
    return F.col("_ts") if "_ts" in facts.columns else F.expr(f"try_cast(`{spec.by[-1]}` as timestamp)")


def vitals(
    live: DataFrame,
    summary: DataFrame,
    profile: DataFrame,
    spec: BatchSpec,
    directions: Mapping[str, str] = DIRECTIONS,
    facts: DataFrame | None = None,
    batches: int | None = None,
) -> DataFrame:
    """Graded vitals of valid batches, with the persistence rule over the batches in the order of
    their first moments; batches of one moment come by key."""
    if facts is None:
        facts, batches = settle_counted(batch_scan.batch_facts(scored_source(live, spec), spec))
    metrics = vitals_metrics(live, profile, spec, facts, batches)
    moments = facts.select(*spec.by, _moment(facts, spec).alias("batch_ts"))
    timed = lookup_join(metrics, moments, spec.by, rows=batches)
    graded = grading.grade(timed, summary, spec.domain, spec.by, directions, order=["batch_ts", *spec.by[1:]])
    return graded.drop("batch_ts")


@dataclass
class Run:
    """Tables of one run over many batches."""

    evaluated: DataFrame  # keys, metric, value, mean, std, domain, k, direction, raw, status
    failures: DataFrame  # keys, failure
    requests: DataFrame  # keys, node, seq, req_status, system_failure
    records: DataFrame  # keys, scores, status


def profiled_models(profile: DataFrame, spec: BatchSpec) -> DataFrame:
    """Models with a usable baseline for each of their numerical features."""
    usable = profile.where(F.col("usable") & F.col("feature").isin(*spec.numerical))
    counted = usable.groupBy(spec.model).agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") == len(set(spec.numerical))).select(spec.model)


def run_batches(
    live: DataFrame, baseline: DataFrame, spec: BatchSpec, stage: str = "inference"
) -> Run:
    """Validate, compute, grade and record all batches.

    Rejected batches leave the metric path and become failures; they ask for a critical
    state of their node like a critical batch does. The node of a model is its key, and a
    request is made at the first moment of its batch.
    """
    by = spec.by
    described = list(dict.fromkeys([*spec.numerical, spec.prediction]))
    profile = dr.baseline_profile(baseline, described, spec.model, row_id=spec.row_id)
    summary = base.summary_from_profile(profile, spec)
    facts, batches = settle_counted(batch_scan.batch_facts(live, spec))
    violations = validation.violations_of(facts, live, spec, profiled=profiled_models(profile, spec))
    moments = facts.select(*by, _moment(facts, spec).alias("_at"))
    told = lookup_join(violations, moments, by, rows=batches)
    failed, rejected = settle_counted(validation.failures(told, spec, stage, "_at"))
    valid, known = live, facts
    if rejected:
        valid = validation.accepted(live, failed, by, spec.row_id, rejected)
        known = validation.accepted(facts, failed, by, by, rejected)
    evaluated = vitals(valid, summary, profile, spec, facts=known, batches=batches)
    overall = grading.overall_status(evaluated, by)
    requests = graph.node_requests(
        lookup_join(overall, moments, by, rows=batches), lookup_join(failed, moments, by, rows=batches),
        by, F.col(spec.model), F.col("_at"),
    )
    return Run(evaluated, failed, requests, reporting.vitals_record(evaluated, by))


def run_pipeline(
    live: DataFrame,
    baseline: DataFrame,
    spec: BatchSpec,
    edges: DataFrame,
    node: Column | None = None,
    timeout_seconds: float | None = None,
    until: Column | None = None,
) -> tuple[Run, DataFrame]:
    """`run_batches`, and what its requests make of a dependency graph over time.

    The second table is the `status_series` of all nodes in the order of the batches' first moments,
    then of their keys as text (`ts`, `seq`). `node` names the node of a model, by default its key.
    With a timeout a node asks for grey when it has sent no batch for longer, up to `until`.
    """
    run = run_batches(live, baseline, spec)
    named = F.col("node") if node is None else node
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in spec.by[1:]])
    requests = run.requests.select(named.alias("node"), F.col("seq").alias("ts"), key.alias("seq"), "req_status")
    if timeout_seconds is not None:
        silent = series.silence_requests(requests, timeout_seconds, until, F.lit(""))
        requests = requests.unionByName(silent)
    return run, series.status_series(requests, edges)


def record_with_trace(
    run: Run, spec: BatchSpec, nodes: DataFrame, edges: DataFrame, start: str
) -> DataFrame:
    """Records with the trace of a small stage graph as it stood after each batch.

    All batches run on the node `start`. A stage below it that a critical batch reaches over
    strong edges stays critical from then on, as nothing else clears it, so it is enough to
    know the first critical batch of a model; the stage itself follows the hysteresis rule.
    """
    model = spec.model
    if not graph.small_graph(nodes, edges):
        raise ValueError("a record holds the trace of a small graph only")
    below = graph.reach(
        edges.where(F.col("weight") >= graph.STRONG), nodes.where(F.col("node") == start)
    )
    lists = graph.adjacency(edges)

    def side(name: str) -> DataFrame:
        return lists.where(F.col("side") == name).select("node", F.col("neighbours").alias(name))

    none = F.array().cast("array<string>")
    stages = (
        nodes.join(below.withColumn("_hit", F.lit(True)), "node", "left")
        .join(side("upstream"), "node", "left")
        .join(side("downstream"), "node", "left")
        .select(
            F.struct(
                "node", "owner", F.coalesce("_hit", F.lit(False)).alias("hit"),
                F.coalesce("upstream", none).alias("upstream"),
                F.coalesce("downstream", none).alias("downstream"),
            ).alias("s")
        )
        .agg(F.array_sort(F.collect_list("s")).alias("_stages"))
    )
    asked = run.requests.withColumn("_node", F.concat_ws("/", F.col("node"), F.lit(start)))
    states = graph.node_status(
        asked.drop("node").withColumnRenamed("_node", "node"), ["seq", *spec.by[1:]], "own_status"
    ).select(*spec.by, "own_status", F.col("seq").alias("_seq_at"))
    first, models = settle_counted(
        run.requests.where(F.col("req_status") == "critical")
        .groupBy(model)
        .agg(F.min(F.struct("seq", *spec.by[1:])).alias("_first"))
    )
    # One row, joined on a constant: the stage graph was checked to be small above.
    record = (
        lookup_join(run.records.join(states, spec.by, "left"), first, [model], "left", rows=models)
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(stages.withColumn("_one", F.lit(1))), "_one")
    )
    here = F.struct(F.col("_seq_at").alias("seq"), *spec.by[1:])
    struck = F.coalesce(here >= F.col("_first"), F.lit(False))

    def entry(s):
        state = (
            F.when(s["node"] == start, F.coalesce("own_status", F.lit("green")))
            .when(s["hit"] & struck, "critical")
            .otherwise("green")
        )
        return F.struct(
            s["node"].alias("key"),
            F.struct(
                s["node"].alias("name"), s["owner"].alias("owner"), state.alias("status"),
                s["upstream"].alias("upstream"), s["downstream"].alias("downstream"),
            ).alias("value"),
        )

    trace = F.to_json(F.map_from_entries(F.transform("_stages", entry)))
    return record.select(*run.records.columns, trace.alias("wdag_trace"))
