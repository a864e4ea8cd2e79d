"""Audits over logged runs: stage order, completeness, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stage names, mandatory stages, (earlier, later) rules, required companions.
STAGES = (
    "requirement_analyzer", "clarification", "discovery", "license", "merge", "cleaning", "curator", "translation",
    "quality_evaluator", "generator", "critic", "validator", "bias", "benchmark", "formatter", "packaging",
    "explainability",
)
MANDATORY_STAGES = ("validator", "quality_evaluator", "packaging")
ORDER_RULES = (
    ("discovery", "license"),
    ("license", "merge"),
    ("merge", "cleaning"),
    ("cleaning", "curator"),
    ("curator", "translation"),
    ("license", "curator"),
    ("curator", "quality_evaluator"),
    ("translation", "quality_evaluator"),
    ("generator", "critic"),
    ("critic", "validator"),
    ("validator", "benchmark"),
    ("quality_evaluator", "formatter"),
    ("formatter", "packaging"),
    ("packaging", "explainability"),
)
COMPANIONS = {
    "generator": ("critic", "validator"),
    "discovery": ("license",),
    "merge": ("discovery", "license"),
    "cleaning": ("license",),
    "translation": ("curator",),
    "benchmark": ("validator",),
}
FAILED_STATUSES = ("FAIL", "ERROR")


def conformance(log: DataFrame, run: str, stage: str, position: str) -> DataFrame:
    """Violations per run: unknown, repeated, missing, misordered stages and missing companions.

    A run's log collapses to one row per known stage first, so the rules are checked on an
    array of at most as many entries as there are stages, however long the log is.
    """
    by_stage = log.groupBy(run, stage).agg(F.count(F.lit(1)).alias("n"), F.max(position).alias("last"))
    known = F.col(stage).isin(*STAGES)
    runs = by_stage.groupBy(run).agg(
        F.map_from_entries(F.collect_list(F.when(known, F.struct(F.col(stage), F.col("last"))))).alias("last"),
        F.map_from_entries(F.collect_list(F.when(known, F.struct(F.col(stage), F.col("n"))))).alias("n"),
    )

    def has(name: str) -> Column:
        return F.map_contains_key("last", name)

    shape = "struct<violation:string,stage:string,other:string,times:bigint>"

    def entry(kind: str, name: str, other: str | None = None, times: Column | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("violation"), F.lit(name).alias("stage"), F.lit(other).alias("other"),
            (times if times is not None else F.lit(1)).alias("times"),
        ).cast(shape)

    checks = [F.when(F.try_element_at("n", F.lit(s)) > 1, entry("duplicate", s, None, F.col("n")[s] - 1)) for s in STAGES]
    checks += [F.when(~has(s), entry("missing", s)) for s in MANDATORY_STAGES]
    checks += [
        F.when(F.try_element_at("last", F.lit(a)) > F.try_element_at("last", F.lit(b)), entry("order", a, b))
        for a, b in ORDER_RULES
    ]
    checks += [
        F.when(has(s) & ~has(c), entry("companion", s, c)) for s, needed in COMPANIONS.items() for c in needed
    ]
    found = runs.select(run, F.explode(F.array_compact(F.array(*checks))).alias("v")).select(run, "v.*")
    unknown = by_stage.where(~known).select(
        run, F.lit("unknown").alias("violation"), F.col(stage).alias("stage"), F.lit(None).cast("string").alias("other"),
        F.col("n").alias("times"),
    )
    return found.unionByName(unknown)


def progress(log: DataFrame, run: str, stage: str, position: str, status: str, score: str) -> DataFrame:
    """Stages completed, failures, the last stage and the quality history's ends, per run."""
    failed = F.col(status).isin(*FAILED_STATUSES)
    scored = F.when(F.col(stage) == "quality_evaluator", F.col(position))
    return log.groupBy(run).agg(
        F.count(F.lit(1)).alias("completed"),
        F.count_if(failed).alias("failures"),
        F.max_by(stage, position).alias("last_stage"),
        F.max_by(stage, F.when(failed, F.col(position))).alias("last_failure"),
        F.count(scored).alias("quality_checks"),
        F.min_by(score, scored).alias("first_score"),
        F.max_by(score, scored).alias("last_score"),
    )


def message_trace(messages: DataFrame) -> DataFrame:
    """Logged agent messages as trace rows, their result folded into a JSON output.

    ``messages`` has ``run_id, position, agent, status, confidence, next_action, result`` (JSON).
    """
    return messages.select(
        "run_id",
        "position",
        F.col("agent").alias("name"),
        F.lit("registry_agent").alias("engine"),
        "status",
        F.to_json(F.struct("confidence", "next_action", "result")).alias("output"),
    )


def upload_trace(runs: DataFrame) -> DataFrame:
    """The seven stage rows of an upload run.

    ``runs`` has ``run_id, request, filename, row_count, column_count, score, provider,
    manifest, dataset_card, quality_narrative``.
    """

    def item(name: str, engine: Column, **output: Column) -> Column:
        body = F.to_json(F.struct(*[v.alias(k) for k, v in output.items()]))
        return F.struct(F.lit(name).alias("name"), engine.alias("engine"), F.lit("completed").alias("status"), body.alias("output"))

    fixed, provider = F.lit("deterministic"), F.coalesce("provider", F.lit("local"))
    stages = F.array(
        item("Requirement Analyzer", fixed, request=F.coalesce("request", F.lit("Analyze uploaded dataset."))),
        item("Planner", fixed, workflow=F.lit("uploaded_dataset_package"), active_stages=F.lit(7)),
        item("Discovery / Ingestion", F.lit("dataset_processing_service"), filename=F.col("filename"),
             rows=F.col("row_count"), columns=F.col("column_count")),
        item("Quality Evaluator", F.lit("deterministic_quality_metrics"), score=F.col("score")),
        item("AI Skills", provider, summary_provider=provider),
        item("Packaging", F.lit("packaging_services"), manifest=F.col("manifest")),
        item("Explainability", provider, dataset_card=F.col("dataset_card") != "", quality_narrative=F.col("quality_narrative") != ""),
    )
    return runs.select("run_id", F.posexplode(stages).alias("position", "s")).select("run_id", "position", "s.*")
