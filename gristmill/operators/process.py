"""A collection from raw rows to profile, scores, facts and reports in one go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import profile, quality, reports
from gristmill.scratch import Scratch
from gristmill.session import durable

DEFAULT_GATES = {"license": "USER_PROVIDED", "pii": "NOT_EVALUATED", "critical_toxicity": "NOT_EVALUATED"}


def dataset_facts(
    rows: DataFrame, dataset: str, quality_profile: str = "production", language: str | None = None
) -> DataFrame:
    """One row per dataset with everything the reports state.

    The texts are read once: each row is reduced to digests and counts, that narrow table is
    written, and every total comes from it.
    """
    columns = sorted(c for c in rows.columns if c != dataset)
    types = [profile.type_tag(rows.schema[c].dataType) for c in columns]
    layout = quality.Layout.of(columns)
    missing = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0))
    narrow = durable(
        rows.select(
            F.col(dataset).alias("name"),
            *quality.row_measures(layout),
            profile.row_digest(rows, columns).alias("_digest"),
            missing.alias("_missing"),
            (F.col(language) if language else F.lit(None).cast("string")).alias("_language"),
        )
    )
    by_row = narrow.groupBy("name", "_digest").agg(F.count(F.lit(1)).alias("n"), F.sum("_missing").alias("missing"))
    stats = by_row.groupBy("name").agg(
        (F.sum("n") - F.count(F.lit(1))).alias("duplicate_rows"), F.sum("missing").alias("missing_cells")
    )
    metrics = quality.metrics_from_measures(narrow, "name", layout)
    score = quality.quality_report(metrics, quality_profile)
    bias = quality.language_bias(narrow, "name", "_language")
    fits = F.when(F.col("max_tokens") <= quality.MAX_TOKENS, "PASS").otherwise("FAIL")
    return (
        score.join(stats, "name")
        .join(bias, "name")
        .select(
            "name",
            F.lit("uploaded_dataset_analysis").alias("purpose"),
            F.lit("uploaded").alias("domain"),
            F.split("languages", ", ").alias("languages"),
            F.lit("user_provided").alias("license"),
            "row_count", F.lit(len(columns)).alias("column_count"), "missing_cells", "duplicate_rows",
            F.array(*[F.lit(c) for c in columns]).alias("fields"),
            F.array(*[F.lit(t) for t in types]).alias("field_types"),
            F.lit(None).cast("string").alias("source_checksum"),
            F.array(F.col("name").cast("string")).alias("sources"),
            F.col("row_count").alias("output_rows"),
            "score", "threshold", "profile", "requires_generation", *quality.DIMENSIONS,
            F.col("row_count").alias("record_count"),
            # Rows of a typed table have been parsed.
            F.when(F.col("row_count") > 0, "PASS").otherwise("FAIL").alias("schema_parse"),
            F.when(F.col("row_count") > 0, "PASS").otherwise("FAIL").alias("training_readiness"),
            fits.alias("token_length_fit"),
            "distribution_risk",
            F.lit(DEFAULT_GATES["critical_toxicity"]).alias("critical_toxicity"),
        )
    )


def process_collection(
    raw: DataFrame, dataset: str, quality_profile: str = "production", language: str | None = None
) -> dict[str, DataFrame]:
    """Normalized rows, column profile, facts and report texts of every dataset in ``raw``.

    The normalized rows feed several aggregations and are therefore written once, in the shared
    folder.
    """
    rows = Scratch(raw.sparkSession, "process").keep(profile.normalize(raw), "normalized")
    facts = dataset_facts(rows, dataset, quality_profile, language)
    gates = {k: F.lit(v) for k, v in DEFAULT_GATES.items()}
    return {
        "normalized": rows,
        "column_profile": profile.column_profile(rows, dataset),
        "facts": facts,
        "reports": reports.all_reports(facts, gates),
    }


def refine(
    rows: DataFrame,
    dataset: str,
    propose: Callable[[DataFrame, int], DataFrame],
    quality_profile: str = "production",
    max_iterations: int = 3,
) -> tuple[DataFrame, DataFrame, str]:
    """Add rows to datasets below the threshold and score again, a bounded number of times.

    ``propose`` gets the reports below the threshold and the round, and returns rows to add.
    Returns the rows, their final reports and why it stopped.
    """
    columns = [c for c in rows.columns if c != "synthetic"]

    def score(current: DataFrame) -> DataFrame:
        return durable(quality.quality_report(quality.quality_metrics(current, dataset, columns), quality_profile))

    report = score(rows)
    for round_number in range(max_iterations):
        below = report.where("requires_generation")
        if below.isEmpty():
            return rows, report, "threshold reached"
        rows = durable(rows.unionByName(propose(below, round_number), allowMissingColumns=True))
        report = score(rows)
    return rows, report, "threshold reached" if report.where("requires_generation").isEmpty() else "iterations used up"
