"""From candidate collections to an exported corpus: license, merge, clean, coverage, score, validate, format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import curate, gates, quality
from gristmill.operators.stages import Stage
from gristmill.scratch import Scratch
from gristmill.sources import writers

ROW = ("row_id", "origin", "language", "text")


def license_stage(candidates: DataFrame, intended_use: str = "commercial") -> DataFrame:
    """Decision for each candidate (``origin, license_name``)."""
    decided = gates.license_decision(candidates, gates.resolve_license(F.col("license_name")), intended_use)
    return decided.select("origin", "license", "compatible", "status", "reason")


def merge_stage(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows (``row_id, origin, language, text``) of the candidates that passed."""
    passed = decisions.where("compatible").select("origin", "license")
    return rows.select(*ROW).join(passed, "origin").select(*ROW, "license")


def clean_stage(merged: DataFrame) -> DataFrame:
    """Texts stripped and masked, blank ones and copies gone; ``lineage`` names all origins of a text.

    Copies are found by digests, one narrow row each; of a text the least id stays. The list of
    origins is as long as there are candidates at most. Masked texts are written, so that they are
    masked once.
    """
    stripped = merged.withColumn("text", tx.blank_to_null(F.col("text"))).where("text is not null")
    rows = Scratch(merged.sparkSession, "assembly").keep(stripped.withColumn("text", gates.mask_pii(F.col("text"))), "masked")
    by_origin = rows.select(F.sha2("text", 256).alias("digest"), "origin", "row_id").groupBy("digest", "origin").agg(
        F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("copies")
    )
    leaders = by_origin.groupBy("digest").agg(
        F.min("row_id").alias("row_id"), F.sort_array(F.collect_list("origin")).alias("lineage"), F.sum("copies").alias("copies")
    )
    return rows.join(leaders.drop("digest"), "row_id")


def coverage_stage(cleaned: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows at hand of each wanted language (``language, needed``)."""
    return quality.language_coverage(cleaned, "language", wanted)


def score_stage(cleaned: DataFrame, quality_profile: str = "production") -> DataFrame:
    metrics = quality.quality_metrics(cleaned, "origin", ["origin", "language", "text"])
    return quality.quality_report(metrics, quality_profile)


def validate_stage(cleaned: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per candidate: rows or at least an approved license, and what the export would hold."""
    return quality.validation(decisions.select("origin"), "origin", cleaned, decisions.where("compatible"))


def export_rows(kept: DataFrame, approved: DataFrame, folder: str) -> None:
    """Writes the rows, or the approved candidates if there are none, as JSON lines."""
    spark = kept.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    # What a stopped run has left here is written anew.
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    writers.write_jsonl(writers.rows_or_candidates(kept, approved), folder)


def format_stage(cleaned: DataFrame, decisions: DataFrame, folder: str) -> DataFrame:
    """Exports the corpus; the files' checksums."""
    kept = cleaned.select("row_id", "origin", "language", "text", "lineage", "license")
    export_rows(kept, decisions.where("compatible"), folder)
    return writers.artifact_checksums(cleaned.sparkSession, folder)


def stages(
    export_folder: str,
    wanted: Sequence[tuple[str, int]] = (),
    intended_use: str = "commercial",
    quality_profile: str = "production",
) -> list[Stage]:
    """The chain over the sources ``candidates`` (``origin, license_name``) and ``rows``.

    ``wanted`` lists the languages asked for and how many rows of each are needed.
    """
    wanted = sorted(wanted)

    def coverage(cleaned: DataFrame) -> DataFrame:
        return coverage_stage(cleaned, cleaned.sparkSession.createDataFrame(wanted, "language string, needed long"))

    return [
        Stage("license", ("candidates",), lambda c: license_stage(c, intended_use), f"1-{intended_use}"),
        Stage("merge", ("rows", "license"), merge_stage),
        Stage("clean", ("merge",), clean_stage),
        Stage("coverage", ("clean",), coverage, f"1-{wanted}"),
        Stage("score", ("clean",), lambda c: score_stage(c, quality_profile), f"1-{quality_profile}"),
        Stage("validate", ("clean", "license"), validate_stage),
        Stage("format", ("clean", "license"), lambda c, d: format_stage(c, d, export_folder), f"1-{export_folder}"),
    ]


def summary(frames: dict[str, DataFrame]) -> DataFrame:
    """(stage, subject, measure, value) of all that the chain found out, values as text."""

    def told(stage: str, subject: Column, measures: Sequence[str]) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("string").alias("value")) for m in measures])
        return frames[stage].select(F.lit(stage).alias("stage"), subject.cast("string").alias("subject"), F.inline(entries))

    parts = [
        told("license", F.col("origin"), ("license", "status")),
        told("coverage", F.col("language"), ("row_count", "coverage", "short_by")),
        told("score", F.col("origin"), ("row_count", "score", "status", *quality.DIMENSIONS)),
        told("validate", F.col("origin"), ("ready", "record_count", "candidate_count", "mode")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_export(spark: SparkSession, folder: str) -> DataFrame:
    schema = "row_id STRING, origin STRING, language STRING, text STRING, lineage ARRAY<STRING>, license STRING"
    return spark.read.schema(schema).json(folder)
