"""Exports, checksums and manifests. All paths may be on any file system Spark can write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT_FORMATS = {"json": "json", "jsonl": "json", "csv": "csv", "parquet": "parquet"}
# Files are hashed whole, as one row of at most 2 GB each.
FILE_BYTES = 128 << 20


def records_per_file(df: DataFrame) -> int:
    """Rows that take about ``FILE_BYTES``, by the mean length of the rows as text."""
    whole = F.octet_length(F.to_json(F.struct(*df.columns)))
    mean = df.agg(F.avg(whole)).first()[0]
    return max(1, int(FILE_BYTES / max(1.0, mean or 1.0)))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, keys in name order, nulls written."""
    ordered = df.select(*sorted(df.columns))
    writer = ordered.write.option("ignoreNullFields", "false").option("maxRecordsPerFile", records_per_file(df))
    writer.mode("error").json(path)


def export(df: DataFrame, path: str, file_format: str = "jsonl", partition_by: list[str] | None = None) -> None:
    """Dataset in one of the export formats, split into files of bounded size."""
    if file_format not in EXPORT_FORMATS:
        raise ValueError(f"unsupported export format {file_format}; known: {', '.join(EXPORT_FORMATS)}")
    writer = df.write.mode("error").option("maxRecordsPerFile", records_per_file(df))
    if file_format == "csv":
        # Values are written as they are: white space kept, quotes doubled.
        kept = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "escape": '"'}
        writer = writer.options(header="true", **kept)
    if file_format in ("json", "jsonl"):
        writer = writer.option("ignoreNullFields", "false")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(EXPORT_FORMATS[file_format]).save(path)


def rows_or_candidates(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """The dataset to export: its rows, or the approved candidates' metadata when it has none."""
    return candidates if rows.isEmpty() else rows


def write_reports(reports: DataFrame, path: str) -> None:
    """Report texts (``name, report, text``) as JSON lines, one folder per kind of report."""
    reports.write.mode("error").option("maxRecordsPerFile", records_per_file(reports)).partitionBy("report").json(path)


def list_reports(spark: SparkSession, path: str) -> DataFrame:
    """Files below a reports folder, sorted."""
    return artifact_checksums(spark, path).select("artifact").orderBy("artifact")


def artifact_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Path below ``path``, size and SHA-256 of every data file; files are hashed in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", path.rstrip("/") + "/", -1)
    return files.select(name.alias("artifact"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def content_digest(text: Column) -> Column:
    """SHA-256 of a source's content."""
    return F.sha2(text, 256)


def write_manifest(spark: SparkSession, path: str, run_id: str, workflow: str, project: str = "Gristmill") -> str:
    """Inventory of an export with checksums, written as JSON lines beside it."""
    manifest = f"{path.rstrip('/')}.manifest"
    inventory = artifact_checksums(spark, path).select(
        F.lit(project).alias("project"), F.lit(run_id).alias("run_id"), F.lit(workflow).alias("workflow"), "artifact", "size", "sha256"
    )
    inventory.write.mode("error").json(manifest)
    return manifest


def package(frames: dict[str, DataFrame], path: str, run_id: str, workflow: str = "uploaded_dataset_package") -> str:
    """Normalized rows, profile, card data and reports under one folder, plus their manifest."""
    write_jsonl(frames["normalized"], f"{path}/normalized_dataset")
    write_jsonl(frames["column_profile"], f"{path}/schema")
    write_jsonl(frames["facts"], f"{path}/ingestion_report")
    write_reports(frames["reports"], f"{path}/reports")
    return write_manifest(frames["facts"].sparkSession, path, run_id, workflow)
