"""Exports written to the shared folder, then hashed and listed."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import process
from gristmill.plans.registry import query, table
from gristmill.scratch import Scratch
from gristmill.session import ensure_checkpoint_dir
from gristmill.sources import readers, writers

# A list is parsed as one value, and a task gathers some hundred lists at a time.
LIST_BYTES = 1 << 20


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def _export(spark: SparkSession, sf_dir: str, file_format: str = "jsonl") -> str:
    path = _folder(spark, "export")
    writers.export(table(spark, sf_dir, "documents"), path, file_format, partition_by=["lang"])
    return path


def _sum_of(text: str) -> Column:
    """Content of many rows in any order: exclusive-or of the first 60 bits of their MD5."""
    return F.bit_xor(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"))


_SUM_SQL = "bit_xor(CAST('0x' || substr(md5({}), 1, 15) AS BIGINT))"


def _verified(spark: SparkSession, sf_dir: str, stored: DataFrame, path: str) -> DataFrame:
    """Per language: exported rows and content as read back, and whether every stored digest still holds."""
    language = F.regexp_extract("artifact", "lang=([^/]+)/", 1).alias("lang")
    again = writers.artifact_checksums(spark, path).withColumnRenamed("sha256", "now").withColumnRenamed("size", "size_now")
    checked = stored.join(again, "artifact", "full").groupBy(language).agg(
        F.min(F.coalesce((F.col("sha256") == F.col("now")) & (F.col("size") == F.col("size_now")), F.lit(False))).alias("intact")
    )
    rows = spark.read.schema(table(spark, sf_dir, "documents").schema).json(path)
    content = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("row_count"), _sum_of("text").alias("content"))
    return content.join(checked, "lang", "full")


_VERIFIED_SQL = f"SELECT lang, count(*) AS row_count, {_SUM_SQL.format('text')} AS content, TRUE AS intact FROM documents GROUP BY lang"


@query("artifact_checksums", _VERIFIED_SQL)
def artifact_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _export(spark, sf_dir)
    stored = Scratch(spark, "checksums").keep(writers.artifact_checksums(spark, path), "stored")
    return _verified(spark, sf_dir, stored, path)


@query(
    "export_round_trip",
    "SELECT lang, count(*) AS row_count, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT text) AS texts FROM documents GROUP BY lang",
)
def export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was exported, read back with its schema."""
    documents = table(spark, sf_dir, "documents")
    back = spark.read.schema(documents.schema).json(_export(spark, sf_dir))
    by_text = back.groupBy("lang", F.sha2("text", 256).alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )
    return by_text.groupBy("lang").agg(
        F.sum("n").alias("row_count"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("texts")
    )


_ROWS_SQL = "SELECT doc_id, lang, source, md5(text) AS text_md5 FROM documents"


@query("export_parquet", _ROWS_SQL)
def export_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = spark.read.parquet(_export(spark, sf_dir, "parquet"))
    return back.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@query("csv_rows", _ROWS_SQL)
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents exported as CSV and read as an upload: every value a string, line breaks kept."""
    path = _folder(spark, "csv")
    writers.export(table(spark, sf_dir, "documents"), path, "csv")
    rows = readers.read_csv(spark, path, multi_line=True).where("_corrupt_record IS NULL")
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", F.md5("text").alias("text_md5"))


@query("jsonl_rows", _ROWS_SQL)
def jsonl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read as an upload of objects."""
    path = _folder(spark, "jsonl")
    writers.write_jsonl(table(spark, sf_dir, "documents"), path)
    objects, _ = readers.split_objects(readers.read_jsonl(spark, path))
    field = lambda name, kind: F.try_variant_get("row", f"$.{name}", kind)
    return objects.select(
        field("doc_id", "bigint").alias("doc_id"),
        field("lang", "string").alias("lang"),
        field("source", "string").alias("source"),
        F.md5(field("text", "string")).alias("text_md5"),
    )


@query("json_document_files", _ROWS_SQL)
def json_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files in a folder per source, each holding a list of rows, read as whole documents."""
    path = _folder(spark, "json")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    # Rows are dealt to lists of about LIST_BYTES, whatever their ids are; most sources of a few rows need one only.
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 100)
    lists = rows.groupBy(F.col("source").alias("_of")).agg(F.ceil(size / LIST_BYTES).alias("_lists")).where("_lists > 1")
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_lists", F.lit(1)))
    grouped = (
        rows.join(F.broadcast(lists), F.col("source").eqNullSafe(F.col("_of")), "left")
        .groupBy("source", dealt.alias("part"))
        .agg(F.collect_list(F.struct("doc_id", "lang", "source", "text")).alias("rows"))
    )
    grouped.select("source", F.to_json("rows").alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("source").text(path)
    found = readers.read_json(spark, path)
    field = lambda name, kind: F.try_variant_get("row", f"$.{name}", kind)
    return found.select(
        field("doc_id", "bigint").alias("doc_id"),
        field("lang", "string").alias("lang"),
        field("source", "string").alias("source"),
        F.md5(field("text", "string")).alias("text_md5"),
    )


@query(
    "snapshot_rows",
    """SELECT o_orderkey AS dataset_id, CASE WHEN o_orderstatus = 'F' THEN 'local' ELSE o_orderpriority END AS provider, o_custkey AS owner
    FROM orders""",
)
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot whose older rows lack the provider, read with its default."""
    path = _folder(spark, "snapshot")
    provider = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("provider")
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dataset_id"), provider, F.col("o_custkey").alias("owner"))
    records.write.json(path)
    return readers.read_snapshot(spark, path, records.schema, {"provider": "local"})


@query("manifest", _VERIFIED_SQL)
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _export(spark, sf_dir)
    stored = spark.read.json(writers.write_manifest(spark, path, "run-1", "uploaded_dataset_package"))
    return _verified(spark, sf_dir, stored.where("run_id = 'run-1'"), path)


@query(
    "package_contents",
    f"""SELECT source AS name, count(*) AS row_count, {_SUM_SQL.format('text')} AS content, 4 AS profiled, 7 AS reports, TRUE AS intact
    FROM (SELECT source, nullif(trim(text, E' \\t\\n\\r'), '') AS text FROM documents) GROUP BY source""",
)
def package_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents processed and packaged, read back from the package's files."""
    path = _folder(spark, "package")
    frames = process.process_collection(table(spark, sf_dir, "documents"), "source", language="lang")
    stored = spark.read.json(writers.package(frames, path, "run-1"))
    again = writers.artifact_checksums(spark, path).select("artifact", F.col("sha256").alias("now"))
    broken = stored.join(again, "artifact", "full").agg(F.count_if(~F.col("sha256").eqNullSafe(F.col("now")))).scalar()
    rows = spark.read.json(f"{path}/normalized_dataset").groupBy(F.col("source").alias("name")).agg(
        F.count(F.lit(1)).alias("row_count"), _sum_of("text").alias("content")
    )
    profiled = spark.read.json(f"{path}/schema").groupBy(F.col("source").alias("name")).agg(
        F.count(F.lit(1)).cast("int").alias("profiled")
    )
    reports = spark.read.json(f"{path}/reports").groupBy("name").agg(F.count(F.lit(1)).cast("int").alias("reports"))
    return rows.join(profiled, "name").join(reports, "name").withColumn("intact", broken == 0)


@query("source_digest", "SELECT source, doc_id, sha256(text) AS digest FROM documents")
def source_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "source", "doc_id", writers.content_digest(F.col("text")).alias("digest")
    )
