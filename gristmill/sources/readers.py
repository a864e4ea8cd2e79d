"""CSV, JSON and JSON-lines collections, read by Spark's own sources.

CSV values stay strings. A quoted line break is kept and surplus fields of a row land in
``_corrupt_record``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted formats and the keys an enclosing JSON object may hold its rows under.
FORMATS = ("csv", "json", "jsonl")
ROW_KEYS = ("records", "data", "rows")


def detect_format(path: Column, explicit: Column | None = None) -> Column:
    """Explicit format, else the file suffix, in lower case; null when it is not a known one."""
    suffix = F.regexp_extract(path, r"\.([^./\\]+)$", 1)
    chosen = F.lower(F.coalesce(F.nullif(explicit, F.lit("")), suffix) if explicit is not None else suffix)
    return F.when(chosen.isin(*FORMATS), chosen)


def require_format(path: Column, explicit: Column | None = None) -> Column:
    """As ``detect_format``, but an unknown format stops the job with a message."""
    found = detect_format(path, explicit)
    message = F.concat(
        F.lit("unsupported dataset format: "), path, F.lit("; supported: " + ", ".join(FORMATS))
    )
    return F.coalesce(found, F.raise_error(message).cast("string"))


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header row mandatory, every column a string, short rows padded with null.

    ``multi_line`` allows line breaks in quoted values; a file then is read by one task.
    """
    header = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in header.columns]
        + [T.StructField("_corrupt_record", T.StringType())]
    )
    return spark.read.csv(
        path, header=True, schema=schema, multiLine=multi_line, mode="PERMISSIVE", escape='"',
        columnNameOfCorruptRecord="_corrupt_record", enforceSchema=False,
    )


def parse_json_documents(df: DataFrame, text: str) -> DataFrame:
    """Rows of whole JSON documents: a list of rows, an object wrapping one, or a single object.

    Adds ``position`` (from 1 within the document), ``row`` (VARIANT) and ``is_object``. A
    document that is not JSON yields one row with a null ``row``.
    """
    parsed = F.try_parse_json(F.col(text))

    def listed(value: Column) -> Column:
        return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))

    keep = [c for c in df.columns if c != text]
    docs = df.select(*keep, parsed.alias("_doc"))
    chosen = F.when(listed(F.col("_doc")), F.col("_doc"))
    for key in ROW_KEYS:
        inner = F.try_variant_get("_doc", f"$.{key}", "variant")
        chosen = chosen.when(listed(inner), inner)
    rows = docs.select(
        *keep,
        F.coalesce(
            chosen.cast("array<variant>"), F.array(F.col("_doc"))
        ).alias("_rows"),
    )
    exploded = rows.select(*keep, F.posexplode("_rows").alias("_at", "row"))
    return exploded.select(
        *keep, (F.col("_at") + 1).alias("position"), "row", is_object(F.col("row")).alias("is_object")
    )


def parse_json_lines(df: DataFrame, text: str) -> DataFrame:
    """One VARIANT row per non-blank line."""
    from gristmill.functions.text import blank_to_null

    keep = [c for c in df.columns if c != text]
    return df.where(blank_to_null(F.col(text)).isNotNull()).select(
        *keep, F.try_parse_json(F.col(text)).alias("row")
    ).withColumn("is_object", is_object(F.col("row")))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def split_objects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are JSON objects, and the others for quarantine."""
    return df.where("is_object").drop("is_object"), df.where(~F.col("is_object")).drop("is_object")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON documents with their file name."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value")
    )
    return parse_json_documents(files, "value")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    return parse_json_lines(lines, "value")


def empty_datasets(datasets: DataFrame, rows: DataFrame, dataset: str) -> DataFrame:
    """Datasets that delivered no record at all."""
    return datasets.join(rows.select(dataset), dataset, "left_anti")


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """JSON snapshot of a catalog table; fields missing from older rows get their default."""
    df = spark.read.schema(schema).json(path)
    return df.select(
        *[
            (F.coalesce(F.col(c), F.lit(defaults[c])) if c in defaults else F.col(c)).alias(c)
            for c in df.columns
        ]
    )
