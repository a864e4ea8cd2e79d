"""Normalization, column profiles, type inference and duplicate counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import text as tx

def normalize(df: DataFrame) -> DataFrame:
    """Columns in name order, strings stripped, blank strings to null."""
    text_columns = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[
            (tx.blank_to_null(F.col(c)) if c in text_columns else F.col(c)).alias(c)
            for c in sorted(df.columns)
        ]
    )


def align(frames: list[DataFrame]) -> DataFrame:
    """Union on the sorted union of all columns; a column a frame lacks is null there."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.select(*sorted(merged.columns))


def preview(df: DataFrame, dataset: str, order: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows per dataset; only ``n`` rows per dataset and task are shuffled."""
    from pyspark.sql import Window

    position = F.row_number().over(Window.partitionBy(dataset).orderBy(*order))
    return df.withColumn("position", position).where(F.col("position") <= n)


def type_tag(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "number"
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return "object"
    if isinstance(data_type, T.NullType):
        return "null"
    return "string"


def _as_text(df: DataFrame, name: str) -> Column:
    tag = type_tag(df.schema[name].dataType)
    return F.to_json(F.col(name)) if tag == "object" else F.col(name).cast("string")


def column_profile(df: DataFrame, dataset: str) -> DataFrame:
    """Type, missing count and ratio and exact distinct count per dataset and column.

    All columns are turned into (column, value) rows once and combined by value before the
    per-column totals, so a wide table costs one shuffle rather than one per column.
    """
    columns = [c for c in df.columns if c != dataset]
    tags = {c: type_tag(df.schema[c].dataType) for c in columns}
    cells = df.select(
        dataset,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), _as_text(df, c).alias("value"))
                    for c in columns
                ]
            )
        ).alias("cell"),
    ).select(
        dataset,
        "cell.column",
        # Values of any length travel as digests.
        F.unhex(F.sha2("cell.value", 256)).alias("value"),
    )
    by_value = cells.groupBy(dataset, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    tag_of = F.create_map(*[F.lit(x) for pair in tags.items() for x in pair])
    totals = by_value.groupBy(dataset, "column").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count("value").alias("unique_count"),
    )
    return totals.select(
        dataset,
        "column",
        F.when(F.col("unique_count") == 0, "null").otherwise(tag_of[F.col("column")]).alias("type"),
        "missing_count",
        (F.col("missing_count") / F.col("n")).alias("missing_ratio"),
        "unique_count",
    )


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the row's fields in name order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def dataset_stats(df: DataFrame, dataset: str) -> DataFrame:
    """Rows, duplicate rows, missing cells and their ratio per dataset."""
    columns = [c for c in df.columns if c != dataset]
    missing = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0))
    rows = df.select(dataset, row_digest(df, columns).alias("_digest"), missing.alias("_missing"))
    by_row = rows.groupBy(dataset, "_digest").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_missing").alias("missing")
    )
    return by_row.groupBy(dataset).agg(
        F.sum("n").alias("row_count"),
        F.lit(len(columns)).alias("column_count"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicate_rows"),
        F.sum("missing").alias("missing_cells"),
        F.coalesce(
            F.try_divide(F.sum("missing").cast("double"), F.sum("n") * len(columns)), F.lit(0.0)
        ).alias("missing_ratio"),
    )


def variant_tag(value: Column) -> Column:
    """Type tag of a VARIANT value, null for missing."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (kind == "VOID"), None)
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "BIGINT", "integer")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number")
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), "object")
        .otherwise("string")
    )


def fold_types(tags: Column) -> Column:
    """One type for a column from the array of distinct tags seen in it."""
    return (
        F.when(F.size(tags) == 0, "null")
        .when(F.size(tags) == 1, F.element_at(tags, 1))
        .when(F.size(F.array_except(tags, F.array(F.lit("integer"), F.lit("number")))) == 0, "number")
        .otherwise("mixed")
    )


def variant_profile(df: DataFrame, dataset: str, row: str) -> DataFrame:
    """Profile of schema-less JSON objects held in a VARIANT column.

    A key absent from a row counts as missing there, as in ``column_profile``. Values are
    compared as canonical JSON with their type tag, so 1, 1.0 and "1" stay apart.
    """
    cells = df.select(dataset, F.explode(variant_cells(F.col(row))).alias("cell")).select(dataset, "cell.*")
    return profile_of_cells(cells, df, dataset)


def variant_cells(row: Column) -> Column:
    """A VARIANT object's fields as array of (column, tag, value): the type tag and digest of each, null for missing."""

    def cell(entry: Column) -> Column:
        value = entry["value"]
        tag = variant_tag(value)
        text = F.when(tag == "string", tx.blank_to_null(F.try_variant_get(value, "$", "string"))).otherwise(F.to_json(value))
        known = F.when(text.isNotNull(), tag)
        digest = F.when(known.isNotNull(), F.unhex(F.sha2(F.concat_ws(":", known, text), 256)))
        return F.struct(entry["key"].alias("column"), known.alias("tag"), digest.alias("value"))

    return F.transform(F.map_entries(row.cast("map<string,variant>")), cell)


def profile_of_cells(fields: DataFrame, rows: DataFrame, dataset: str) -> DataFrame:
    """Profile from ``variant_cells``, one a row, and the rows they come from."""
    by_value = fields.groupBy(dataset, "column", "tag", "value").agg(F.count(F.lit(1)).alias("n"))
    by_column = by_value.groupBy(dataset, "column").agg(
        fold_types(F.collect_set("tag")).alias("type"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("present"),
        F.count("value").alias("unique_count"),
    )
    sizes = rows.groupBy(dataset).agg(F.count(F.lit(1)).alias("n"))
    return by_column.join(sizes, dataset).select(
        dataset,
        "column",
        "type",
        (F.col("n") - F.col("present")).alias("missing_count"),
        ((F.col("n") - F.col("present")) / F.col("n")).alias("missing_ratio"),
        "unique_count",
    )
