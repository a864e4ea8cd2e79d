"""Keyed changes to catalog tables, each giving the next snapshot as a DataFrame.

Write a snapshot to a new folder and switch readers to it; plain Parquet has no row updates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest_per_key(changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))
    return changes.withColumn("_newest", newest).where("_newest = 1").drop("_newest")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert new keys, replace whole rows of known keys by their newest change.

    Only the changes are ranked; the base is merely filtered against their keys.
    """
    newest = latest_per_key(changes, keys, version)
    return base.join(newest.select(*keys), keys, "left_anti").unionByName(newest, allowMissingColumns=True)


def upsert_columns(base: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], version: str, created: str) -> DataFrame:
    """Change only ``columns`` of known keys; the earliest ``created`` survives."""
    newest = latest_per_key(changes, keys, version)
    renamed = newest.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in [*columns, created]], F.lit(True).alias("_changed"))
    joined = base.join(renamed, keys, "full_outer")
    out = []
    for c in base.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in columns:
            out.append(F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c == created:
            out.append(F.least(F.col(c), F.col(f"_new_{c}")).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def delete_cascade(
    parents: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str, doomed: DataFrame
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents without the doomed keys, and each child table without rows pointing at them."""
    gone = doomed.select(F.col(key).alias("_gone")).distinct()
    kept = parents.join(gone, F.col(key) == F.col("_gone"), "left_anti")
    kept_children = {
        name: df.join(gone, df[foreign] == F.col("_gone"), "left_anti") for name, (df, foreign) in children.items()
    }
    return kept, kept_children


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The table under a newer schema: columns it lacks are null, surplus ones dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def encode_nested(df: DataFrame) -> DataFrame:
    """Maps, arrays and structs as JSON text, for stores without nested types."""
    nested = (T.MapType, T.ArrayType, T.StructType)
    return df.select(
        *[
            (F.to_json(F.col(f.name)) if isinstance(f.dataType, nested) else F.col(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def decode_nested(df: DataFrame, schema: T.StructType) -> DataFrame:
    nested = (T.MapType, T.ArrayType, T.StructType)
    return df.select(
        *[
            (F.from_json(F.col(f.name), f.dataType) if isinstance(f.dataType, nested) else F.col(f.name)).alias(f.name)
            for f in schema.fields
        ]
    )
