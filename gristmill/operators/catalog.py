"""Catalog records from processed datasets and saved candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.functions import web

MAX_SAVED_TAGS = 16


def title_from_filename(filename: Column) -> Column:
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    return F.coalesce(F.nullif(stem, F.lit("")), filename)


def upload_tags(title: Column, columns: Column) -> Column:
    """Title tokens, column names in lower case and ``uploaded``, sorted."""
    names = F.transform(columns, F.lower)
    return F.array_sort(F.array_distinct(F.concat(tx.token_set(title), names, F.array(F.lit("uploaded")))))


def index_uploads(results: DataFrame) -> DataFrame:
    """Catalog rows of processed uploads.

    ``results`` has ``dataset_id, filename, format, row_count, columns, quality_score,
    quality_narrative, summary, created_at, user_id``.
    """
    title = title_from_filename(F.col("filename"))
    return results.select(
        "dataset_id",
        title.alias("title"),
        F.lit("local_upload").alias("source"),
        F.lit("local").alias("provider"),
        "filename",
        "format",
        F.col("row_count").alias("rows"),
        F.size("columns").alias("column_count"),
        "columns",
        upload_tags(title, F.col("columns")).alias("tags"),
        "quality_score",
        "quality_narrative",
        F.col("summary").alias("description"),
        F.col("summary").alias("ai_summary"),
        F.lit(None).cast("string").alias("source_url"),
        "created_at",
        "user_id",
    )


def api_rows(records: DataFrame) -> DataFrame:
    """Records as handed out: the id renamed, the source address under two names."""
    rest = [c for c in records.columns if c not in ("dataset_id", "source_url")]
    return records.select(F.col("dataset_id").alias("id"), "source_url", F.col("source_url").alias("url"), *rest)


def save_candidates(candidates: DataFrame, user: Column, query: Column, keep: list[str] | None = None) -> DataFrame:
    """Catalog rows of discovered candidates; those without a safe URL are left out.

    ``keep`` names columns of the candidates to carry along.
    """
    url = web.safe_http_url(F.col("url"))
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    source = F.coalesce(text("source"), F.lit("public"))
    provider = F.coalesce(text("provider"), text("source"), F.lit("public"))
    title = F.coalesce(text("title"), text("id"), F.lit("Public dataset"))
    about = F.coalesce(
        text("description"), F.concat(F.lit("Public dataset from "), source, F.lit(" saved from search."))
    )
    kept = F.slice(F.filter("tags", lambda t: tx.blank_to_null(t).isNotNull()), 1, MAX_SAVED_TAGS)
    tags = F.array_sort(F.array_distinct(F.concat(kept, F.array(F.lit("public"), F.lower(provider)))))
    asked = F.coalesce(F.nullif(query, F.lit("")), F.lit("Unavailable"))
    rows = candidates.select("*", url.alias("_url"), user.alias("user_id")).where("_url IS NOT NULL")
    card = F.concat(
        F.lit("# "), title, F.lit("\n\n## Source\n"), source, F.lit("\n\n## URL\n"), F.col("_url"),
        F.lit("\n\n## Search Context\n"), asked, F.lit("\n\n## Summary\n"), about, F.lit("\n"),
    )
    return rows.select(
        web.record_id(F.col("user_id"), F.col("_url")).alias("dataset_id"),
        title.alias("title"),
        source.alias("source"),
        provider.alias("provider"),
        F.lit("external").alias("format"),
        about.alias("description"),
        tags.alias("tags"),
        F.coalesce("downloads", F.lit(0)).alias("downloads"),
        card.alias("dataset_card"),
        F.col("_url").alias("source_url"),
        "user_id",
        *(keep or []),
    )


def scoped(records: DataFrame, user_id: str | None = None, project: str | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Records narrowed to an owner, a project and the ids a caller may see, newest first."""
    if user_id is not None:
        records = records.where(F.col("user_id") == user_id)
    if project is not None:
        records = records.where(F.col("project") == project)
    if allowed is not None:
        records = records.join(allowed.select("dataset_id"), "dataset_id", "left_semi")
    return records.orderBy(F.desc("created_at"), "dataset_id")


def get_record(records: DataFrame, key: str, value: object) -> DataFrame:
    """The record with one key value; the filter reaches the scan."""
    return records.where(F.col(key) == value)


def schema_entries(schema: Column) -> Column:
    """A map from column name to its profile as a list of entries that carry the name."""
    return F.transform(
        F.map_entries(schema), lambda e: F.struct(e["key"].alias("name"), e["value"]["type"].alias("type"), e["value"]["missing_count"].alias("missing_count"))
    )
