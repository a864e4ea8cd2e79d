"""Normalization, profiles, stats and JSON type inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import profile
from gristmill.plans.registry import query, table
from gristmill.sources import readers


@query(
    "normalize_blank_to_null",
    """WITH d AS (SELECT doc_id AS id, lang, source,
        CASE WHEN doc_id % 5 = 0 THEN E' \\t\\n ' ELSE E'  ' || text || E' \\n' END AS text FROM documents),
      c AS (SELECT conv_id AS id, turn, role, E'\\t' || text AS text FROM conversations),
      u AS (SELECT id, lang, NULL AS role, source, text, NULL AS turn FROM d
        UNION ALL SELECT id, NULL, role, NULL, text, turn FROM c)
    SELECT id, nullif(trim(lang, E' \\t\\n\\r'), '') AS lang, nullif(trim(role, E' \\t\\n\\r'), '') AS role,
      nullif(trim(source, E' \\t\\n\\r'), '') AS source, sha256(nullif(trim(text, E' \\t\\n\\r'), '')) AS text_sha,
      turn FROM u""",
)
def normalize_blank_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        "lang",
        "source",
        F.when(F.col("doc_id") % 5 == 0, F.lit(" \t\n "))
        .otherwise(F.concat(F.lit("  "), "text", F.lit(" \n")))
        .alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("id"), "turn", "role", F.concat(F.lit("\t"), "text").alias("text")
    )
    rows = profile.normalize(profile.align([documents, turns]))
    return rows.withColumn("text_sha", F.sha2("text", 256)).drop("text")


def _profile_sql(table_name: str, key: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, '{c}' AS \"column\", CASE WHEN count({c}) = 0 THEN 'null' ELSE '{tag}' END AS type, "
        f"count(*) - count({c}) AS missing_count, (count(*) - count({c})) / count(*) AS missing_ratio, "
        f"count(DISTINCT {c}) AS unique_count FROM {table_name} GROUP BY {key}"
        for c, tag in columns.items()
    )


DOCUMENT_PROFILE_SQL = _profile_sql(
    "(SELECT doc_id, text, nullif(lang, 'de') AS lang, source, n_chars FROM documents)",
    "source",
    {"doc_id": "integer", "text": "string", "lang": "string", "n_chars": "integer"},
)


@query("profile_columns", DOCUMENT_PROFILE_SQL)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("lang", F.expr("nullif(lang, 'de')"))
    return profile.column_profile(rows, "source")


@query(
    "profile_orders",
    _profile_sql(
        "orders",
        "o_orderstatus",
        {"o_orderkey": "integer", "o_custkey": "integer", "o_totalprice": "number",
         "o_orderdate": "string", "o_orderpriority": "string"},
    ),
)
def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(table(spark, sf_dir, "orders"), "o_orderstatus")


@query(
    "profile_stats",
    """WITH d AS (SELECT source, text, CASE WHEN lang <> 'de' THEN lang END AS lang FROM documents)
    SELECT source, count(*) AS row_count, 2 AS column_count,
      count(*) - count(DISTINCT coalesce(lang, '-') || ':' || text) AS duplicate_rows,
      CAST(sum(CASE WHEN lang IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_cells,
      sum(CASE WHEN lang IS NULL THEN 1 ELSE 0 END) / (count(*) * 2) AS missing_ratio
    FROM d GROUP BY source""",
)
def profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "text", F.expr("nullif(lang, 'de')").alias("lang"))
    return profile.dataset_stats(rows, "source")


@query(
    "duplicate_rows",
    """SELECT lang, count(*) AS row_count, count(*) - count(DISTINCT text) AS duplicate_rows
    FROM documents GROUP BY lang""",
)
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", "text")
    return profile.dataset_stats(rows, "lang").select("lang", "row_count", "duplicate_rows")


# One JSON object per event; the field "x" holds an integer, a fraction, text or a flag by event type.
_EVENT_JSON_SQL = """
  SELECT event_type, event_id, CASE event_type
      WHEN 'click' THEN '{"k": ' || event_id % 9 || ', "x": ' || event_id % 7 || '}'
      WHEN 'view' THEN '{"k": ' || event_id % 9 || ', "x": ' || event_id % 7 || CASE WHEN event_id % 2 = 0 THEN '.5' ELSE '' END || '}'
      WHEN 'error' THEN '{"k": ' || event_id % 9 || ', "x": "' || event_id % 7 || '"}'
      WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN '{"k": 1, "x": true}' ELSE '{"x": ["a"]}' END
      ELSE '{"k": null, "x": "  "}' END AS js
  FROM events"""


def _event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("event_id") % 7).cast("string")
    k = (F.col("event_id") % 9).cast("string")
    even = F.col("event_id") % 2 == 0
    return table(spark, sf_dir, "events").select(
        "event_type",
        "event_id",
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"k": '), k, F.lit(', "x": '), number, F.lit("}")))
        .when(
            F.col("event_type") == "view",
            F.concat(F.lit('{"k": '), k, F.lit(', "x": '), number, F.when(even, ".5").otherwise(""), F.lit("}")),
        )
        .when(F.col("event_type") == "error", F.concat(F.lit('{"k": '), k, F.lit(', "x": "'), number, F.lit('"}')))
        .when((F.col("event_type") == "signup") & even, '{"k": 1, "x": true}')
        .when(F.col("event_type") == "signup", '{"x": ["a"]}')
        .otherwise('{"k": null, "x": "  "}')
        .alias("js"),
    )


@query(
    "infer_json_types",
    f"""WITH j AS ({_EVENT_JSON_SQL}),
    f AS (SELECT event_type, unnest(['k', 'x']) AS "column", unnest([json_extract(js, '$.k'), json_extract(js, '$.x')]) AS v FROM j),
    t AS (SELECT event_type, "column", v, CASE json_type(v) WHEN 'BOOLEAN' THEN 'boolean' WHEN 'UBIGINT' THEN 'integer'
        WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'ARRAY' THEN 'object' WHEN 'OBJECT' THEN 'object'
        WHEN 'VARCHAR' THEN CASE WHEN trim(json_extract_string(v, '$')) = '' THEN NULL ELSE 'string' END END AS tag FROM f),
    g AS (SELECT event_type, "column", count(*) AS n, count(tag) AS present, count(DISTINCT tag) AS tags,
        min(tag) AS lo, max(tag) AS hi, count(DISTINCT CASE WHEN tag IS NOT NULL THEN CAST(v AS VARCHAR) END) AS unique_count
        FROM t GROUP BY 1, 2)
    SELECT event_type, "column", CASE WHEN tags = 0 THEN 'null' WHEN tags = 1 THEN lo
        WHEN tags = 2 AND lo = 'integer' AND hi = 'number' THEN 'number' ELSE 'mixed' END AS type,
      n - present AS missing_count, (n - present) / n AS missing_ratio, unique_count FROM g""",
)
def infer_json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.parse_json_lines(_event_json(spark, sf_dir), "js")
    good, _ = readers.split_objects(rows)
    return profile.variant_profile(good, "event_type", "row")


@query(
    "json_document_rows",
    """WITH d AS (SELECT conv_id, CASE conv_id % 5 WHEN 0 THEN 'list' WHEN 1 THEN 'records' WHEN 2 THEN 'rows'
        WHEN 3 THEN 'single' ELSE 'broken' END AS shape, turn, role FROM conversations)
    SELECT shape, CASE WHEN shape = 'broken' THEN 0 ELSE count(*) END AS objects,
      CASE WHEN shape = 'broken' THEN count(*) WHEN shape = 'list' THEN count(*) ELSE 0 END AS rejected
    FROM d GROUP BY shape""",
)
def json_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns wrapped as whole JSON documents of every accepted shape, plus broken ones."""
    shape = (
        F.when(F.col("conv_id") % 5 == 0, "list").when(F.col("conv_id") % 5 == 1, "records")
        .when(F.col("conv_id") % 5 == 2, "rows").when(F.col("conv_id") % 5 == 3, "single").otherwise("broken")
    )
    item = F.to_json(F.struct("turn", "role"))
    documents = table(spark, sf_dir, "conversations").select(
        shape.alias("shape"),
        F.when(shape == "list", F.concat(F.lit("["), item, F.lit(", 7]")))
        .when(shape == "records", F.concat(F.lit('{"records": ['), item, F.lit('], "data": 3}')))
        .when(shape == "rows", F.concat(F.lit('{"data": 3, "rows": ['), item, F.lit("]}")))
        .when(shape == "single", item)
        .otherwise(F.concat(F.lit("["), item))
        .alias("body"),
    )
    rows = readers.parse_json_documents(documents, "body")
    return rows.groupBy("shape").agg(
        F.count_if("is_object").alias("objects"), F.count_if(~F.col("is_object")).alias("rejected")
    )


@query(
    "preview_first_rows",
    """SELECT source, doc_id, lang, n_chars, position FROM (SELECT *, row_number() OVER (PARTITION BY source
      ORDER BY doc_id) AS position FROM documents) WHERE position <= 5""",
)
def preview_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars")
    return profile.preview(rows, "source", ["doc_id"])


@query(
    "detect_formats",
    """WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'part-' || page_id || '.CSV' WHEN 1 THEN 'a.b/part.jsonl'
        WHEN 2 THEN 'part.xlsx' ELSE 'noext' END AS path, CASE WHEN page_id % 8 = 3 THEN 'JSON' END AS given FROM pages)
    SELECT page_id, CASE WHEN f IN ('csv', 'json', 'jsonl') THEN f END AS format
    FROM (SELECT page_id, lower(coalesce(given, regexp_extract(path, '\\.([^./\\\\]+)$', 1))) AS f FROM p)""",
)
def detect_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("part-"), F.col("page_id").cast("string"), F.lit(".CSV")))
        .when(F.col("page_id") % 4 == 1, "a.b/part.jsonl").when(F.col("page_id") % 4 == 2, "part.xlsx")
        .otherwise("noext")
    )
    given = F.when(F.col("page_id") % 8 == 3, "JSON")
    return table(spark, sf_dir, "pages").select("page_id", readers.detect_format(path, given).alias("format"))
