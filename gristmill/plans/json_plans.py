"""Ragged JSON lines: scores, facts and reports of rows without a schema."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import gates, json_rows, quality
from gristmill.plans.gate_plans import GATED_SQL, gated_documents
from gristmill.plans.quality_plans import clean_sql
from gristmill.plans.registry import query, table
from gristmill.session import ensure_checkpoint_dir
from gristmill.sources import readers
from gristmill.streaming.live_quality import LiveQuality, dimensions


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, position, line): documents by source, turns by role and event properties by type.

    Fields are missing, blank or null in some lines; some lines are cut off or no objects.
    """
    i = F.col("doc_id")
    document = F.to_json(
        F.struct(
            F.when(i % 11 == 5, F.concat(F.lit("  "), "text")).otherwise(F.col("text")).alias("text"),
            F.when(i % 7 != 3, F.col("lang")).alias("lang"),
            F.when(i % 5 == 2, F.col("lang")).alias("content"),
            "n_chars",
        )
    )
    noted = F.concat(F.substr(document, F.lit(1), F.length(document) - 1), F.lit(', "note": null}'))
    documents = table(spark, sf_dir, "documents").select(
        F.col("source").alias("name"), i.alias("position"), F.when(i % 17 == 4, noted).otherwise(document).alias("line")
    )
    response = F.when(F.col("turn") % 3 == 0, F.col("role")).when(F.col("turn") % 3 == 2, F.lit(""))
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("turns-"), "role").alias("name"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("position"),
        F.to_json(F.struct(F.col("text").alias("instruction"), response.alias("response"))).alias("line"),
    )
    cut = F.substr("props", F.lit(1), F.length("props") - 1)
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("events-"), "event_type").alias("name"),
        F.col("event_id").alias("position"),
        F.when(F.col("event_id") % 50 == 7, cut).when(F.col("event_id") % 50 == 9, "[1, 2]").otherwise(F.col("props")).alias("line"),
    )
    return documents.unionByName(turns).unionByName(events)


def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parse_json_lines(json_lines(spark, sf_dir), "line")


_TRIM = "trim({0}, E' \\t\\n\\r')"
# One row per accepted line with its typed fields; a null text field is absent, ``note`` always null.
_LINES_SQL = """
  d AS (SELECT source AS name, doc_id AS position, CASE WHEN doc_id % 11 = 5 THEN '  ' || text ELSE text END AS text,
      CASE WHEN doc_id % 7 <> 3 THEN lang END AS lang, CASE WHEN doc_id % 5 = 2 THEN lang END AS content, n_chars,
      doc_id % 17 = 4 AS noted FROM documents),
  t AS (SELECT 'turns-' || role AS name, conv_id * 1000 + turn AS position, text AS instruction,
      CASE turn % 3 WHEN 0 THEN role WHEN 2 THEN '' END AS response FROM conversations),
  e AS (SELECT 'events-' || event_type AS name, event_id AS position, props FROM events WHERE event_id % 50 NOT IN (7, 9))"""

_RAGGED_SQL = f"""
  SELECT name, position, 'n_chars' || CASE WHEN lang IS NOT NULL THEN ',lang' ELSE '' END || CASE WHEN content IS NOT NULL THEN ',content' ELSE '' END
      || CASE WHEN noted THEN ',note' ELSE '' END AS keys,
    2 + (lang IS NOT NULL)::INT + (content IS NOT NULL)::INT + noted::INT AS n_values,
    1 + {clean_sql('text')} + {clean_sql('lang')} + {clean_sql('content')} AS n_clean, 'single' AS kind,
    CASE WHEN {_TRIM.format('text')} <> '' THEN 1 ELSE 0 END AS complete, {_TRIM.format('text')} AS whole, '' AS object FROM d
  UNION ALL
  SELECT name, position, 'instruction' || CASE WHEN response IS NOT NULL THEN ',response' ELSE '' END, 1 + (response IS NOT NULL)::INT,
    {clean_sql('instruction')} + {clean_sql('response')}, CASE WHEN response IS NOT NULL THEN 'pair' ELSE 'none' END,
    CASE WHEN {_TRIM.format('instruction')} <> '' AND response <> '' THEN 1 ELSE 0 END,
    {_TRIM.format("instruction || ' ' || coalesce(response, '')")},
    json_object('instruction', instruction, 'response', response)::VARCHAR FROM t
  UNION ALL SELECT name, position, 'k', 1, 1, 'none', 0, '', props FROM e"""


def _scores_sql(rows: str, consistency: str, n_values: str) -> str:
    """Dimensions of rows with ``of_kind, complete, text, n_clean, n_words`` by name."""
    dims = {
        "completeness": "sum(CASE WHEN of_kind = 'none' THEN 0 ELSE complete END) / count(*)",
        "consistency": consistency,
        "diversity": "count(DISTINCT text) / count(*)",
        "duplicate_ratio": "count(DISTINCT text) / count(*)",
        "formatting": f"sum(n_clean) / {n_values}",
        "readability": "sum(CASE WHEN of_kind <> 'none' AND n_words BETWEEN 2 AND 400 THEN 1 ELSE 0 END) / count(*)",
        "model_compatibility": "max(CASE of_kind WHEN 'pair' THEN 0.85::DOUBLE WHEN 'single' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END)"
        " * (1 - sum(CASE WHEN ceil(n_words / 0.75) > 2048 THEN 1 ELSE 0 END) / count(*))",
    }
    overall = " + ".join(f"({d}) * {quality.WEIGHTS[name]}" for name, d in dims.items())
    listed = ", ".join(f"round_even({d}, 4) AS {name}" for name, d in dims.items())
    return (
        f"SELECT name, max(of_kind) AS structure, count(*) AS row_count, {listed}, round_even({overall}, 2) AS overall,"
        f" max(CAST(ceil(n_words / 0.75) AS BIGINT)) AS max_tokens FROM ({rows}) GROUP BY name"
    )


@query(
    "json_quality",
    f"""WITH {_LINES_SQL}, r AS ({_RAGGED_SQL}),
    f AS (SELECT name, arg_min(kind, position) AS of_kind, arg_min(keys, position) AS first_keys FROM r GROUP BY name),
    p AS (SELECT r.*, of_kind, first_keys, CASE WHEN of_kind = 'none' THEN object ELSE whole END AS text FROM r JOIN f USING (name)),
    w AS (SELECT *, len(regexp_extract_all(text, '\\S+')) AS n_words FROM p)
    SELECT * EXCLUDE (max_tokens) FROM ({_scores_sql('SELECT * FROM w', 'sum(CASE WHEN keys = first_keys THEN 1 ELSE 0 END) / count(*)', 'sum(n_values)')})""",
)
def json_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = readers.split_objects(parsed_lines(spark, sf_dir))
    return json_rows.json_quality(rows, "name", "row", "position")


@query(
    "live_quality",
    f"""WITH {_LINES_SQL}, r AS ({_RAGGED_SQL}),
    f AS (SELECT name, arg_min(kind, position) AS of_kind, arg_min(keys, position) AS first_keys FROM r GROUP BY name),
    p AS (SELECT r.*, of_kind, first_keys, CASE WHEN of_kind = 'none' THEN object ELSE whole END AS text FROM r JOIN f USING (name)),
    w AS (SELECT *, len(regexp_extract_all(text, '\\S+')) AS n_words FROM p),
    q AS ({_scores_sql('SELECT * FROM w', 'sum(CASE WHEN keys = first_keys THEN 1 ELSE 0 END) / count(*)', 'sum(n_values)')}),
    refused AS (SELECT 'events-' || event_type AS name, count(*) AS rejected FROM events WHERE event_id % 50 IN (7, 9) GROUP BY ALL)
    SELECT q.* EXCLUDE (max_tokens), coalesce(rejected, 0) AS rejected, TRUE AS ready FROM q LEFT JOIN refused USING (name)""",
)
def live_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines arrive in three loads, in order within each collection; the running totals after the last."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/live-quality-{uuid4().hex}"
    lines = json_lines(spark, sf_dir)
    span = lines.groupBy("name").agg(F.min("position").alias("low"), F.max("position").alias("high"))
    load = F.floor(3 * (F.col("position") - F.col("low")) / (F.col("high") - F.col("low") + 1))
    placed = lines.join(span, "name").withColumn("load", load).drop("low", "high")
    for number in range(3):
        placed.where(F.col("load") == number).drop("load").repartition(2).write.mode("append").parquet(f"{folder}/landed")
    stream = spark.readStream.schema("name STRING, position BIGINT, line STRING").option("maxFilesPerTrigger", 2)
    live = LiveQuality(spark, f"{folder}/live")
    live.run(stream.parquet(f"{folder}/landed"), f"{folder}/progress")
    return dimensions(live.totals())


_PII = "|".join(gates.PII_PATTERNS.values())
_CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
_NONE = "NULL::VARCHAR"
# Normalized cells: value null where missing; a field of any row is a field of all.
_FACTS_SQL = f"""{_LINES_SQL},
  c AS (SELECT name, position, unnest(['text', 'lang', 'content', 'n_chars', 'note']) AS field,
      unnest([{_TRIM.format('text')}, lang, content, CAST(n_chars AS VARCHAR), {_NONE}]) AS value,
      unnest([true, lang IS NOT NULL, content IS NOT NULL, true, noted]) AS there,
      unnest(['string', 'string', 'string', 'integer', 'null']) AS type FROM d
    UNION ALL SELECT name, position, unnest(['instruction', 'response']), unnest([{_TRIM.format('instruction')}, response]),
      unnest([true, response IS NOT NULL]), unnest(['string', 'string']) FROM t
    UNION ALL SELECT name, position, 'k', props, true, 'integer' FROM e),
  cells AS (SELECT * REPLACE (nullif(value, '') AS value) FROM c WHERE there),
  cols AS (SELECT name, field, CASE WHEN count(value) = 0 THEN 'null' ELSE max(type) END AS type FROM cells GROUP BY ALL),
  shape AS (SELECT name, count(*) AS column_count, list(field ORDER BY field) AS fields, list(type ORDER BY field) AS types FROM cols GROUP BY name),
  rows_ AS (SELECT name, position, list((field, value) ORDER BY field) FILTER (WHERE value IS NOT NULL) AS object, count(value) AS present,
      max(CASE WHEN field = 'text' THEN value END) AS text, max(CASE WHEN field = 'instruction' THEN value END) AS instruction,
      max(CASE WHEN field = 'response' THEN value END) AS response, max(CASE WHEN field = 'k' THEN value END) AS k,
      max(CASE WHEN field = 'lang' THEN value END) AS lang,
      sum(CASE WHEN value IS NOT NULL AND NOT regexp_matches(value, '{_CONTROL}') THEN 1 ELSE 0 END) AS n_clean,
      bool_or(coalesce(regexp_matches(value, '{_PII}'), false)) AS pii FROM cells GROUP BY name, position),
  kinds AS (SELECT name, CASE WHEN list_contains(fields, 'response') THEN 'pair' WHEN list_contains(fields, 'text') THEN 'single' ELSE 'none' END AS of_kind,
      column_count FROM shape),
  picked AS (SELECT r.* EXCLUDE (text), of_kind, column_count, CASE of_kind WHEN 'pair' THEN trim(coalesce(instruction, '') || ' ' || coalesce(response, ''))
      WHEN 'single' THEN coalesce(text, '') ELSE k END AS text,
      CASE WHEN of_kind = 'pair' AND instruction IS NOT NULL AND response IS NOT NULL OR of_kind = 'single' AND text IS NOT NULL THEN 1 ELSE 0 END AS complete
    FROM rows_ r JOIN kinds USING (name)),
  words AS (SELECT *, len(regexp_extract_all(text, '\\S+')) AS n_words FROM picked),
  scored AS ({_scores_sql('SELECT * FROM words', '1.0::DOUBLE', '(count(*) * max(column_count))')}),
  whole AS (SELECT name, row_count, max_tokens, {', '.join(f'CAST(round_even({d} * 100, 0) AS INT) AS {d}' for d in quality.DIMENSIONS)} FROM scored),
  totals AS (SELECT name, CAST(sum(column_count - present) AS BIGINT) AS missing_cells, count(*) - count(DISTINCT coalesce(object, [])) AS duplicate_rows,
      CASE WHEN bool_or(pii) THEN 'FAIL' ELSE 'PASS' END AS gate_pii,
      array_to_string(list_sort(list(DISTINCT coalesce(lang, 'unknown'))), ', ') AS languages FROM picked GROUP BY name),
  refused AS (SELECT 'events-' || event_type AS name, count(*) AS rejected FROM events WHERE event_id % 50 IN (7, 9) GROUP BY ALL),
  verdicts AS (SELECT source AS name, CASE WHEN bool_and(license_ok) THEN 'PASS' ELSE 'FAIL' END AS license,
      CASE WHEN bool_and(tox_ok) THEN 'PASS' ELSE 'FAIL' END AS toxicity FROM ({GATED_SQL}) GROUP BY source),
  facts AS (SELECT w.*, CAST(round_even(({' + '.join(f'{d} * {n}' for d, n in quality.WEIGHTS.items())}) / 100, 0) AS INT) AS score,
      shape.column_count, shape.fields, shape.types, missing_cells, duplicate_rows, gate_pii, languages, coalesce(rejected, 0) AS rejected,
      CASE WHEN coalesce(rejected, 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS schema_parse, coalesce(license, 'USER_PROVIDED') AS gate_license,
      coalesce(toxicity, 'NOT_EVALUATED') AS critical_toxicity, CASE WHEN max_tokens <= 2048 THEN 'PASS' ELSE 'FAIL' END AS token_length_fit
    FROM whole w JOIN shape USING (name) JOIN totals USING (name) LEFT JOIN refused USING (name) LEFT JOIN verdicts USING (name))"""

FACT_COLUMNS = [
    "name", "row_count", "column_count", "missing_cells", "duplicate_rows", "rejected", "schema_parse", "token_length_fit",
    "gate_license", "gate_pii", "critical_toxicity", "score", *quality.DIMENSIONS,
]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = gated_documents(spark, sf_dir).groupBy(F.col("source").alias("name"))
    verdict = lambda gate: F.when(F.count_if(F.col("failed_gates").contains(gate)) == 0, "PASS").otherwise("FAIL")
    verdicts = gated.agg(verdict("license").alias("license"), verdict("critical_toxicity").alias("critical_toxicity"))
    return json_rows.json_facts(parsed_lines(spark, sf_dir), "name", "row", language="lang", verdicts=verdicts)


@query(
    "json_facts",
    f"""WITH {_FACTS_SQL} SELECT {', '.join(FACT_COLUMNS)}, array_to_string(fields, ',') AS fields, array_to_string(types, ',') AS types, languages FROM facts""",
)
def json_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select(
        *FACT_COLUMNS,
        F.array_join("fields", ",").alias("fields"),
        F.array_join("field_types", ",").alias("types"),
        F.array_join("languages", ", ").alias("languages"),
    )


_METRIC_LINES = " || ".join(f"'- {d}: ' || {d} || E'\\n'" for d in quality.DIMENSIONS)


@query(
    "json_reports",
    f"""WITH {_FACTS_SQL}
    SELECT name, 'quality_report' AS report, E'# Quality Report\\n\\nOverall score: ' || score || E'/100\\nProfile: production\\n\\n## Hard Gates\\n- license: '
      || gate_license || E'\\n- pii: ' || gate_pii || E'\\n- critical_toxicity: ' || critical_toxicity || E'\\n\\n## Weighted Metrics\\n' || {_METRIC_LINES} AS text FROM facts
    UNION ALL SELECT name, 'benchmark_report', E'# Benchmark Report\\n\\nRecord count: ' || row_count || E'\\nSchema parse: ' || schema_parse
      || E'\\nTraining readiness: PASS\\nToken length fit: ' || token_length_fit || E'\\n' FROM facts
    UNION ALL SELECT name, 'dataset_intelligence_report', E'# Dataset Intelligence Report\\n\\nDataset: ' || name || E'\\nPurpose: uploaded_dataset_analysis\\nDomain: uploaded\\nLanguages: '
      || languages || E'\\nRows: ' || row_count || E'\\nColumns: ' || column_count || E'\\nMissing values: ' || missing_cells || E'\\nDuplicate rows: ' || duplicate_rows
      || E'\\nQuality score: ' || score || E'/100\\nLicense: user_provided\\nCleaned rows: ' || row_count || E'\\nBenchmark readiness: PASS\\nCertification: '
      || CASE WHEN gate_license <> 'PASS' OR gate_pii <> 'PASS' OR critical_toxicity <> 'PASS' THEN 'none' WHEN score >= 95 THEN 'Research Ready'
        WHEN score >= 90 THEN 'Production Ready' ELSE 'none' END || E'\\n' FROM facts""",
)
def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("quality_report", "benchmark_report", "dataset_intelligence_report")
    return json_rows.json_reports(facts(spark, sf_dir)).where(F.col("report").isin(*wanted))
