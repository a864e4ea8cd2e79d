"""The whole chain from candidate collections to an exported corpus, stage by stage."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import assembly, quality
from gristmill.operators.stages import StageRun
from gristmill.plans.gate_plans import _MASK_SQL, LICENSE_GUESS_SQL, license_guess
from gristmill.plans.quality_plans import _dims_sql, _report_sql, clean_sql
from gristmill.plans.registry import query, table
from gristmill.session import ensure_checkpoint_dir

WANTED = [("de", 200), ("en", 400), ("fr", 100), ("it", 10)]
PERMISSIVE = "'apache-2.0', 'mit', 'bsd-2-clause', 'bsd-3-clause', 'cc-by-4.0'"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source with the license its first document that names one names; the turns are a candidate of their own."""
    guess = F.nullif(F.lower(license_guess(F.col("text"))), F.lit(""))
    sources = (
        table(spark, sf_dir, "documents")
        .select("source", "doc_id", guess.alias("license"))
        .groupBy(F.col("source").alias("origin"))
        .agg(F.min_by("license", F.when(F.col("license").isNotNull(), F.col("doc_id"))).alias("license_name"))
    )
    turns = table(spark, sf_dir, "conversations").select(F.lit("turns").alias("origin"), F.lit("MIT").alias("license_name"))
    return sources.unionByName(turns.distinct())


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("row_id"),
        F.col("source").alias("origin"), F.col("lang").alias("language"), "text",
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.lpad((F.col("conv_id") * 1000 + F.col("turn")).cast("string"), 12, "0")).alias("row_id"),
        F.lit("turns").alias("origin"), F.lit(None).cast("string").alias("language"), "text",
    )
    return documents.unionByName(turns)


def assembled(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], str]:
    """Frames of all stages and the folder of the exported corpus."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/assembly-{uuid4().hex}"
    run = StageRun(spark, f"{folder}/stages")
    sources = {"candidates": candidates(spark, sf_dir), "rows": rows(spark, sf_dir)}
    return run.run(sources, assembly.stages(f"{folder}/corpus", WANTED)), f"{folder}/corpus"


_ASSEMBLY_SQL = f"""
  l AS (SELECT source, doc_id, nullif(lower({LICENSE_GUESS_SQL}), '') AS license FROM documents),
  cand AS (SELECT source AS origin, coalesce(arg_min(license, doc_id) FILTER (WHERE license IS NOT NULL), 'unknown') AS license FROM l GROUP BY source
    UNION ALL SELECT DISTINCT 'turns', 'mit' FROM conversations),
  decided AS (SELECT *, license IN ({PERMISSIVE}) AS compatible,
    CASE WHEN license IN ({PERMISSIVE}) THEN 'APPROVED' WHEN license = 'unknown' THEN 'UNKNOWN' ELSE 'REJECTED' END AS status FROM cand),
  raw AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS row_id, source AS origin, lang AS language, text FROM documents
    UNION ALL SELECT 'c' || lpad(CAST(conv_id * 1000 + turn AS VARCHAR), 12, '0'), 'turns', NULL, text FROM conversations),
  merged AS (SELECT raw.* REPLACE (nullif(trim(text, E' \\t\\n\\r'), '') AS text), license FROM raw JOIN decided USING (origin) WHERE compatible),
  masked AS (SELECT * REPLACE ({_MASK_SQL} AS text) FROM merged WHERE text IS NOT NULL),
  clean AS (SELECT arg_min(row_id, row_id) AS row_id, arg_min(origin, row_id) AS origin, arg_min(language, row_id) FILTER (WHERE true) AS first_language,
    text, list_sort(list(DISTINCT origin)) AS lineage, count(*) AS copies, arg_min(license, row_id) AS license FROM masked GROUP BY text),
  cleaned AS (SELECT c.row_id, c.origin, m.language, c.text, c.lineage, c.copies, c.license FROM clean c JOIN masked m USING (row_id))"""


@query(
    "assembled_corpus",
    f"WITH {_ASSEMBLY_SQL} SELECT row_id, origin, language, sha256(text) AS text_sha, array_to_string(lineage, ',') AS lineage, license FROM cleaned",
)
def assembled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported corpus, read back."""
    _, folder = assembled(spark, sf_dir)
    return assembly.read_export(spark, folder).select(
        "row_id", "origin", "language", F.sha2("text", 256).alias("text_sha"), F.array_join("lineage", ",").alias("lineage"), "license"
    )


_SCORED_ROWS = f"""
  SELECT origin, 1 AS complete, {clean_sql('language')} + {clean_sql('text')} AS clean, text, len(regexp_extract_all(text, '\\S+')) AS n_words FROM cleaned"""
_SCORE_SQL = _report_sql(_dims_sql(_SCORED_ROWS, "origin", 2, 0.70), "origin", "production", 90)
_WANTED_SQL = ", ".join(f"('{language}', {needed})" for language, needed in WANTED)


def _told(stage: str, subject: str, measures: tuple[str, ...], rows_sql: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{stage}' AS stage, {subject} AS subject, '{m}' AS measure, CAST({m} AS VARCHAR) AS value FROM {rows_sql}" for m in measures
    )


@query(
    "assembly_report",
    f"""WITH {_ASSEMBLY_SQL}, have AS (SELECT language, count(*) AS row_count FROM cleaned GROUP BY language),
    cover AS (SELECT language, coalesce(row_count, 0) AS row_count, round_even(least(1.0::DOUBLE, coalesce(row_count, 0) / needed), 4) AS coverage,
      greatest(0, needed - coalesce(row_count, 0)) AS short_by FROM (VALUES {_WANTED_SQL}) w(language, needed) LEFT JOIN have USING (language)),
    scores AS ({_SCORE_SQL}),
    n AS (SELECT origin, count(*) AS record_count FROM cleaned GROUP BY origin),
    valid AS (SELECT origin, coalesce(record_count, 0) AS record_count, compatible::INT AS candidate_count,
      coalesce(record_count, 0) > 0 OR compatible AS ready, CASE WHEN record_count > 0 THEN 'dataset' ELSE 'metadata' END AS mode
      FROM decided LEFT JOIN n USING (origin))
    {_told('license', 'origin', ('license', 'status'), 'decided')}
    UNION ALL {_told('coverage', 'language', ('row_count', 'coverage', 'short_by'), 'cover')}
    UNION ALL {_told('score', 'origin', ('row_count', 'score', 'status', *quality.DIMENSIONS), 'scores')}
    UNION ALL {_told('validate', 'origin', ('ready', 'record_count', 'candidate_count', 'mode'), 'valid')}""",
)
def assembly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, _ = assembled(spark, sf_dir)
    return assembly.summary(frames)


@query(
    "export_fallback",
    """WITH c AS (SELECT source AS origin, count(*) AS documents FROM documents GROUP BY source)
    SELECT origin, documents FROM c""",
)
def export_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No row passes, so the export holds the candidates in their place."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fallback-{uuid4().hex}"
    documents = table(spark, sf_dir, "documents")
    approved = documents.groupBy(F.col("source").alias("origin")).agg(F.count(F.lit(1)).alias("documents"))
    kept = documents.where(F.length(F.btrim("text")) < 0).select("doc_id", "text")
    assembly.export_rows(kept, approved, folder)
    return spark.read.schema("origin STRING, documents BIGINT").json(folder)
