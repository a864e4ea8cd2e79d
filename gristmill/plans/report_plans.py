"""Texts about the document sources and about search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import process, profile, reports, search
from gristmill.operators.quality import DIMENSIONS
from gristmill.plans import search_plans
from gristmill.plans.quality_plans import DOCUMENT_REPORT_SQL, READINESS_SQL
from gristmill.plans.registry import query, table

FACTS_SQL = f"""
  WITH q AS ({DOCUMENT_REPORT_SQL}), r AS ({READINESS_SQL}),
  s AS (SELECT source, count(*) - count(DISTINCT (doc_id, lang, text)) AS duplicate_rows,
    array_to_string(list_sort(list(DISTINCT lang)), ', ') AS languages, count(DISTINCT lang) AS n_languages FROM documents GROUP BY 1),
  f AS (SELECT q.*, r.record_count, r.schema_parse, r.training_readiness, r.token_length_fit, duplicate_rows, languages,
    CASE WHEN n_languages <= 3 THEN 'low' ELSE 'medium' END AS distribution_risk
    FROM q JOIN r USING (source) JOIN s USING (source))"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process.dataset_facts(profile.normalize(table(spark, sf_dir, "documents")), "source", language="lang")


_SUMMARY_SQL = """source || ' contains ' || row_count || ' records across 4 columns. Key fields include doc_id, lang, n_chars, text. The upload has 0 missing values and '
      || duplicate_rows || ' duplicate rows, making it suitable for quick dataset inspection, search, and packaging.'"""


def _summary() -> Column:
    return reports.dataset_summary(*[F.col(c) for c in ("name", "row_count", "column_count", "fields", "missing_cells", "duplicate_rows")])


@query("dataset_summary", f"{FACTS_SQL} SELECT source AS name, {_SUMMARY_SQL} AS summary FROM f")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("name", _summary().alias("summary"))


_METRIC_LIST = ", ".join(f"{{'v': {d}, 'i': {i}, 'n': '{d}'}}" for i, d in enumerate(DIMENSIONS))


@query(
    "quality_narrative",
    f"""{FACTS_SQL}, m AS (SELECT *, list_sort([{_METRIC_LIST}]) AS l FROM f)
    SELECT source AS name, 'Overall weighted quality is ' || score || ' on a 0-100 scale for the production profile. Strongest dimension: ' || l[7].n
      || ' (' || l[7].v || '). Weakest dimension: ' || l[1].n || ' (' || l[1].v || ').' || CASE WHEN score >= 90 THEN ' The dataset meets the production threshold of 90.'
      ELSE ' The dataset falls short of the production threshold of 90, so search-first remediation or targeted generation is advised.' END AS narrative FROM m""",
)
def quality_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrative = reports.quality_narrative(
        F.col("score"), F.col("threshold"), F.col("profile"), {d: F.col(d) for d in DIMENSIONS}
    )
    return facts(spark, sf_dir).select("name", narrative.alias("narrative"))


@query(
    "dataset_card",
    f"""{FACTS_SQL} SELECT source AS name, '# Dataset Card' || E'\\n\\nName: ' || source || E'\\nDomain: uploaded\\nLanguages: ' || languages || E'\\nLicense: user_provided\\nRows: '
      || row_count || E'\\nColumns: 4\\nMissing values: 0\\nDuplicate rows: ' || duplicate_rows || E'\\nQuality score: ' || score || E'/100\\nBenchmark readiness: '
      || training_readiness || E'\\nSource checksum: Unavailable\\nSources: ' || source || E'\\nGenerated by: Gristmill\\n' AS card,
      '# ' || source || E'\\n\\n## Summary\\n' || {_SUMMARY_SQL} || E'\\n\\n## Composition\\n- Records: ' || row_count || E'\\n- Columns: 4\\n- Tags: '
      || source || E', uploaded\\n\\n## Schema\\n- `doc_id`: integer\\n- `lang`: string\\n- `n_chars`: integer\\n- `text`: string\\n\\n## Licensing\\n- Declared license: user_provided\\n'
      || E'- Verify redistribution terms before commercial use.\\n\\n## Quality\\n- Weighted quality score: ' || score
      || E'\\n\\n## Intended Use\\nDiscovery, exploratory analysis, prototyping, and packaging.\\n\\n## Limitations\\nMetrics are computed by deterministic heuristics unless live LLM mode is enabled; '
      || 'validate domain coverage before production training.' AS catalog_card,
      '{{"name":"' || source || '","domain":"uploaded","languages":["' || replace(languages, ', ', '","') || '"],"license":"user_provided","rows":' || row_count
      || ',"columns":4,"missing_values":0,"duplicate_rows":' || duplicate_rows || ',"source_checksum":null,"schema":{{"doc_id":"integer","lang":"string","n_chars":"integer","text":"string"}},"quality_score":'
      || score || ',"benchmark_readiness":"' || training_readiness || '","sources":["' || source || '"]}}' AS card_json FROM f""",
)
def dataset_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).withColumn("summary", _summary()).withColumn("tags", F.array("name", F.lit("uploaded")))
    card = reports.catalog_card(
        *[F.col(c) for c in ("name", "summary", "row_count", "column_count", "tags", "fields", "field_types", "license", "score")]
    )
    return rows.select(
        "name", reports.package_card().alias("card"), card.alias("catalog_card"), reports.package_card_json().alias("card_json")
    )


_METRIC_LINES = " || ".join(f"'- {d}: ' || {d} || E'\\n'" for d in DIMENSIONS)


@query(
    "report_texts",
    f"""{FACTS_SQL}
    SELECT source AS name, 'quality_report' AS report, E'# Quality Report\\n\\nOverall score: ' || score || E'/100\\nProfile: production\\n\\n## Hard Gates\\n- license: USER_PROVIDED\\n- pii: NOT_EVALUATED\\n- critical_toxicity: NOT_EVALUATED\\n\\n## Weighted Metrics\\n' || {_METRIC_LINES} AS text FROM f
    UNION ALL SELECT source, 'bias_report', E'# Bias Report\\n\\nRecords sampled: ' || record_count || E'\\nCritical toxicity: NOT_EVALUATED\\nDistribution risk: ' || distribution_risk || E'\\nLanguages: ' || languages || E'\\n' FROM f
    UNION ALL SELECT source, 'benchmark_report', E'# Benchmark Report\\n\\nRecord count: ' || record_count || E'\\nSchema parse: ' || schema_parse || E'\\nTraining readiness: ' || training_readiness || E'\\nToken length fit: ' || token_length_fit || E'\\n' FROM f
    UNION ALL SELECT source, 'recommendation_report', E'# Recommendation Report\\n\\n' || CASE WHEN requires_generation THEN 'Review generated samples before production use.' ELSE 'No generated samples; ready for export.' END || E'\\n' FROM f
    UNION ALL SELECT source, 'dataset_intelligence_report', E'# Dataset Intelligence Report\\n\\nDataset: ' || source || E'\\nPurpose: uploaded_dataset_analysis\\nDomain: uploaded\\nLanguages: ' || languages || E'\\nRows: ' || row_count || E'\\nColumns: 4\\nMissing values: 0\\nDuplicate rows: ' || duplicate_rows || E'\\nQuality score: ' || score || E'/100\\nLicense: user_provided\\nCleaned rows: ' || row_count || E'\\nBenchmark readiness: ' || training_readiness || E'\\nCertification: none\\n' FROM f
    UNION ALL SELECT source, 'explainability_report', E'# Explainability Report\\n\\nPlanner decision: Planner rationale unavailable.\\nSearch-first policy: existing datasets were evaluated before generation.\\nSynthetic samples added: 0\\nFinal quality score: ' || score || E'/100\\n' FROM f
    UNION ALL SELECT source, 'dataset_card', E'# Dataset Card\\n\\nName: ' || source || E'\\nDomain: uploaded\\nLanguages: ' || languages || E'\\nLicense: user_provided\\nRows: ' || row_count || E'\\nColumns: 4\\nMissing values: 0\\nDuplicate rows: ' || duplicate_rows || E'\\nQuality score: ' || score || E'/100\\nBenchmark readiness: ' || training_readiness || E'\\nSource checksum: Unavailable\\nSources: ' || source || E'\\nGenerated by: Gristmill\\n' FROM f""",
)
def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = {k: F.lit(v) for k, v in process.DEFAULT_GATES.items()}
    return reports.all_reports(facts(spark, sf_dir), gates)


@query(
    "gap_analysis",
    """WITH s AS (SELECT source, count(*) AS n, list(DISTINCT lang) AS have FROM documents GROUP BY 1),
    g AS (SELECT source, n, list_sort(list_filter(['EN', 'hi', 'Fr'], lambda l: NOT list_contains(have, lower(l)))) AS lacking FROM s)
    SELECT source AS name, CASE WHEN source LIKE '%1' THEN 'No material gaps detected for ''news''. ' || n || ' rows with fields doc_id, lang, n_chars, text satisfy the stated requirement; proceed to curation and skip synthetic generation.'
      ELSE 'Coverage gaps detected -- ' || concat_ws('; ', CASE WHEN n < 100000 THEN 'volume: ' || n || ' of 100000 target rows (' || (100000 - n) || ' short)' END,
        'languages: missing ' || array_to_string(list_sort(list_transform(lacking, lambda l: lower(l))), ', '), 'format: no instruction/response columns for instruction tuning')
      || '. Recommended order: search additional sources for the shortfall first, then reserve synthetic generation for residual gaps only.' END AS gaps FROM g""",
)
def gap_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    undemanding = F.col("name").endswith("1")
    none = F.array().cast("array<string>")
    text = reports.gap_analysis(
        F.col("row_count"),
        F.col("fields"),
        F.col("languages"),
        F.when(undemanding, none).otherwise(F.array(F.lit("EN"), F.lit("hi"), F.lit("Fr"))),
        F.when(undemanding, 0).otherwise(100000),
        F.when(undemanding, "").otherwise("instruction-tuned"),
        F.lit("news"),
    )
    return facts(spark, sf_dir).select("name", text.alias("gaps"))


@query(
    "recommendation",
    search_plans.SEARCH_SQL
    + """ SELECT r.query_id, r.dataset_id, title || ' is recommended for ''' || coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: length(t) > 1))), ' '), ''), 'catalog search')
      || ''' because it matches ' || CASE WHEN matched_terms = '' THEN 'metadata relevance' ELSE matched_terms END || ', contains ' || p_size || ' rows, and has a quality score of '
      || p_size * 2 || '.' AS recommendation FROM ranked r JOIN part ON p_partkey = r.dataset_id JOIN q ON q.query_id = r.query_id JOIN c ON c.dataset_id = r.dataset_id WHERE rank <= 3""",
)
def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = search_plans.catalog_queries(spark, sf_dir)
    records = search_plans.catalog(spark, sf_dir)
    found = search.catalog_search(asked, records, 3)
    return (
        found.join(asked, "query_id")
        .join(records.select("dataset_id", "title", "quality_score"), "dataset_id")
        .select(
            "query_id",
            "dataset_id",
            reports.recommendation(
                F.col("title"), F.col("query"), F.col("matched_terms"), (F.col("quality_score") / 2).cast("int"), F.col("quality_score")
            ).alias("recommendation"),
        )
    )
