"""Conversations as logged runs (turn = position), and upload traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import quality, requests, traces
from gristmill.plans.quality_plans import DOCUMENT_REPORT_SQL, document_metrics
from gristmill.plans.registry import query, table

_NAMES = [*traces.STAGES, "mystery"]
_NAME_LIST = ", ".join(f"'{s}'" for s in _NAMES)
_LOG_SQL = f"""
  SELECT conv_id, turn, [{_NAME_LIST}][1 + (conv_id % 9 + turn * (1 + conv_id % 4)) % {len(_NAMES)}] AS stage,
    CASE WHEN (conv_id + turn) % 6 = 0 THEN 'FAIL' WHEN (conv_id + turn) % 11 = 0 THEN 'ERROR' ELSE 'PASS' END AS status,
    CAST(length(text) % 101 AS INT) AS score FROM conversations"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("conv_id") % 9 + F.col("turn") * (1 + F.col("conv_id") % 4)) % len(_NAMES)
    both = F.col("conv_id") + F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.get(F.array(*[F.lit(n) for n in _NAMES]), at.cast("int")).alias("stage"),
        F.when(both % 6 == 0, "FAIL").when(both % 11 == 0, "ERROR").otherwise("PASS").alias("status"),
        (F.length("text") % 101).alias("score"),
    )


_ORDER_SQL = ", ".join(f"('{a}', '{b}')" for a, b in traces.ORDER_RULES)
_COMPANION_SQL = ", ".join(f"('{s}', '{c}')" for s, cs in traces.COMPANIONS.items() for c in cs)


@query(
    "trace_conformance",
    f"""WITH l AS ({_LOG_SQL}), s AS (SELECT conv_id, stage, count(*) AS n, max(turn) AS last FROM l GROUP BY 1, 2),
    r AS (SELECT DISTINCT conv_id FROM l), rule(a, b) AS (VALUES {_ORDER_SQL}), comp(a, b) AS (VALUES {_COMPANION_SQL}),
    must(a) AS (VALUES {', '.join(f"('{m}')" for m in traces.MANDATORY_STAGES)})
    SELECT conv_id, 'duplicate' AS violation, stage, NULL AS other, n - 1 AS times FROM s WHERE n > 1 AND stage <> 'mystery'
    UNION ALL SELECT conv_id, 'unknown', stage, NULL, n FROM s WHERE stage = 'mystery'
    UNION ALL SELECT conv_id, 'missing', a, NULL, 1 FROM r, must WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = r.conv_id AND s.stage = a)
    UNION ALL SELECT x.conv_id, 'order', a, b, 1 FROM rule JOIN s x ON x.stage = a JOIN s y ON y.stage = b AND y.conv_id = x.conv_id AND x.last > y.last
    UNION ALL SELECT x.conv_id, 'companion', a, b, 1 FROM comp JOIN s x ON x.stage = a
      WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.conv_id = x.conv_id AND y.stage = b)""",
)
def trace_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.conformance(_log(spark, sf_dir), "conv_id", "stage", "turn")


@query(
    "trace_progress",
    f"""WITH l AS ({_LOG_SQL}) SELECT conv_id, count(*) AS completed, count(*) FILTER (WHERE status IN ('FAIL', 'ERROR')) AS failures,
      arg_max(stage, turn) AS last_stage, arg_max(stage, turn) FILTER (WHERE status IN ('FAIL', 'ERROR')) AS last_failure,
      count(*) FILTER (WHERE stage = 'quality_evaluator') AS quality_checks, arg_min(score, turn) FILTER (WHERE stage = 'quality_evaluator') AS first_score,
      arg_max(score, turn) FILTER (WHERE stage = 'quality_evaluator') AS last_score FROM l GROUP BY 1""",
)
def trace_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.progress(_log(spark, sf_dir), "conv_id", "stage", "turn", "status", "score")


@query(
    "message_trace",
    f"""WITH l AS ({_LOG_SQL}) SELECT conv_id AS run_id, turn AS position, stage AS name, 'registry_agent' AS engine, status,
      '{{"confidence":0.5,"next_action":"CONTINUE","result":"' || score || '"}}' AS output FROM l""",
)
def message_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _log(spark, sf_dir).select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("position"), F.col("stage").alias("agent"), "status",
        F.lit(0.5).alias("confidence"), F.lit("CONTINUE").alias("next_action"), F.col("score").cast("string").alias("result"),
    )
    return traces.message_trace(messages)


@query(
    "upload_trace",
    f"""WITH r AS ({DOCUMENT_REPORT_SQL}), s(position, name, engine) AS (VALUES (0, 'Requirement Analyzer', 'deterministic'), (1, 'Planner', 'deterministic'),
      (2, 'Discovery / Ingestion', 'dataset_processing_service'), (3, 'Quality Evaluator', 'deterministic_quality_metrics'), (4, 'AI Skills', 'local'),
      (5, 'Packaging', 'packaging_services'), (6, 'Explainability', 'local'))
    SELECT source AS run_id, position, name, engine, 'completed' AS status, CASE position
      WHEN 0 THEN '{{"request":"Analyze uploaded dataset."}}' WHEN 1 THEN '{{"workflow":"uploaded_dataset_package","active_stages":7}}'
      WHEN 2 THEN '{{"filename":"' || source || '.jsonl","rows":' || row_count || ',"columns":5}}' WHEN 3 THEN '{{"score":' || score || '}}'
      WHEN 4 THEN '{{"summary_provider":"local"}}' WHEN 5 THEN '{{"manifest":"' || source || '/manifest"}}'
      ELSE '{{"dataset_card":true,"quality_narrative":false}}' END AS output FROM r, s""",
)
def upload_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(document_metrics(spark, sf_dir))
    runs = report.select(
        F.col("source").alias("run_id"), F.lit(None).cast("string").alias("request"), F.concat("source", F.lit(".jsonl")).alias("filename"),
        "row_count", F.lit(5).alias("column_count"), "score", F.lit(None).cast("string").alias("provider"),
        F.concat("source", F.lit("/manifest")).alias("manifest"), F.lit("card").alias("dataset_card"), F.lit("").alias("quality_narrative"),
    )
    return traces.upload_trace(runs)


_ASK_SQL = """
  SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'Find datasets for Healthcare in Hindi and English' WHEN 1 THEN 'clean dataset with rare legal cases'
    WHEN 2 THEN '' WHEN 3 THEN 'Generate SYNTHETIC finance chats' WHEN 4 THEN 'German education code' WHEN 5 THEN 'remove duplicates'
    ELSE o_orderpriority END AS ask, CASE WHEN o_orderkey % 3 = 0 THEN 'sports' END AS domain, CASE WHEN o_orderkey % 2 = 0 THEN 'm' END AS model FROM orders"""


@query(
    "request_triage",
    f"""WITH a AS ({_ASK_SQL}), t AS (SELECT *, lower(trim(ask)) AS t FROM a), f AS (SELECT *,
      coalesce(CASE WHEN contains(t, 'healthcare') THEN 'healthcare' WHEN contains(t, 'legal') THEN 'legal' WHEN contains(t, 'finance') THEN 'finance'
        WHEN contains(t, 'education') THEN 'education' WHEN contains(t, 'code') THEN 'code' END, domain) AS d,
      nullif(concat_ws(',', CASE WHEN contains(t, 'english') THEN 'english' END, CASE WHEN contains(t, 'hindi') THEN 'hindi' END,
        CASE WHEN contains(t, 'spanish') THEN 'spanish' END, CASE WHEN contains(t, 'french') THEN 'french' END,
        CASE WHEN contains(t, 'german') THEN 'german' END), '') AS l FROM t)
    SELECT o_orderkey, coalesce(d, 'general') AS found_domain, coalesce(l, 'english') AS found_languages,
      regexp_matches(t, 'synthetic|generate|gap|rare|edge case|no existing') AS requires_generation,
      regexp_matches(t, 'search only|find datasets|discover datasets|candidate datasets') AS search_only,
      regexp_matches(t, 'clean only|cleaning only|clean dataset|remove duplicates') AS cleaning_only,
      concat_ws(' ', CASE WHEN d IS NULL THEN '{requests.QUESTIONS["domain"]}' END, CASE WHEN l IS NULL THEN '{requests.QUESTIONS["languages"]}' END,
        CASE WHEN model IS NULL THEN '{requests.QUESTIONS["target_model"]}' END) AS questions FROM f""",
)
def request_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    ask = (
        F.when(key % 7 == 0, "Find datasets for Healthcare in Hindi and English").when(key % 7 == 1, "clean dataset with rare legal cases")
        .when(key % 7 == 2, "").when(key % 7 == 3, "Generate SYNTHETIC finance chats").when(key % 7 == 4, "German education code")
        .when(key % 7 == 5, "remove duplicates").otherwise(F.col("o_orderpriority"))
    )
    asked = table(spark, sf_dir, "orders").select(
        "o_orderkey", ask.alias("ask"), F.when(key % 3 == 0, "sports").alias("domain"), F.when(key % 2 == 0, "m").alias("model")
    )
    return requests.triage(asked, "ask", domain="domain", target_model="model").drop("ask", "domain", "model")


_FIELD_SQL = """
  SELECT p_partkey // 3 AS dataset, CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'ring_ID' WHEN 'bolt' THEN 'user_prompt' WHEN 'gear' THEN 'Answer'
    WHEN 'widget' THEN 'date_' || p_partkey % 3 WHEN 'gizmo' THEN 'lang' WHEN 'nut' THEN 'category' ELSE p_type END AS field FROM part"""
_ROLE_SQL = """CASE WHEN n IN ('id', 'uuid', 'index') OR n LIKE '%\\_id' ESCAPE '\\' THEN 'identifier' WHEN regexp_matches(n, 'instruction|prompt|question') THEN 'instruction'
  WHEN regexp_matches(n, 'response|answer|completion|output') THEN 'response' WHEN n IN ('label', 'target', 'class', 'category', 'sentiment') OR n LIKE '%\\_label' ESCAPE '\\'
  THEN 'label/target' WHEN regexp_matches(n, 'date|time|year') THEN 'temporal' WHEN contains(n, 'lang') THEN 'language' ELSE 'text' END"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.split("p_name", " ")[1]
    field = (
        F.when(word == "ring", "ring_ID").when(word == "bolt", "user_prompt").when(word == "gear", "Answer")
        .when(word == "widget", F.concat(F.lit("date_"), (F.col("p_partkey") % 3).cast("string"))).when(word == "gizmo", "lang")
        .when(word == "nut", "category").otherwise(F.col("p_type"))
    )
    return table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 3).alias("dataset"), field.alias("field"))


@query("field_roles", f"SELECT dataset, field, {_ROLE_SQL} AS role FROM (SELECT *, lower(field) AS n FROM ({_FIELD_SQL}))")
def field_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).withColumn("role", requests.field_role(F.col("field")))


@query(
    "training_task",
    f"""WITH r AS (SELECT DISTINCT dataset, {_ROLE_SQL} AS role FROM (SELECT *, lower(field) AS n FROM ({_FIELD_SQL}))),
    s AS (SELECT dataset, list(role) AS l, string_agg(role, ', ' ORDER BY role) AS roles FROM r GROUP BY 1)
    SELECT dataset, roles, CASE WHEN list_contains(l, 'instruction') AND list_contains(l, 'response') THEN 'instruction tuning (supervised fine-tuning)'
      WHEN list_contains(l, 'label/target') THEN 'supervised classification or regression'
      WHEN list_contains(l, 'text') OR list_contains(l, 'instruction') THEN 'language modeling, embeddings, or retrieval' ELSE 'exploratory analysis' END AS task FROM s""",
)
def training_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.training_task(_fields(spark, sf_dir), "dataset", "field")
