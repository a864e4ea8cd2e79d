"""Quality scoring over documents, conversations and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import process, quality, requests
from gristmill.plans.registry import query, table


def _dims_sql(rows: str, key: str, n_values: int, base: float, structured: bool = True) -> str:
    """Dimensions from per-row columns: complete, clean, text, n_words."""
    readable = "sum(CASE WHEN n_words BETWEEN 2 AND 400 THEN 1 ELSE 0 END) / count(*)"
    return f"""
      SELECT {key}, count(*) AS row_count,
        round_even(sum(complete) / count(*), 4) AS completeness,
        1.0::DOUBLE AS consistency,
        round_even(count(DISTINCT text) / count(*), 4) AS diversity,
        round_even(count(DISTINCT text) / count(*), 4) AS duplicate_ratio,
        round_even(sum(clean) / (count(*) * {n_values}), 4) AS formatting,
        {'round_even(' + readable + ', 4)' if structured else '0.0::DOUBLE'} AS readability,
        round_even({base} * (1 - sum(CASE WHEN ceil(n_words / 0.75) > 2048 THEN 1 ELSE 0 END) / count(*)), 4)
          AS model_compatibility,
        round_even(sum(complete) / count(*) * 20 + 20
          + count(DISTINCT text) / count(*) * 15 + count(DISTINCT text) / count(*) * 15
          + sum(clean) / (count(*) * {n_values}) * 10
          + {readable if structured else '0.0'} * 10
          + {base} * (1 - sum(CASE WHEN ceil(n_words / 0.75) > 2048 THEN 1 ELSE 0 END) / count(*)) * 10, 2)
          AS overall
      FROM ({rows}) GROUP BY {key}"""


def _report_sql(dims: str, key: str, profile: str, threshold: int) -> str:
    names = list(quality.DIMENSIONS)
    scaled = ", ".join(f"CAST(round_even({d} * 100, 0) AS INT) AS {d}" for d in names)
    score = " + ".join(f"{d} * {w}" for d, w in quality.WEIGHTS.items())
    return f"""
      WITH dims AS ({dims}), scaled AS (SELECT {key}, row_count, overall, {scaled} FROM dims),
      scored AS (SELECT *, CAST(round_even(({score}) / 100, 0) AS INT) AS score FROM scaled)
      SELECT *, '{profile}' AS profile, {threshold} AS threshold, score < {threshold} AS requires_generation,
        CASE WHEN score >= 90 THEN 'PASS' ELSE 'PARTIAL' END AS status FROM scored"""


def clean_sql(column: str) -> str:
    return (
        f"CASE WHEN {column} IS NOT NULL AND {column} <> '' AND NOT regexp_matches({column}, '^\\s|\\s$') "
        f"AND NOT regexp_matches({column}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') THEN 1 ELSE 0 END"
    )


_DOCUMENT_ROWS = f"""
  SELECT source, CASE WHEN trim(text, E' \\t\\n\\r') <> '' THEN 1 ELSE 0 END AS complete,
    {clean_sql('CAST(doc_id AS VARCHAR)')} + {clean_sql('text')} + {clean_sql('lang')}
      + {clean_sql('CAST(n_chars AS VARCHAR)')} AS clean,
    trim(text, E' \\t\\n\\r') AS text, len(regexp_extract_all(text, '\\S+')) AS n_words
  FROM documents"""

DOCUMENT_DIMS_SQL = _dims_sql(_DOCUMENT_ROWS, "source", 4, 0.70)
DOCUMENT_REPORT_SQL = _report_sql(DOCUMENT_DIMS_SQL, "source", "production", 90)


def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_metrics(table(spark, sf_dir, "documents"), "source")


@query("quality_by_source", DOCUMENT_REPORT_SQL)
def quality_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(document_metrics(spark, sf_dir), "production")


@query("quality_dimensions", DOCUMENT_DIMS_SQL)
def quality_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_metrics(spark, sf_dir)


@query(
    "quality_profiles",
    f"""WITH report AS ({DOCUMENT_REPORT_SQL}),
    profiles(profile_name, minimum) AS
      (VALUES ('fast', 70), ('balanced', 80), ('production', 90), ('research', 95), ('enterprise', 98))
    SELECT profile_name, minimum, count(*) FILTER (WHERE overall >= minimum) AS sources_meeting,
      count(*) FILTER (WHERE score < minimum) AS sources_below
    FROM report, profiles GROUP BY ALL""",
)
def quality_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(document_metrics(spark, sf_dir))
    levels = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("profile_name"), F.lit(t).alias("minimum"))
                for p, t in quality.PROFILE_THRESHOLDS.items()
            ]
        )
    )
    return (
        report.select("overall", "score", levels.alias("level"))
        .groupBy("level.profile_name", "level.minimum")
        .agg(
            F.count_if(F.col("overall") >= F.col("level.minimum")).alias("sources_meeting"),
            F.count_if(F.col("score") < F.col("level.minimum")).alias("sources_below"),
        )
    )


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn right after it, as prompt and completion.

    Joined on (conversation, turn) rather than windowed per conversation, so that one very
    long conversation spreads over all tasks.
    """
    turns = table(spark, sf_dir, "conversations")
    users = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    replies = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion")
    )
    return users.join(replies, ["conv_id", "turn"], "left")


_PAIR_ROWS = f"""
  SELECT CASE WHEN turn = 0 THEN 'opening' ELSE 'later' END AS phase,
    CASE WHEN trim(prompt) <> '' AND trim(coalesce(completion, '')) <> '' THEN 1 ELSE 0 END AS complete,
    {clean_sql('prompt')} + {clean_sql('completion')} AS clean,
    trim(concat_ws(' ', prompt, completion), E' \\t\\n\\r') AS text,
    len(regexp_extract_all(concat_ws(' ', prompt, completion), '\\S+')) AS n_words
  FROM (SELECT u.turn, u.text AS prompt, a.text AS completion FROM conversations u
        LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
        WHERE u.role = 'user')"""


@query("quality_pairs_by_phase", _report_sql(_dims_sql(_PAIR_ROWS, "phase", 2, 0.85), "phase", "balanced", 80))
def quality_pairs_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = conversation_pairs(spark, sf_dir).select(
        F.when(F.col("turn") == 0, "opening").otherwise("later").alias("phase"), "prompt", "completion"
    )
    return quality.quality_report(quality.quality_metrics(pairs, "phase"), "balanced")


_CUSTOMER_ROWS = f"""
  SELECT c_mktsegment, 0 AS complete,
    {' + '.join(clean_sql(f'CAST({c} AS VARCHAR)') for c in ('c_custkey', 'c_name', 'c_nationkey', 'c_acctbal'))}
      AS clean,
    concat_ws('|', c_acctbal, c_custkey, c_name, c_nationkey) AS text, 1 AS n_words
  FROM customer"""


@query("quality_unstructured", _dims_sql(_CUSTOMER_ROWS, "c_mktsegment", 4, 0.40, structured=False))
def quality_unstructured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_metrics(table(spark, sf_dir, "customer"), "c_mktsegment")


@query(
    "quality_ragged_rows",
    """WITH r AS (SELECT event_type, event_id, CASE WHEN value < 1 THEN 'k' ELSE 'k,v' END AS keys FROM events),
    f AS (SELECT event_type, arg_min(keys, event_id) AS first_keys FROM r GROUP BY 1)
    SELECT event_type, count(*) AS row_count,
      round_even(sum(CASE WHEN keys = first_keys THEN 1 ELSE 0 END) / count(*), 4) AS consistency
    FROM r JOIN f USING (event_type) GROUP BY 1""",
)
def quality_ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistency of rows that carry their own field sets (values under 1 lack the second field)."""
    events = table(spark, sf_dir, "events").select(
        "event_type",
        "event_id",
        F.when(F.col("value") < 1, "k").otherwise("k,v").alias("keys"),
        F.col("props").alias("text"),
    )
    return quality.quality_metrics(events, "event_type", key_set="keys", row_id="event_id").select(
        "event_type", "row_count", "consistency"
    )


@query(
    "bias_languages",
    """SELECT source, count(DISTINCT lang) AS n_languages,
      array_to_string(list_sort(list(DISTINCT coalesce(lang, 'unknown'))), ', ') AS languages,
      CASE WHEN count(DISTINCT lang) <= 3 THEN 'low' ELSE 'medium' END AS distribution_risk
    FROM documents GROUP BY source""",
)
def bias_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.language_bias(table(spark, sf_dir, "documents"), "source", "lang")


@query(
    "language_distribution",
    """SELECT lang AS language, count(*) AS row_count, count(toxic) AS labelled,
      round_even(count(*) / (SELECT count(*) FROM documents), 4) AS share,
      round_even(sum(toxic) / count(toxic), 4) AS toxic_rate
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
)
def language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.language_distribution(
        table(spark, sf_dir, "documents"), "lang", "doc_id", table(spark, sf_dir, "labels"), "toxic"
    )


@query(
    "language_coverage",
    """WITH wanted(language, needed) AS (VALUES ('en', 200), ('fr', 400), ('hi', 50)),
    have AS (SELECT lang AS language, count(*) AS n FROM documents GROUP BY 1)
    SELECT language, CAST(needed AS BIGINT) AS needed, coalesce(n, 0) AS row_count,
      round_even(least(1.0, coalesce(n, 0) / needed), 4) AS coverage,
      CAST(greatest(0, needed - coalesce(n, 0)) AS BIGINT) AS short_by
    FROM wanted LEFT JOIN have USING (language)""",
)
def language_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("en", 200), ("fr", 400), ("hi", 50)], "language string, needed long")
    return quality.language_coverage(table(spark, sf_dir, "documents"), "lang", wanted)


READINESS_SQL = """
  SELECT source, count(*) AS record_count, 'PASS' AS schema_parse, 'PASS' AS training_readiness,
    CAST(max(ceil(len(regexp_extract_all(text, '\\S+')) / 0.75)) AS BIGINT) AS max_tokens,
    CASE WHEN max(ceil(len(regexp_extract_all(text, '\\S+')) / 0.75)) <= 2048 THEN 'PASS' ELSE 'FAIL' END
      AS token_length_fit
  FROM documents GROUP BY source"""


@query("readiness_benchmark", READINESS_SQL)
def readiness_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.readiness(table(spark, sf_dir, "documents"), "source", "text")


@query(
    "validation_report",
    """WITH d AS (SELECT DISTINCT source FROM documents),
    r AS (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1),
    c AS (SELECT source, count(*) AS n FROM documents
          WHERE regexp_matches(text, 'MIT License|Apache License, Version 2') GROUP BY 1)
    SELECT source, coalesce(r.n, 0) > 0 OR coalesce(c.n, 0) > 0 AS ready, coalesce(r.n, 0) AS record_count,
      coalesce(c.n, 0) AS candidate_count,
      CASE WHEN coalesce(r.n, 0) > 0 THEN 'dataset' ELSE 'metadata' END AS mode
    FROM d LEFT JOIN r USING (source) LEFT JOIN c USING (source)""",
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.validation(
        documents.select("source").distinct(),
        "source",
        documents.select("doc_id", "source").join(good, "doc_id", "left_semi"),
        documents.where(F.col("text").rlike("MIT License|Apache License, Version 2")),
    )


@query(
    "critic_verdict",
    """WITH p AS (SELECT u.conv_id, u.text AS prompt, a.text AS completion FROM conversations u
      LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
      WHERE u.role = 'user'),
    e AS (SELECT conv_id, CAST(sum(CASE WHEN coalesce(prompt, '') = '' THEN 1 ELSE 0 END
      + CASE WHEN coalesce(completion, '') = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty_fields FROM p GROUP BY 1)
    SELECT conv_id, empty_fields, CASE WHEN empty_fields = 0 THEN 'accept' ELSE 'revise' END AS verdict,
      CASE WHEN empty_fields = 0 THEN 90 ELSE 60 END AS score,
      CASE WHEN empty_fields = 0 THEN '' ELSE empty_fields || ' empty field(s)' END AS issue FROM e""",
)
def critic_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rule_verdict(conversation_pairs(spark, sf_dir), "conv_id", ["prompt", "completion"])


@query(
    "embedding_dispersion",
    """WITH v AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
                  FROM embeddings),
    c AS (SELECT label, i, avg(x) AS m FROM v GROUP BY 1, 2),
    s AS (SELECT label, vec_id, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS cosine
          FROM v JOIN c USING (label, i) GROUP BY 1, 2)
    SELECT label, count(*) AS row_count, round_even(avg(1 - cosine), 6) AS dispersion FROM s GROUP BY 1""",
)
def embedding_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.embedding_dispersion(table(spark, sf_dir, "embeddings"), "label", "embedding")


@query(
    "difficulty_band",
    """WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL
      WHEN p_partkey % 2 = 0 THEN p_size / 50.0 ELSE p_size * 2.0 END AS raw FROM part),
    n AS (SELECT p_partkey, raw, greatest(0, least(100, floor(CASE WHEN raw > 0 AND raw <= 1 THEN raw * 100
      ELSE raw END + 0.5))) AS pct FROM s)
    SELECT p_partkey, CASE WHEN raw IS NULL THEN NULL WHEN pct >= 90 THEN 'easy' WHEN pct >= 75 THEN 'medium'
      WHEN pct >= 55 THEN 'hard' WHEN pct >= 35 THEN 'very_hard' ELSE 'intense' END AS band FROM n""",
)
def difficulty_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = (
        F.when(F.col("p_partkey") % 7 == 0, None)
        .when(F.col("p_partkey") % 2 == 0, F.col("p_size") / 50.0)
        .otherwise(F.col("p_size") * 2.0)
    )
    return table(spark, sf_dir, "part").select("p_partkey", quality.difficulty_band(raw).alias("band"))


@query(
    "missing_languages",
    """WITH w AS (SELECT DISTINCT source, unnest(['en', 'fr', 'hi', 'it']) AS lang FROM documents)
    SELECT source, lang FROM w ANTI JOIN documents d ON d.source = w.source AND d.lang = w.lang""",
)
def missing_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    wanted = documents.select("source").distinct().select(
        "source", F.explode(F.array(*[F.lit(x) for x in ("EN", "fr", "hi", "it")])).alias("lang")
    )
    return quality.missing_languages(documents, wanted, "source", "lang")


_FILL_SQL = f"""
  SELECT source, CASE WHEN trim(text, E' \\t\\n\\r') <> '' THEN 1 ELSE 0 END AS complete, {clean_sql('text')} AS clean,
    trim(text, E' \\t\\n\\r') AS text, len(regexp_extract_all(text, '\\S+')) AS n_words FROM base"""


@query(
    "refined_quality",
    f"""WITH first AS ({_report_sql(_dims_sql(_FILL_SQL.replace('FROM base', 'FROM documents'), 'source', 1, 0.70), 'source', 'research', 95)}),
    base AS (SELECT source, text FROM documents UNION ALL SELECT source, '[deterministic] text #' || i || ' about ' || source
      FROM first, range(25) t(i) WHERE requires_generation),
    again AS ({_report_sql(_dims_sql(_FILL_SQL, 'source', 1, 0.70), 'source', 'research', 95)})
    SELECT source, row_count, overall, score, requires_generation FROM again""",
)
def refined_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of tagged filler rows for sources below the research threshold, scored again."""
    rows = table(spark, sf_dir, "documents").select("source", "text")

    def propose(below: DataFrame, _round: int) -> DataFrame:
        needs = below.select("source", F.lit(25).cast("long").alias("missing"))
        return requests.placeholder_rows(needs, "source", "missing", ["text"], F.col("source")).drop("row_number")

    _, report, _ = process.refine(rows, "source", propose, "research", max_iterations=1)
    return report.select("source", "row_count", "overall", "score", "requires_generation")
