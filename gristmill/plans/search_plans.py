"""Searching a catalog made from parts, with queries made from their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import search
from gristmill.plans.registry import query, table


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lower("p_type")
    about = F.concat(F.lit("Parts of type "), kind, F.lit(" from "), F.col("p_brand"), F.lit(" for "), "p_name")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("dataset_id"),
        F.col("p_name").alias("title"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".csv")).alias("filename"),
        about.alias("description"),
        about.alias("ai_summary"),
        F.array(kind, F.lower("p_brand")).alias("tags"),
        F.when(kind == "promo", F.array(F.lit("glucose"), F.lit("bmi")))
        .otherwise(F.array(F.lit("size"), F.lit("price")))
        .alias("columns"),
        (F.col("p_size") * 2).alias("quality_score"),
        ((F.col("p_partkey") % 10) / 10.0).alias("missing_ratio"),
        F.when(F.col("p_partkey") % 3 == 0, "local").otherwise("public").alias("provider"),
    )


def catalog_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    text = (
        F.when(name.startswith("old"), F.concat(name, F.lit(" diabetes")))
        .when(name.startswith("hot"), F.concat(F.lit("Promo "), name))
        .when(name == "red bolt", F.lit("? !"))
        .when(name == "red widget", F.lit("unheard words"))
        .otherwise(name)
    )
    return table(spark, sf_dir, "part").select(name.alias("query_id"), text.alias("query")).distinct()


CATALOG_SQL = """
  SELECT p_partkey AS dataset_id, p_name AS title, replace(p_name, ' ', '_') || '.csv' AS filename,
    'Parts of type ' || lower(p_type) || ' from ' || p_brand || ' for ' || p_name AS description,
    lower(p_type) || ' ' || lower(p_brand) AS tags,
    CASE WHEN lower(p_type) = 'promo' THEN 'glucose bmi' ELSE 'size price' END AS cols,
    p_size * 2 AS quality_score, (p_partkey % 10) / 10.0::DOUBLE AS missing_ratio,
    CASE WHEN p_partkey % 3 = 0 THEN 'local' ELSE 'public' END AS provider FROM part"""
QUERY_SQL = """
  SELECT DISTINCT p_name AS query_id, CASE WHEN p_name LIKE 'old%' THEN p_name || ' diabetes'
    WHEN p_name LIKE 'hot%' THEN 'Promo ' || p_name WHEN p_name = 'red bolt' THEN '? !'
    WHEN p_name = 'red widget' THEN 'unheard words' ELSE p_name END AS query FROM part"""

_SYNONYM_SQL = ", ".join(f"('{k}', '{v}')" for k, vs in search.VECTOR_SYNONYMS.items() for v in vs)


def _bag_sql(rows: str, key: str, text: str) -> str:
    return f"SELECT {key}, t AS term FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM ({rows})) WHERE len(t) > 1"


def _vector_sql(bag: str, key: str) -> str:
    return f"""SELECT {key}, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT {key}, term FROM ({bag})
      UNION ALL SELECT {key}, s.other FROM ({bag}) b JOIN syn s ON s.term = b.term) GROUP BY 1, 2"""


SEARCH_SQL = f"""
  WITH syn(term, other) AS (VALUES {_SYNONYM_SQL}), q AS MATERIALIZED ({QUERY_SQL}), c AS MATERIALIZED ({CATALOG_SQL}),
  qt AS MATERIALIZED (SELECT DISTINCT query_id, term FROM ({_bag_sql('SELECT * FROM q', 'query_id', 'query')})),
  nq AS (SELECT query_id, count(term) AS n FROM q LEFT JOIN qt USING (query_id) GROUP BY 1),
  rt AS MATERIALIZED (SELECT DISTINCT dataset_id, term FROM ({_bag_sql("SELECT *, concat_ws(' ', title, filename, description, tags, cols) AS body FROM c", 'dataset_id', 'body')})),
  qv AS MATERIALIZED ({_vector_sql('SELECT * FROM qt', 'query_id')}),
  rv AS MATERIALIZED ({_vector_sql(_bag_sql("SELECT *, concat_ws(' ', title, description, description, tags, cols) AS body FROM c", 'dataset_id', 'body'), 'dataset_id')}),
  qn AS (SELECT query_id, sqrt(sum(tf * tf)) AS n FROM qv GROUP BY 1), rn AS (SELECT dataset_id, sqrt(sum(tf * tf)) AS n FROM rv GROUP BY 1),
  lex AS (SELECT query_id, dataset_id, count(*) AS common, string_agg(term, ', ' ORDER BY term) AS matched_terms
    FROM qt JOIN rt USING (term) GROUP BY 1, 2),
  sem AS (SELECT query_id, dataset_id, sum(qv.tf * rv.tf) AS dot FROM qv JOIN rv USING (term) GROUP BY 1, 2),
  s AS (SELECT q.query_id, c.dataset_id, c.quality_score, c.missing_ratio, c.provider,
      CASE WHEN nq.n = 0 THEN 1.0::DOUBLE ELSE coalesce(lex.common, 0) / nq.n END AS lexical,
      coalesce(sem.dot / (qn.n * rn.n), 0.0) AS semantic, coalesce(matched_terms, '') AS matched_terms
    FROM q CROSS JOIN c JOIN nq USING (query_id) LEFT JOIN lex ON lex.query_id = q.query_id AND lex.dataset_id = c.dataset_id
    LEFT JOIN sem ON sem.query_id = q.query_id AND sem.dataset_id = c.dataset_id
    LEFT JOIN qn ON qn.query_id = q.query_id LEFT JOIN rn ON rn.dataset_id = c.dataset_id),
  scored AS (SELECT query_id, dataset_id, round_even(greatest(lexical, semantic) * 0.5::DOUBLE + quality_score / 100 * 0.2::DOUBLE
      + (1.0::DOUBLE - missing_ratio) * 0.15::DOUBLE + CASE WHEN provider = 'local' THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END * 0.1::DOUBLE
      + 0.05::DOUBLE, 4) AS relevance_score,
    round_even(semantic, 4) AS semantic_relevance, round_even(lexical, 4) AS lexical_relevance, matched_terms FROM s),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, dataset_id) AS rank FROM scored)"""


@query("catalog_topk", SEARCH_SQL + " SELECT * FROM ranked WHERE rank <= 10")
def catalog_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.catalog_search(catalog_queries(spark, sf_dir), catalog(spark, sf_dir), 10)


def _allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_brand <> 'Brand#1'").select(F.col("p_partkey").alias("dataset_id"))


@query(
    "catalog_topk_allowed",
    SEARCH_SQL
    + """, allowed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, dataset_id) AS place
      FROM scored WHERE dataset_id IN (SELECT p_partkey FROM part WHERE p_brand <> 'Brand#1') AND
      greatest(lexical_relevance, semantic_relevance) >= 0.25)
    SELECT query_id, dataset_id, relevance_score, place FROM allowed WHERE place <= 5""",
)
def catalog_topk_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search among the records a caller may see, weak matches dropped."""
    records = catalog(spark, sf_dir).join(_allowed(spark, sf_dir), "dataset_id", "left_semi")
    found = search.catalog_search(catalog_queries(spark, sf_dir), records, 5, min_relevance=0.25)
    return found.select("query_id", "dataset_id", "relevance_score", F.col("rank").alias("place"))


@query(
    "semantic_topk",
    f"""WITH syn(term, other) AS (VALUES {_SYNONYM_SQL}),
    q AS MATERIALIZED ({_vector_sql(_bag_sql(QUERY_SQL, 'query_id', 'query'), 'query_id')}),
    d AS MATERIALIZED ({_vector_sql(_bag_sql(CATALOG_SQL, 'dataset_id', 'description'), 'dataset_id')}),
    qn AS (SELECT query_id, sqrt(sum(tf * tf)) AS n FROM q GROUP BY 1), dn AS (SELECT dataset_id, sqrt(sum(tf * tf)) AS n FROM d GROUP BY 1),
    p AS (SELECT query_id, dataset_id, sum(q.tf * d.tf) AS dot FROM q JOIN d USING (term) GROUP BY 1, 2),
    s AS (SELECT query_id, dataset_id, round_even(dot / (qn.n * dn.n), 6) AS cosine FROM p JOIN qn USING (query_id) JOIN dn USING (dataset_id))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, dataset_id) AS rank FROM s) WHERE rank <= 5""",
)
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.semantic_top_k(
        catalog_queries(spark, sf_dir), "query_id", "query", catalog(spark, sf_dir), "dataset_id", "description", 5
    )


@query(
    "term_vectors",
    f"""WITH syn(term, other) AS (VALUES {_SYNONYM_SQL})
    {_vector_sql(_bag_sql("SELECT doc_id, text FROM documents", 'doc_id', 'text'), 'doc_id')}""",
)
def term_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_vectors(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query(
    "tokenize_terms",
    """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS runs FROM documents)
    SELECT doc_id, len(runs) AS runs, len(list_filter(runs, lambda x: len(x) > 1)) AS tokens,
      len(list_distinct(list_filter(runs, lambda x: len(x) > 1))) AS distinct_tokens FROM t""",
)
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(tx.alnum_runs(text)).alias("runs"),
        F.size(tx.token_bag(text)).alias("tokens"),
        F.size(tx.token_set(text)).alias("distinct_tokens"),
    )


# Requests as a query log: the customer's segment and nation turned into free text.
_REQUEST_SQL = """
  SELECT c_custkey, CASE c_custkey % 8
    WHEN 0 THEN '  Find   latest medical qa dataset  ' WHEN 1 THEN 'chat sentiment ' || lower(c_mktsegment)
    WHEN 2 THEN 'Stock market data for ' || c_mktsegment WHEN 3 THEN '' WHEN 4 THEN 'traffic accidents 2024'
    WHEN 5 THEN 'the dataset' WHEN 6 THEN c_mktsegment || ' weather code' ELSE 'Legal court text chat' END AS query FROM customer"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, segment = F.col("c_custkey") % 8, F.col("c_mktsegment")
    text = (
        F.when(kind == 0, "  Find   latest medical qa dataset  ")
        .when(kind == 1, F.concat(F.lit("chat sentiment "), F.lower(segment)))
        .when(kind == 2, F.concat(F.lit("Stock market data for "), segment))
        .when(kind == 3, "")
        .when(kind == 4, "traffic accidents 2024")
        .when(kind == 5, "the dataset")
        .when(kind == 6, F.concat(segment, F.lit(" weather code")))
        .otherwise("Legal court text chat")
    )
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("query"))


_VARIANT_STOP = ", ".join(f"'{w}'" for w in search.VARIANT_STOP_WORDS)


@query(
    "query_variants",
    f"""WITH r AS ({_REQUEST_SQL}), n AS (SELECT c_custkey, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS q FROM r),
    t AS (SELECT c_custkey, q, list_filter(regexp_extract_all(lower(q), '[a-z0-9]+'), lambda x: x NOT IN ({_VARIANT_STOP})) AS k FROM n),
    v AS (SELECT c_custkey, unnest([1, 2, 3, 4, 5]) AS pos, unnest([q, CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') END,
      CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') || ' dataset' END,
      CASE WHEN len(k) > 2 THEN array_to_string(k[1:2], ' ') END, CASE WHEN len(k) > 0 THEN k[1] END]) AS variant FROM t),
    f AS (SELECT c_custkey, arg_min(variant, pos) AS variant, min(pos) AS pos FROM v WHERE variant IS NOT NULL GROUP BY c_custkey, lower(variant))
    SELECT c_custkey, variant, CAST(variant_pos AS INT) AS variant_pos FROM (SELECT c_custkey, variant,
      row_number() OVER (PARTITION BY c_custkey ORDER BY pos) AS variant_pos FROM f) WHERE variant_pos <= 1 + c_custkey % 4""",
)
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = search.query_variants(F.col("query"), (1 + F.col("c_custkey") % 4).cast("int"))
    return (
        requests(spark, sf_dir)
        .select("c_custkey", F.posexplode(variants).alias("pos", "variant"))
        .select("c_custkey", "variant", (F.col("pos") + 1).alias("variant_pos"))
    )


_HINT_SQL = ", ".join(
    f"({i}, '{d}', '{h}')" for i, (d, hs) in enumerate(search.DOMAIN_HINTS.items()) for h in hs
)
_INTENT_SYN_SQL = ", ".join(f"('{k}', '{v}')" for k, vs in search.INTENT_SYNONYMS.items() for v in vs)
_HINT_STOP = ", ".join(f"'{w}'" for w in search.HINT_STOP_WORDS)


@query(
    "search_intent",
    f"""WITH r AS ({_REQUEST_SQL}), hint(ord, domain, word) AS (VALUES {_HINT_SQL}), syn(term, other) AS (VALUES {_INTENT_SYN_SQL}),
    t AS (SELECT DISTINCT c_custkey, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM r),
    x AS (SELECT c_custkey, term FROM t UNION SELECT c_custkey, other FROM t JOIN syn USING (term)),
    e AS (SELECT c_custkey, string_agg(term, ', ' ORDER BY term) AS terms FROM x GROUP BY 1),
    o AS (SELECT c_custkey, ord, domain, count(*) AS n FROM t JOIN hint ON word = term GROUP BY 1, 2, 3),
    d AS (SELECT c_custkey, domain FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY n DESC, ord) AS rn FROM o) WHERE rn = 1),
    fr AS (SELECT DISTINCT c_custkey FROM t WHERE term IN ('recent', 'latest', '2024', '2025')),
    a AS (SELECT r.c_custkey, query, coalesce(terms, '') AS terms, coalesce(domain, 'general') AS domain,
      concat_ws(', ', CASE WHEN fr.c_custkey IS NOT NULL THEN 'freshness=recent' END, 'domain=' || domain) AS filters
      FROM r LEFT JOIN e USING (c_custkey) LEFT JOIN d USING (c_custkey) LEFT JOIN fr ON fr.c_custkey = r.c_custkey)
    SELECT c_custkey, query, terms, domain, filters, CASE WHEN trim(query) = '' THEN 'Empty query; provide search terms to expand intent.'
      ELSE 'Normalized intent terms: ' || terms || '. Likely domain: ' || domain || '. Suggested filters: '
        || CASE WHEN filters = '' THEN 'none' ELSE filters END || '.' END AS intent,
      coalesce(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda w: w NOT IN ({_HINT_STOP}))[1], 'general') AS hint
    FROM a""",
)
def search_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_intent(requests(spark, sf_dir), "query").withColumn("hint", search.domain_hint(F.col("query")))


@query(
    "intensity_profile",
    f"""WITH p(intensity, result_limit, providers, query_passes, label, strategy) AS (VALUES {', '.join(map(str, search.INTENSITIES))}),
    r AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN ' Very Hard' WHEN '2-HIGH' THEN 'very-hard' WHEN '3-MEDIUM' THEN 'EASY'
      WHEN '5-LOW' THEN 'intense' ELSE 'whatever' END AS asked FROM orders),
    n AS (SELECT o_orderkey, regexp_replace(lower(trim(asked)), '[ -]', '_', 'g') AS k FROM r)
    SELECT o_orderkey, p.* FROM n JOIN p ON p.intensity = CASE WHEN k IN (SELECT intensity FROM p) THEN k ELSE 'medium' END""",
)
def intensity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    asked = (
        F.when(priority == "1-URGENT", " Very Hard").when(priority == "2-HIGH", "very-hard")
        .when(priority == "3-MEDIUM", "EASY").when(priority == "5-LOW", "intense").otherwise("whatever")
    )
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", search.intensity_profile(asked).alias("p"))
        .select("o_orderkey", "p.*")
    )


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public candidates: parts as found for the query that is their name's second word."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.split("p_name", " ")[1].alias("query_id"),
        F.concat(F.lit("find "), F.split("p_name", " ")[1], F.lit(" "), F.lower("p_type")).alias("query"),
        key.alias("dataset_id"),
        F.col("p_name").alias("title"),
        F.when(key % 4 == 0, "").otherwise(F.concat("p_brand", F.lit(" "), "p_type")).alias("description"),
        F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type")).alias("tags"),
        F.concat(F.lit("https://example.org/d/"), (key % 500).cast("string")).alias("url"),
        (F.col("p_size") * 137 % 7001).alias("downloads"),
        F.when(key % 6 == 0, "HuggingFace").when(key % 6 == 1, "kaggle").when(key % 6 == 2, "data.gov").otherwise("web").alias("provider"),
        key.alias("seen_order"),
    )


_CANDIDATE_SQL = """
  SELECT split_part(p_name, ' ', 2) AS query_id, 'find ' || split_part(p_name, ' ', 2) || ' ' || lower(p_type) AS query,
    p_partkey AS dataset_id, p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand || ' ' || p_type END AS description,
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS tag, 'https://example.org/d/' || p_partkey % 500 AS url,
    p_size * 137 % 7001 AS downloads, CASE p_partkey % 6 WHEN 0 THEN 0.9 WHEN 1 THEN 0.85 WHEN 2 THEN 0.8 ELSE 0.7 END::DOUBLE AS weight
  FROM part"""
_PUBLIC_SQL = f"""
  c AS ({_CANDIDATE_SQL}), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY dataset_id) AS rn FROM c) WHERE rn = 1),
  cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY downloads DESC, dataset_id) AS place FROM u) WHERE place <= 25),
  tok AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda x: len(x) > 1)) AS q,
    list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', title, description, tag)), '[a-z0-9]+'), lambda x: len(x) > 1)) AS s FROM cut),
  pub AS (SELECT query_id, dataset_id, round_even(least(1.0::DOUBLE, len(list_intersect(q, s)) / greatest(1, len(q)) * 0.55::DOUBLE
    + least(1.0::DOUBLE, downloads / 5000) * 0.20::DOUBLE + (CASE WHEN description <> '' THEN 0.4 ELSE 0 END::DOUBLE
    + CASE WHEN tag <> '' THEN 0.3 ELSE 0 END::DOUBLE + 0.3::DOUBLE) * 0.15::DOUBLE + weight * 0.10::DOUBLE), 6) AS discovery_score FROM tok)"""


def _public(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = search.first_seen(_candidates(spark, sf_dir), ["query_id"], "url", ["seen_order"])
    return search.public_ranking(unique, 25)


@query("public_scores", f"WITH {_PUBLIC_SQL} SELECT * FROM pub")
def public_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(spark, sf_dir).select("query_id", "dataset_id", "discovery_score")


@query(
    "unified_topk",
    SEARCH_SQL.replace(
        QUERY_SQL, "SELECT DISTINCT split_part(p_name, ' ', 2) AS query_id, split_part(p_name, ' ', 2) AS query FROM part"
    )
    + ", " + _PUBLIC_SQL.replace("\n  c AS", "\n  cand AS", 1).replace("FROM c)", "FROM cand)", 1)
    + """, m AS (SELECT query_id, dataset_id, 'local' AS result_type, relevance_score AS score FROM ranked WHERE rank <= 12
      UNION ALL SELECT query_id, dataset_id, 'public', discovery_score FROM pub)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, result_type, dataset_id) AS rank FROM m) WHERE rank <= 12""",
)
def unified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.split("p_name", " ")[1]
    asked = table(spark, sf_dir, "part").select(word.alias("query_id"), word.alias("query")).distinct()
    local = search.catalog_search(asked, catalog(spark, sf_dir), 12).drop("rank").withColumn("result_type", F.lit("local"))
    public = _public(spark, sf_dir).withColumn("result_type", F.lit("public"))
    return search.unified_ranking(
        local.select("query_id", "dataset_id", "result_type", "relevance_score"),
        public.select("query_id", "dataset_id", "result_type", "discovery_score"),
        12,
    ).select("query_id", "dataset_id", "result_type", "score", "rank")


@query(
    "search_status",
    """WITH s AS (SELECT o_orderkey, o_orderkey % 2 = 1 AS include_public, o_orderkey % 3 <> 0 AS enabled, o_orderkey % 5 AS public_count,
      o_orderkey % 4 AS returned, o_orderkey % 7 AS warnings FROM orders)
    SELECT o_orderkey, CASE WHEN NOT include_public THEN CASE WHEN returned > 0 THEN 'complete' ELSE 'empty' END
      WHEN NOT enabled THEN CASE WHEN returned > 0 THEN 'partial' ELSE 'disabled' END
      WHEN warnings > 0 AND public_count = 0 AND returned = 0 THEN 'failed' WHEN warnings > 0 THEN 'partial'
      WHEN returned > 0 THEN 'complete' ELSE 'empty' END AS status FROM s""",
)
def search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        search.search_status(key % 2 == 1, key % 3 != 0, key % 4, key % 5, key % 7).alias("status"),
    )


@query(
    "search_outcome",
    SEARCH_SQL.replace(
        QUERY_SQL, "SELECT DISTINCT split_part(p_name, ' ', 2) AS query_id, split_part(p_name, ' ', 2) AS query FROM part"
    )
    + ", " + _PUBLIC_SQL.replace("\n  c AS", "\n  cand AS", 1).replace("FROM c)", "FROM cand)", 1)
    + """, m AS (SELECT query_id, 'local' AS result_type, relevance_score AS score, dataset_id FROM ranked WHERE rank <= 12
      UNION ALL SELECT query_id, 'public', discovery_score, dataset_id FROM pub),
    k AS (SELECT query_id, count(*) FILTER (WHERE result_type = 'local') AS local, count(*) FILTER (WHERE result_type = 'public') AS "public",
      least(12, count(*)) AS returned FROM m GROUP BY 1)
    SELECT *, CASE WHEN query_id = 'bolt' THEN 1 ELSE 0 END AS warnings, CASE WHEN query_id = 'bolt' THEN 'partial' ELSE 'complete' END AS status FROM k""",
)
def search_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and status of each query's unified search; one query had a failing provider."""
    word = F.split("p_name", " ")[1]
    asked = table(spark, sf_dir, "part").select(word.alias("query_id"), word.alias("query")).distinct()
    local = search.catalog_search(asked, catalog(spark, sf_dir), 12).select("query_id", F.lit("local").alias("kind"))
    public = _public(spark, sf_dir).select("query_id", F.lit("public").alias("kind"))
    counts = local.unionByName(public).groupBy("query_id").agg(
        F.count_if(F.col("kind") == "local").alias("local"),
        F.count_if(F.col("kind") == "public").alias("public"),
        F.least(F.lit(12), F.count(F.lit(1))).alias("returned"),
        F.max(F.when(F.col("query_id") == "bolt", 1).otherwise(0)).alias("warnings"),
    )
    status = search.search_status(F.lit(True), F.lit(True), F.col("returned"), F.col("public"), F.col("warnings"))
    return counts.withColumn("status", status)
