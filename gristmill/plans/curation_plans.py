"""Duplicates, merging, cleaning, overlap and balancing over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import curate, gates, overlap, profile
from gristmill.plans.gate_plans import GATED_SQL, LICENSE_GUESS_SQL, gated_documents, license_guess
from gristmill.plans.registry import query, table
from gristmill.session import durable

_STRIPPED = "trim(text, E' \\t\\n\\r')"


@query(
    "exact_dedup",
    f"""SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY {_STRIPPED}
      ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    kept = curate.drop_exact_copies(documents, "doc_id", curate.text_digest(F.col("text")))
    return kept.select("doc_id", "lang", "source", "n_chars")


@query(
    "merge_with_lineage",
    f"""WITH d AS (SELECT *, sha256({_STRIPPED}) AS digest FROM documents)
    SELECT digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source,
      count(DISTINCT source) AS n_origins, count(*) AS copies FROM d GROUP BY digest""",
)
def merge_with_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return curate.merge_with_lineage(
        documents, "source", "doc_id", curate.text_digest(F.col("text"))
    ).withColumn("copies", F.col("copies").cast("long"))


@query(
    "merge_aligned_rows",
    """WITH u AS (SELECT 'documents' AS origin, lang, NULL AS role, text FROM documents
      UNION ALL SELECT 'conversations', NULL, role, text FROM conversations
      UNION ALL SELECT 'benchmark', NULL, NULL, text FROM benchmark)
    SELECT origin, count(*) AS row_count, count(lang) AS with_lang, count(role) AS with_role,
      count(DISTINCT text) AS texts FROM u GROUP BY origin""",
)
def merge_aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three collections under one schema, each row tagged with where it came from."""
    frames = [
        table(spark, sf_dir, "documents").select("lang", "text"),
        table(spark, sf_dir, "conversations").select("role", "text"),
        table(spark, sf_dir, "benchmark").select("text"),
    ]
    names = ["documents", "conversations", "benchmark"]
    merged = profile.align([f.withColumn("origin", F.lit(n)) for f, n in zip(frames, names)])
    by_text = merged.groupBy("origin", F.sha2("text", 256).alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.count("lang").alias("with_lang"), F.count("role").alias("with_role")
    )
    return by_text.groupBy("origin").agg(
        F.sum("n").alias("row_count"),
        F.sum("with_lang").alias("with_lang"),
        F.sum("with_role").alias("with_role"),
        F.count(F.lit(1)).alias("texts"),
    )


@query(
    "merge_summary",
    f"""WITH l AS (SELECT source, doc_id, CASE WHEN {LICENSE_GUESS_SQL} = '' THEN NULL ELSE lower({LICENSE_GUESS_SQL}) END
        AS license FROM documents),
      s AS (SELECT source, count(*) AS n, coalesce(arg_min(license, doc_id) FILTER (WHERE license IS NOT NULL), 'unknown')
        AS license, min(doc_id) AS first_doc FROM l GROUP BY source)
    SELECT count(*) AS sources, CAST(sum(n) AS BIGINT) AS row_count, arg_min(license, first_doc) AS license,
      count(DISTINCT license) AS licenses FROM s""",
)
def merge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.nullif(F.lower(license_guess(F.col("text"))), F.lit(""))
    per_source = (
        table(spark, sf_dir, "documents")
        .select("source", "doc_id", guess.alias("license"))
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(
                F.min_by("license", F.when(F.col("license").isNotNull(), F.col("doc_id"))), F.lit("unknown")
            ).alias("license"),
            F.min("doc_id").alias("first_doc"),
        )
    )
    return curate.merge_summary(per_source, "source", "n", "license", "first_doc")


_PII_SUM = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in gates.PII_PATTERNS.values())


@query(
    "cleaning_report",
    f"""SELECT source, count(*) AS input_rows, count(DISTINCT {_STRIPPED}) AS output_rows,
      count(*) - count(DISTINCT {_STRIPPED}) AS duplicates_removed, CAST(sum({_PII_SUM}) AS BIGINT) AS pii_findings,
      CAST(sum(CASE WHEN contains(text, chr(65533)) THEN 1 ELSE 0 END) AS BIGINT) AS encoding_errors
    FROM documents GROUP BY source""",
)
def cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.cleaning_report(table(spark, sf_dir, "documents"), "source", "text")


@query(
    "modification_log",
    " UNION ALL ".join(
        f"SELECT doc_id, 'mask_{kind}' AS action, CAST(len(regexp_extract_all(text, '{p}')) AS VARCHAR) AS detail "
        f"FROM documents WHERE regexp_matches(text, '{p}')"
        for kind, p in gates.PII_PATTERNS.items()
    )
    + f" UNION ALL SELECT doc_id, 'strip', '' FROM documents WHERE text <> {_STRIPPED}"
    + f""" UNION ALL SELECT doc_id, 'drop_copy', '' FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_STRIPPED}
      ORDER BY doc_id) AS rn FROM documents) WHERE rn > 1""",
)
def modification_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.modification_log(table(spark, sf_dir, "documents"), "doc_id", "text")


def _grams_sql(table_name: str, keys: str, n: int) -> str:
    ws = "string_split_regex(trim(lower(text), E' \\t\\n\\r'), '\\s+')"
    return f"""SELECT DISTINCT {keys}, unnest(CASE WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' ')) END) AS gram
      FROM (SELECT *, {ws} AS ws FROM {table_name})"""


# All pairs of texts, by their whole sets of n-grams.
NEAR_SQL = f"""
  WITH RECURSIVE firsts AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_STRIPPED}) AS leader, text FROM documents),
  g AS MATERIALIZED ({_grams_sql('(SELECT doc_id, text FROM firsts WHERE doc_id = leader)', 'doc_id', 3)}),
  size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id
    WHERE a.gram <> '' GROUP BY 1, 2),
  links AS MATERIALIZED (SELECT a, b FROM shared s JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
    WHERE s.n >= 0.8::DOUBLE * (x.n + y.n - s.n)),
  both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
  near AS (SELECT a AS doc_id, least(a, min(b)) AS near_of FROM reach GROUP BY a)
  SELECT f.doc_id, CASE WHEN f.leader <> f.doc_id THEN 'exact' WHEN near_of < f.doc_id THEN 'near' ELSE 'unique' END AS kind,
    CASE WHEN f.leader <> f.doc_id THEN f.leader ELSE coalesce(near_of, f.doc_id) END AS copy_of
  FROM firsts f LEFT JOIN near ON near.doc_id = f.doc_id"""


@query("near_duplicates", NEAR_SQL)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "near_duplicate_ratio",
    f"""WITH n AS ({NEAR_SQL}) SELECT source, count(*) AS row_count, count(*) FILTER (WHERE kind = 'exact') AS exact_copies,
      count(*) FILTER (WHERE kind = 'near') AS near_copies,
      round_even(count(*) FILTER (WHERE kind = 'unique') / count(*), 4) AS duplicate_ratio
    FROM n JOIN documents USING (doc_id) GROUP BY source""",
)
def near_duplicate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The duplicate-ratio dimension counting near copies too: share of rows that stay."""
    documents = table(spark, sf_dir, "documents")
    standing = curate.near_duplicates(documents, "doc_id", "text")
    return (
        documents.select("doc_id", "source")
        .join(standing, "doc_id")
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(F.col("kind") == "exact").alias("exact_copies"),
            F.count_if(F.col("kind") == "near").alias("near_copies"),
            F.bround(F.count_if(F.col("kind") == "unique") / F.count(F.lit(1)), 4).alias("duplicate_ratio"),
        )
    )


@query(
    "overlap_between_sources",
    f"""WITH g AS ({_grams_sql('documents', 'source', 5)}), s AS (SELECT *, count(*) OVER (PARTITION BY gram) AS spread FROM g)
    SELECT source, count(*) AS grams, count(*) FILTER (WHERE spread > 1) AS shared_grams,
      round_even(count(*) FILTER (WHERE spread > 1) / count(*), 4) AS overlap_ratio FROM s GROUP BY source""",
)
def overlap_between_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.overlap_between(table(spark, sf_dir, "documents"), "source", "text")


@query(
    "overlap_with_benchmark",
    f"""WITH g AS ({_grams_sql('documents', 'source', 5)}), b AS (SELECT DISTINCT gram FROM ({_grams_sql('benchmark', 'item_id', 5)}))
    SELECT source, count(*) AS grams, count(b.gram) AS shared_grams,
      round_even(count(b.gram) / (SELECT count(*) FROM b), 4) AS overlap_ratio
    FROM g LEFT JOIN b ON b.gram = g.gram GROUP BY source""",
)
def overlap_with_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.overlap_with(
        table(spark, sf_dir, "documents"), "source", "text", table(spark, sf_dir, "benchmark"), "text"
    )


@query(
    "shared_with_benchmark",
    f"""WITH g AS ({_grams_sql('documents', 'source', 5)}), b AS (SELECT DISTINCT gram FROM ({_grams_sql('benchmark', 'item_id', 5)}))
    SELECT source, count(b.gram) AS shared_grams, round_even(count(b.gram) / (SELECT count(*) FROM b), 4) AS overlap_ratio
    FROM g LEFT JOIN b ON b.gram = g.gram GROUP BY source""",
)
def shared_with_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.shared_with(
        table(spark, sf_dir, "documents"), "source", "text", table(spark, sf_dir, "benchmark"), "text"
    )


@query(
    "overlap_estimates",
    f"""WITH g AS ({_grams_sql('documents', 'source', 5)}), b AS (SELECT DISTINCT gram FROM ({_grams_sql('benchmark', 'item_id', 5)}))
    SELECT source, count(*) AS grams, count(b.gram) AS shared_grams, TRUE AS grams_close, TRUE AS shared_close
    FROM g LEFT JOIN b ON b.gram = g.gram GROUP BY source""",
)
def overlap_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts, and whether the sketches' estimates are within four times their error of them."""
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    exact = curate.overlap_with(documents, "source", "text", benchmark, "text").drop("overlap_ratio")
    held = overlap.sketches(benchmark.select(F.lit("benchmark").alias("name"), "text"), "name", "text")
    estimated = overlap.estimates(overlap.sketches(documents, "source", "text"), "source", held)
    estimated = estimated.withColumnsRenamed({"grams": "e_grams", "shared_grams": "e_shared"})
    allowed = F.greatest("grams", F.lit(1)) * 4 / 2 ** (overlap.SKETCH_LOG / 2)
    return exact.join(estimated, "source").select(
        "source",
        "grams",
        "shared_grams",
        (F.abs(F.col("e_grams") - F.col("grams")) <= allowed).alias("grams_close"),
        (F.abs(F.col("e_shared") - F.col("shared_grams")) <= allowed).alias("shared_close"),
    )


@query(
    "balance_by_language",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id)
      AS balance_rank FROM documents), q AS (SELECT min(n) AS quota FROM (SELECT count(*) AS n FROM documents GROUP BY lang))
    SELECT doc_id, lang, balance_rank FROM r, q WHERE balance_rank <= quota""",
)
def balance_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return curate.balance(rows, "lang", "doc_id").select("doc_id", "lang", "balance_rank")


@query(
    "curation_chain",
    f"""WITH g AS ({GATED_SQL}), ok AS (SELECT *, {_STRIPPED} AS clean FROM g WHERE license_ok AND pii_ok AND tox_ok),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY doc_id) AS rn FROM ok) WHERE rn = 1),
    c AS (SELECT source, count(*) AS input_rows, count(*) FILTER (WHERE NOT (license_ok AND pii_ok AND tox_ok)) AS gate_rejects
      FROM g GROUP BY source)
    SELECT source, input_rows, gate_rejects, coalesce(n, 0) AS output_rows, n_languages,
      CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END AS training_readiness
    FROM c LEFT JOIN (SELECT source, count(*) AS n, count(DISTINCT lang) AS n_languages FROM u GROUP BY source) USING (source)""",
)
def curation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates, then copy removal, then language and readiness checks, per source.

    The texts are read once; what follows works on one narrow row per document.
    """
    narrow = durable(
        gated_documents(spark, sf_dir).select(
            "doc_id", "source", "lang", "passed", curate.text_digest(F.col("text")).alias("digest")
        )
    )
    counts = narrow.groupBy("source").agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if(~F.col("passed")).alias("gate_rejects")
    )
    passed = narrow.where("passed").drop("passed")
    kept = passed.transform(curate.drop_exact_copies, "doc_id", F.col("digest"))
    by_language = kept.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    result = by_language.groupBy("source").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_languages")
    )
    return counts.join(result, "source", "left").select(
        "source",
        "input_rows",
        "gate_rejects",
        F.coalesce("n", F.lit(0)).alias("output_rows"),
        "n_languages",
        F.when(F.col("n") > 0, "PASS").otherwise("FAIL").alias("training_readiness"),
    )
