"""License, personal-data and toxicity gates over documents and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import gates, quality
from gristmill.plans.quality_plans import DOCUMENT_REPORT_SQL, document_metrics
from gristmill.plans.registry import query, table

# License lines as they stand in the documents, with the identifier each one means.
LICENSE_LINES = (
    ("MIT License", "MIT"),
    ("Apache License, Version 2", "Apache-2.0"),
    ("CC BY-NC 4", "cc-by-nc-4.0"),
    ("GNU General Public License", "gpl-3.0"),
)


def license_guess(text: Column) -> Column:
    guess = F.lit("")
    for line, name in reversed(LICENSE_LINES):
        guess = F.when(text.contains(line), name).otherwise(guess)
    return guess


LICENSE_GUESS_SQL = (
    "CASE " + " ".join(f"WHEN contains(text, '{line}') THEN '{name}'" for line, name in LICENSE_LINES) + " ELSE '' END"
)


def _license_sql(use: str) -> str:
    research = "license IN ('cc-by-nc-4.0', 'research-only', 'academic-only')" if use != "commercial" else "FALSE"
    permissive = "license IN ('apache-2.0', 'mit', 'bsd-2-clause', 'bsd-3-clause', 'cc-by-4.0')"
    return f"""
      WITH d AS (SELECT doc_id, source, CASE WHEN {LICENSE_GUESS_SQL} = '' THEN 'unknown'
        ELSE lower({LICENSE_GUESS_SQL}) END AS license FROM documents)
      SELECT doc_id, source, license, {permissive} OR {research} AS compatible,
        CASE WHEN {permissive} OR {research} THEN 'APPROVED' WHEN license = 'unknown' THEN 'UNKNOWN'
          ELSE 'REJECTED' END AS status,
        CASE WHEN {permissive} THEN '{gates.REASON_PERMISSIVE}' WHEN {research} THEN '{gates.REASON_RESEARCH}'
          WHEN license = 'unknown' THEN '{gates.REASON_UNKNOWN}' ELSE '{gates.REASON_REJECTED}' END AS reason
      FROM d"""


def licensed_documents(spark: SparkSession, sf_dir: str, use: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    guess = gates.resolve_license(F.lit(None).cast("string"), license_guess(F.col("text")))
    return gates.license_decision(
        documents.select("doc_id", "source", guess.alias("_guess")), F.col("_guess"), use
    ).drop("_guess")


@query("license_gate_commercial", _license_sql("commercial"))
def license_gate_commercial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensed_documents(spark, sf_dir, "commercial")


@query("license_gate_research", _license_sql("research"))
def license_gate_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensed_documents(spark, sf_dir, "research")


@query(
    "license_verdicts",
    f"""WITH l AS ({_license_sql('commercial')})
    SELECT source, CASE WHEN count(*) FILTER (WHERE compatible) > 0 THEN 'passed' ELSE 'rejected' END AS license_verdict,
      count(*) FILTER (WHERE compatible) AS approved, count(*) AS candidates,
      min(doc_id) FILTER (WHERE compatible) AS selected FROM l GROUP BY source""",
)
def license_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.license_verdict(licensed_documents(spark, sf_dir, "commercial"), "source", "doc_id", "doc_id")


_PII_COUNTS_SQL = ", ".join(
    f"len(regexp_extract_all(text, '{p}')) AS {kind}" for kind, p in gates.PII_PATTERNS.items()
)


@query(
    "pii_findings",
    f"""WITH c AS (SELECT source, {_PII_COUNTS_SQL} FROM documents)
    SELECT source, CAST(sum(email) AS BIGINT) AS email, CAST(sum(phone) AS BIGINT) AS phone,
      CAST(sum(ipv4) AS BIGINT) AS ipv4, CAST(sum(card) AS BIGINT) AS card,
      count(*) FILTER (WHERE email + phone + ipv4 + card > 0) AS rows_with_findings FROM c GROUP BY source""",
)
def pii_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = gates.pii_counts(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("source", *[c.alias(k) for k, c in counts.items()])
    any_found = sum((F.col(k) for k in counts), F.lit(0)) > 0
    return rows.groupBy("source").agg(
        *[F.sum(k).alias(k) for k in counts], F.count_if(any_found).alias("rows_with_findings")
    )


_MASK_SQL = "text"
for _kind, _pattern in gates.PII_PATTERNS.items():
    _MASK_SQL = f"regexp_replace({_MASK_SQL}, '{_pattern}', '[{_kind}]', 'g')"


@query("pii_masked", f"SELECT doc_id, sha256({_MASK_SQL}) AS masked_sha FROM documents WHERE text <> {_MASK_SQL}")
def pii_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = gates.mask_pii(F.col("text"))
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "text", masked.alias("masked"))
        .where("text <> masked")
        .select("doc_id", F.sha2("masked", 256).alias("masked_sha"))
    )


@query(
    "email_validity",
    r"""WITH e AS (SELECT c_custkey, '  ' || replace(c_name, '#', CASE WHEN c_custkey % 3 = 0 THEN '@' ELSE '.' END)
        || CASE WHEN c_custkey % 2 = 0 THEN '@Mail.Example' ELSE '@nodot' END || ' ' AS email FROM customer)
    SELECT c_custkey, lower(trim(email)) AS email,
      regexp_matches(lower(trim(email)), '^[^@\s]+@[^@\s]+\.[^@\s]+$') AS valid FROM e""",
)
def email_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    separator = F.when(F.col("c_custkey") % 3 == 0, "@").otherwise(".")
    host = F.when(F.col("c_custkey") % 2 == 0, "@Mail.Example").otherwise("@nodot")
    raw = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), separator), host, F.lit(" "))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", gates.normalize_email(raw).alias("email"), gates.is_email(raw).alias("valid")
    )


@query(
    "toxicity_gate",
    """SELECT source, count(toxic) AS judged, round_even(coalesce(sum(toxic) / nullif(count(toxic), 0), 0), 4) AS toxic_rate,
      CASE WHEN coalesce(sum(toxic) / nullif(count(toxic), 0), 0) <= 0.1 THEN 'PASS' ELSE 'FAIL' END AS critical_toxicity
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def toxicity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = table(spark, sf_dir, "documents").select("doc_id", "source").join(
        table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left"
    )
    return gates.toxicity_gate(judged, "source", "toxic", 0.1)


def gated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left"
    )
    text = F.col("text")
    findings = sum(gates.pii_counts(text).values(), F.lit(0))
    return gates.apply_gates(
        documents,
        {
            "license": license_guess(text) != "gpl-3.0",
            "pii": findings == 0,
            "critical_toxicity": F.coalesce(F.col("toxic"), F.lit(0)) == 0,
        },
    )


GATED_SQL = f"""
  SELECT d.*, l.toxic, {LICENSE_GUESS_SQL} <> 'gpl-3.0' AS license_ok,
    NOT regexp_matches(text, '{'|'.join(gates.PII_PATTERNS.values())}') AS pii_ok,
    coalesce(l.toxic, 0) = 0 AS tox_ok
  FROM documents d LEFT JOIN labels l USING (doc_id)"""


@query(
    "gate_audit",
    f"""WITH g AS ({GATED_SQL})
    SELECT doc_id, source, 'license' AS gate FROM g WHERE NOT license_ok
    UNION ALL SELECT doc_id, source, 'pii' FROM g WHERE NOT pii_ok
    UNION ALL SELECT doc_id, source, 'critical_toxicity' FROM g WHERE NOT tox_ok""",
)
def gate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.audit_rejections(gated_documents(spark, sf_dir), ["doc_id", "source"])


@query(
    "certification",
    f"""WITH r AS ({DOCUMENT_REPORT_SQL}), g AS ({GATED_SQL}),
    s AS (SELECT source, count(*) FILTER (WHERE NOT license_ok) AS license_failures,
      sum(toxic) / count(toxic) AS toxic_rate FROM g GROUP BY source)
    SELECT source, score, license_failures, CASE WHEN license_failures = 0 AND toxic_rate <= 0.2 THEN
      CASE WHEN score >= 98 THEN 'Enterprise Ready' WHEN score >= 95 THEN 'Research Ready'
        WHEN score >= 90 THEN 'Production Ready' END END AS certificate
    FROM r JOIN s USING (source)""",
)
def certification(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(document_metrics(spark, sf_dir)).select("source", "score")
    gated = gated_documents(spark, sf_dir).groupBy("source").agg(
        F.count_if(F.col("failed_gates").contains("license")).alias("license_failures"),
        (F.sum("toxic") / F.count("toxic")).alias("toxic_rate"),
    )
    passes = (F.col("license_failures") == 0) & (F.col("toxic_rate") <= 0.2)
    return report.join(gated, "source").select(
        "source",
        "score",
        "license_failures",
        gates.certification(F.col("score"), passes, F.lit(True)).alias("certificate"),
    )
