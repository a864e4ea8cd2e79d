"""License, personal-data and toxicity gates, their audit, and certification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# License classes.
PERMISSIVE_LICENSES = ("apache-2.0", "mit", "bsd-2-clause", "bsd-3-clause", "cc-by-4.0")
RESEARCH_ONLY_LICENSES = ("cc-by-nc-4.0", "research-only", "academic-only")

# Reason texts of license decisions.
REASON_PERMISSIVE = "License is compatible with commercial and research use."
REASON_RESEARCH = "License is compatible with the requested non-commercial use."
REASON_UNKNOWN = "License could not be verified; candidate is not ingested automatically."
REASON_REJECTED = "License is incompatible with the requested use."

# Patterns kept to what both Java and RE2 read the same way.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "card": r"\b[0-9]{16}\b",
}
# A character or phrase in every match; a text without it is not searched.
PII_MARKS = {"email": "@", "phone": " (", "ipv4": "."}
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def resolve_license(*names: Column) -> Column:
    """First non-empty name in lower case, else ``unknown``."""
    return F.lower(F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit("unknown")))


def license_decision(df: DataFrame, license_name: Column, intended_use: str = "commercial") -> DataFrame:
    """Adds license, compatible, status and reason; the policy is a fixed short list."""
    name = F.col("license")
    permissive = name.isin(*PERMISSIVE_LICENSES)
    research = name.isin(*RESEARCH_ONLY_LICENSES) & F.lit(intended_use != "commercial")
    unknown = name == "unknown"
    return df.withColumn("license", license_name).select(
        "*",
        (permissive | research).alias("compatible"),
        F.when(permissive | research, "APPROVED").when(unknown, "UNKNOWN").otherwise("REJECTED").alias("status"),
        F.when(permissive, REASON_PERMISSIVE)
        .when(research, REASON_RESEARCH)
        .when(unknown, REASON_UNKNOWN)
        .otherwise(REASON_REJECTED)
        .alias("reason"),
    )


def license_verdict(decisions: DataFrame, group: str, candidate: str, order: str) -> DataFrame:
    """Did any candidate of a request pass, and which approved one comes first?"""
    ok = F.col("compatible")
    return decisions.groupBy(group).agg(
        F.when(F.count_if(ok) > 0, "passed").otherwise("rejected").alias("license_verdict"),
        F.count_if(ok).alias("approved"),
        F.count(F.lit(1)).alias("candidates"),
        F.min_by(F.when(ok, F.col(candidate)), F.when(ok, F.col(order))).alias("selected"),
    )


def _unmarked(text: Column, kind: str) -> Column:
    """The text surely has no match of this kind; null for a null text."""
    return ~text.contains(PII_MARKS[kind]) if kind in PII_MARKS else F.lit(False)


def pii_counts(text: Column) -> dict[str, Column]:
    return {
        kind: F.when(_unmarked(text, kind), 0).otherwise(F.regexp_count(text, F.lit(p)))
        for kind, p in PII_PATTERNS.items()
    }


def mask_pii(text: Column) -> Column:
    masked = text
    for kind, pattern in PII_PATTERNS.items():
        # No mask has or joins up such a mark, so the given text tells it.
        masked = F.when(_unmarked(text, kind), masked).otherwise(F.regexp_replace(masked, pattern, f"[{kind}]"))
    return masked


def normalize_email(value: Column) -> Column:
    return F.lower(F.trim(value))


def is_email(value: Column) -> Column:
    return F.coalesce(normalize_email(value).rlike(EMAIL_SHAPE), F.lit(False))


def toxicity_gate(df: DataFrame, dataset: str, toxic: str, ceiling: float) -> DataFrame:
    """PASS when the share of toxic rows among the judged ones stays under the ceiling."""
    rate = F.coalesce(
        F.try_divide(F.sum(F.col(toxic).cast("double")), F.count(toxic)), F.lit(0.0)
    )
    return df.groupBy(dataset).agg(
        F.count(toxic).alias("judged"),
        F.bround(rate, 4).alias("toxic_rate"),
        F.when(rate <= ceiling, "PASS").otherwise("FAIL").alias("critical_toxicity"),
    )


def apply_gates(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds ``failed_gates`` (comma list) and ``passed``; ``checks`` holds what must be true.

    Gates run before any scoring: score only rows with ``passed`` and write the others,
    with their reasons, to the audit table.
    """
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    )
    return df.withColumn("failed_gates", F.array_join(failed, ",")).withColumn(
        "passed", F.col("failed_gates") == ""
    )


def audit_rejections(gated: DataFrame, columns: list[str]) -> DataFrame:
    """One row per rejected record and failed gate."""
    return gated.where(~F.col("passed")).select(
        *columns, F.explode(F.split("failed_gates", ",")).alias("gate")
    )


def certification(score: Column, gates_pass: Column, audit_trail: Column) -> Column:
    """Highest certificate a dataset earns, null without one."""
    return (
        F.when(gates_pass & audit_trail & (score >= 98), "Enterprise Ready")
        .when(gates_pass & (score >= 95), "Research Ready")
        .when(gates_pass & (score >= 90), "Production Ready")
    )
