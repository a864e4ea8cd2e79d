"""Seven quality dimensions, weighted score, report, bias, readiness and validation.

A null counts as missing: it fails completeness and is not a clean value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as tx

# Field names that make a dataset a pair or single-text dataset.
FIELD_PAIRS = (
    ("instruction", "response"),
    ("prompt", "completion"),
    ("question", "answer"),
    ("input", "output"),
)
SINGLE_TEXT_FIELDS = ("text", "content", "document")

# Limits, base compatibility by structure, weights and thresholds.
MAX_TOKENS = 2048
READABLE_WORDS = (2, 400)
BASE_COMPATIBILITY = {"pair": 0.85, "single": 0.70, "none": 0.40}
WEIGHTS = {
    "completeness": 20,
    "consistency": 20,
    "diversity": 15,
    "duplicate_ratio": 15,
    "formatting": 10,
    "readability": 10,
    "model_compatibility": 10,
}
PROFILE_THRESHOLDS = {
    "fast": 70,
    "balanced": 80,
    "production": 90,
    "research": 95,
    "enterprise": 98,
}
PASS_SCORE = 90

DIMENSIONS = tuple(WEIGHTS)


def detect_structure(columns: Sequence[str]) -> tuple[str, tuple[str, ...]]:
    """Structure and text fields of a typed table, decided from its column names."""
    present = set(columns)
    for pair in FIELD_PAIRS:
        if present.issuperset(pair):
            return "pair", pair
    for field in SINGLE_TEXT_FIELDS:
        if field in present:
            return "single", (field,)
    return "none", ()


def _weighted(prefix: str = "") -> Column:
    total = None
    for name, weight in WEIGHTS.items():
        term = F.col(prefix + name) * F.lit(weight)
        total = term if total is None else total + term
    return total


@dataclass(frozen=True)
class Layout:
    """How a dataset's columns are read: structure, text fields and value columns."""

    kind: str
    fields: tuple[str, ...]
    columns: tuple[str, ...]

    @classmethod
    def of(cls, columns: Sequence[str]) -> Layout:
        kind, fields = detect_structure(columns)
        return cls(kind, fields, tuple(columns))

    def text(self) -> Column:
        if self.fields:
            return tx.strip(F.concat_ws(" ", *[F.col(f).cast("string") for f in self.fields]))
        return F.to_json(F.struct(*sorted(self.columns)), {"ignoreNullFields": "false"})


def row_measures(layout: Layout) -> list[Column]:
    """What scoring needs of each row, a few bytes in place of its texts."""
    whole = layout.text()
    complete = F.lit(bool(layout.fields))
    for field in layout.fields:
        complete = complete & tx.blank_to_null(F.col(field).cast("string")).isNotNull()
    clean = sum((tx.is_clean_value(F.col(c).cast("string")).cast("long") for c in layout.columns), F.lit(0))
    return [
        F.sha2(whole, 256).alias("_text_key"),
        complete.cast("long").alias("_complete"),
        clean.alias("_clean"),
        tx.word_count(whole).alias("_words"),
    ]


def metrics_from_measures(
    measures: DataFrame,
    dataset: str,
    layout: Layout | None,
    key_set: str | None = None,
    row_id: str | None = None,
    scorers: Mapping[str, str] | None = None,
) -> DataFrame:
    """Dimensions from rows that carry ``row_measures``; see ``quality_metrics``.

    Without a layout each row also carries its number of values (``_values``) and its dataset's
    structure (``_kind``) and base compatibility (``_base``).
    """
    scorers = dict(scorers or {})
    given = {"_kind": "kind", "_base": "base"} if layout is None else {}
    keys = F.sha2(F.col(key_set).cast("string"), 256) if key_set else F.lit("")
    rows = measures.withColumn("_keys", keys).withColumn("_row", F.col(row_id) if row_id else F.lit(0))
    sums = ["n", "complete", "clean", "readable", "over", *[f"own_{d}" for d in scorers], *(["values"] if given else [])]
    carried = [F.max(c).alias(c) for c in given.values()]
    # First by (dataset, text, field set): a dataset holding most of the rows spreads over its texts.
    grouped = rows.groupBy(dataset, "_text_key", "_keys").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_row").alias("first_row"),
        F.sum("_complete").alias("complete"),
        F.sum("_clean").alias("clean"),
        F.sum(F.col("_words").between(*READABLE_WORDS).cast("long")).alias("readable"),
        F.sum((tx.approx_tokens(F.col("_words")) > MAX_TOKENS).cast("long")).alias("over"),
        F.max("_words").alias("max_words"),
        *[F.sum(c).alias(f"own_{d}") for d, c in scorers.items()],
        *([F.sum("_values").alias("values")] if given else []),
        *[F.max(c).alias(a) for c, a in given.items()],
    )
    if key_set:
        by_keys = grouped.groupBy(dataset, "_keys").agg(
            F.sum("n").alias("n"), F.min("first_row").alias("first_row")
        )
        same_keys = by_keys.groupBy(dataset).agg(F.min_by("n", "first_row").alias("same_keys"))
        # A text seen under two field sets is still one text.
        grouped = grouped.groupBy(dataset, "_text_key").agg(
            *[F.sum(c).alias(c) for c in sums], F.max("max_words").alias("max_words"), *carried
        )
    totals = grouped.groupBy(dataset).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.count(F.lit(1)).alias("texts"),
        F.max("max_words").alias("max_words"),
        *carried,
    )
    totals = totals.join(same_keys, dataset) if key_set else totals.withColumn("same_keys", F.col("n"))
    n = F.col("n")
    if layout is None:
        values, base, structured = F.col("values"), F.col("base"), F.col("kind") != "none"
    else:
        values = n * F.lit(len(layout.columns))
        base, structured = F.lit(BASE_COMPATIBILITY[layout.kind]), F.lit(bool(layout.fields))
    raw = {
        "completeness": F.col("complete") / n,
        "consistency": F.col("same_keys") / n,
        "diversity": F.col("texts") / n,
        "duplicate_ratio": F.col("texts") / n,
        # Rows without any value have nothing well formatted.
        "formatting": F.coalesce(F.try_divide(F.col("clean"), values), F.lit(0.0)),
        "readability": F.when(structured, F.col("readable") / n).otherwise(F.lit(0.0)),
        "model_compatibility": F.greatest(F.lit(0.0), base * (1 - F.col("over") / n)),
    }
    raw.update({d: F.col(f"own_{d}") / n for d in scorers})
    unrounded = totals.select(
        dataset,
        n.alias("row_count"),
        tx.approx_tokens(F.col("max_words")).alias("max_tokens"),
        *[raw[d].alias(d) for d in DIMENSIONS],
    )
    return unrounded.select(
        dataset,
        "row_count",
        "max_tokens",
        *[F.bround(F.col(d), 4).alias(d) for d in DIMENSIONS],
        F.bround(_weighted(), 2).alias("overall"),
    )


def quality_metrics(
    df: DataFrame,
    dataset: str,
    columns: Sequence[str] | None = None,
    key_set: str | None = None,
    row_id: str | None = None,
    scorers: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Dimensions in 0..1 and the overall 0..100 score per value of ``dataset``.

    ``key_set`` names a column with each row's own field set (ragged input); with it
    consistency is the share of rows whose field set equals that of the lowest ``row_id``.
    Typed tables have one field set by construction. ``scorers`` replaces dimensions by the
    mean of a caller's own per-row score in 0..1, for example a pandas UDF over the text.
    """
    skip = (dataset, key_set, row_id)
    layout = Layout.of([c for c in (columns or df.columns) if c not in skip])
    own = {d: f"_own_{d}" for d in scorers or {}}
    kept = [c for c in (dataset, key_set, row_id) if c]
    measures = df.select(
        *kept, *row_measures(layout), *[scorers[d].cast("double").alias(c) for d, c in own.items()]
    )
    return metrics_from_measures(measures, dataset, layout, key_set, row_id, own).drop("max_tokens")


def threshold_for(profile: str) -> int:
    return PROFILE_THRESHOLDS.get(profile, PROFILE_THRESHOLDS["production"])


def meets_tier(overall: Column, tier: str) -> Column:
    """Does the 0..100 score reach a named tier? Unknown tiers use the balanced one."""
    return overall >= PROFILE_THRESHOLDS.get(tier, PROFILE_THRESHOLDS["balanced"])


def quality_report(metrics: DataFrame, profile: str = "production") -> DataFrame:
    """Whole-number dimensions and score with the profile's threshold."""
    kept = [c for c in metrics.columns if c not in DIMENSIONS]
    scaled = metrics.select(
        *kept, *[F.bround(F.col(d) * 100).cast("int").alias(d) for d in DIMENSIONS]
    ).withColumn("score", F.bround(_weighted() / 100).cast("int"))
    limit = threshold_for(profile)
    return scaled.select(
        "*",
        F.lit(profile).alias("profile"),
        F.lit(limit).alias("threshold"),
        (F.col("score") < limit).alias("requires_generation"),
        F.when(F.col("score") >= PASS_SCORE, "PASS").otherwise("PARTIAL").alias("status"),
    )


def language_bias(df: DataFrame, dataset: str, language: str) -> DataFrame:
    """Distinct languages per dataset and the distribution risk (low up to three)."""
    pairs = df.select(
        dataset, F.coalesce(tx.blank_to_null(F.col(language)), F.lit("unknown")).alias("language")
    ).distinct()
    return pairs.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("n_languages"),
        F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("languages"),
        F.when(F.count(F.lit(1)) <= 3, "low").otherwise("medium").alias("distribution_risk"),
    )


def language_distribution(
    df: DataFrame, language: str, row_id: str, labels: DataFrame, toxic: str
) -> DataFrame:
    """Rows, share and mean toxicity per language; unlabelled rows count in the share only."""
    counted = (
        df.select(row_id, F.coalesce(F.col(language), F.lit("unknown")).alias("language"))
        .join(labels.select(row_id, toxic), row_id, "left")
        .groupBy("language")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count(toxic).alias("labelled"),
            F.sum(F.col(toxic).cast("long")).alias("toxic"),
        )
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return counted.select(
        "language",
        "row_count",
        "labelled",
        F.bround(F.col("row_count") / total, 4).alias("share"),
        F.bround(F.try_divide(F.col("toxic"), F.col("labelled")), 4).alias("toxic_rate"),
    )


def language_coverage(df: DataFrame, language: str, wanted: DataFrame) -> DataFrame:
    """For each wanted language (columns ``language``, ``needed``) the rows at hand and their share."""
    have = df.groupBy(F.col(language).alias("language")).agg(F.count(F.lit(1)).alias("have"))
    rows = F.coalesce(F.col("have"), F.lit(0))
    return wanted.join(have, "language", "left").select(
        "language",
        F.col("needed").cast("long").alias("needed"),
        rows.alias("row_count"),
        F.bround(F.least(F.lit(1.0), rows / F.col("needed")), 4).alias("coverage"),
        F.greatest(F.lit(0), F.col("needed") - rows).cast("long").alias("short_by"),
    )


def readiness(df: DataFrame, dataset: str, text: str) -> DataFrame:
    """Row count, parse and training readiness, and whether the longest text fits the model."""
    tokens = tx.approx_tokens(tx.word_count(F.col(text)))
    measured = df.select(dataset, F.col(text).isNotNull().alias("parsed"), tokens.alias("tokens"))
    return measured.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.when(F.count_if("parsed") > 0, "PASS").otherwise("FAIL").alias("schema_parse"),
        F.when(F.count_if("parsed") > 0, "PASS").otherwise("FAIL").alias("training_readiness"),
        F.max("tokens").alias("max_tokens"),
        F.when(F.max("tokens") <= MAX_TOKENS, "PASS").otherwise("FAIL").alias("token_length_fit"),
    )


def validation(datasets: DataFrame, dataset: str, rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Is there anything to export: records, or at least approved candidates?"""
    n_rows = rows.groupBy(dataset).agg(F.count(F.lit(1)).alias("record_count"))
    n_candidates = candidates.groupBy(dataset).agg(F.count(F.lit(1)).alias("candidate_count"))
    joined = (
        datasets.select(dataset)
        .join(n_rows, dataset, "left")
        .join(n_candidates, dataset, "left")
        .na.fill(0, ["record_count", "candidate_count"])
    )
    return joined.select(
        dataset,
        ((F.col("record_count") > 0) | (F.col("candidate_count") > 0)).alias("ready"),
        "record_count",
        "candidate_count",
        F.when(F.col("record_count") > 0, "dataset").otherwise("metadata").alias("mode"),
    )


def rule_verdict(df: DataFrame, dataset: str, columns: Sequence[str]) -> DataFrame:
    """Accept a dataset without empty fields, ask for revision otherwise."""
    empty = sum(
        ((F.col(c).isNull() | (F.col(c).cast("string") == "")).cast("long") for c in columns), F.lit(0)
    )
    counted = df.groupBy(dataset).agg(F.sum(empty).alias("empty_fields"))
    good = F.col("empty_fields") == 0
    return counted.select(
        dataset,
        "empty_fields",
        F.when(good, "accept").otherwise("revise").alias("verdict"),
        F.when(good, 90).otherwise(60).alias("score"),
        F.when(good, "")
        .otherwise(F.concat(F.col("empty_fields").cast("string"), F.lit(" empty field(s)")))
        .alias("issue"),
    )


def difficulty_band(score: Column) -> Column:
    """Band of a score given on 0..1 or 0..100, null when there is none."""
    percent = F.when((score > 0) & (score <= 1), score * 100).otherwise(score)
    percent = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(percent + 0.5).cast("double")))
    return (
        F.when(score.isNull(), None)
        .when(percent >= 90, "easy")
        .when(percent >= 75, "medium")
        .when(percent >= 55, "hard")
        .when(percent >= 35, "very_hard")
        .otherwise("intense")
    )


def embedding_dispersion(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean cosine distance to the group's centroid: topic spread of a dataset.

    The mean cosine is the mean of the unit vectors times the centroid over its length, so
    sums per component suffice: one aggregation, combined on the map side, for vectors of any
    length and a group of any size. The dispersion is null where a group's vectors differ in
    length, where a vector is null, empty or zero or holds a null, and where the centroid is zero.
    """
    wide = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    cells = df.select(
        group, wide.alias("_v"), F.when(length > 0, length).alias("_length"), F.posexplode_outer(wide).alias("_i", "_x")
    ).select(group, F.size("_v").alias("_size"), "_i", "_x", (F.col("_x") / F.col("_length")).alias("_unit"))
    sums = cells.groupBy(group, "_i").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("_unit").alias("_known"),
        F.avg("_x").alias("_mean"),
        F.avg("_unit").alias("_mean_unit"),
        F.max("_size").alias("_longest"),
    )
    whole = F.min(F.col("_n") == F.col("_known")) & (F.min("_n") == F.max("_n")) & F.min(F.col("_i").isNotNull())
    cosine = F.try_divide(
        F.sum(F.col("_mean_unit") * F.col("_mean")), F.sqrt(F.sum(F.col("_mean") * F.col("_mean")))
    )
    # A row of every vector is counted under its first component (or under null without any).
    rows = F.sum(F.when(F.coalesce("_i", F.lit(0)) == 0, F.col("_n")))
    return sums.groupBy(group).agg(
        rows.alias("row_count"), F.bround(F.when(whole, 1 - cosine), 6).alias("dispersion")
    )


def missing_languages(have: DataFrame, wanted: DataFrame, dataset: str, language: str) -> DataFrame:
    """(dataset, language) pairs that are wanted but not present."""
    present = have.select(dataset, F.lower(language).alias(language)).distinct()
    return wanted.select(dataset, F.lower(language).alias(language)).distinct().join(
        present, [dataset, language], "left_anti"
    )
