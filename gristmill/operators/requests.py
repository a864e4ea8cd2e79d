"""Request triage, field roles, and rows and verdicts read out of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as tx

# Keywords looked for in a request.
LANGUAGES = ("english", "hindi", "spanish", "french", "german")
DOMAINS = ("healthcare", "legal", "finance", "education", "code")
GENERATION_MARKERS = ["synthetic", "generate", "gap", "rare", "edge case", "no existing"]
SEARCH_MARKERS = ["search only", "find datasets", "discover datasets", "candidate datasets"]
CLEANING_MARKERS = ["clean only", "cleaning only", "clean dataset", "remove duplicates"]
QUESTIONS = {
    "domain": "Which domain should the dataset target?",
    "languages": "Which languages should be included?",
    "target_model": "Which target model should the dataset optimize for?",
}

# Accepted verdicts of a critique.
VERDICTS = ("accept", "revise", "reject")
PLACEHOLDER_CHUNK = 100_000
JSON_SPAN = r"(?s)(\[.*\]|\{.*\})"


def triage(requests: DataFrame, text: str, domain: str | None = None, languages: str | None = None,
           target_model: str | None = None) -> DataFrame:
    """Domain, languages and flags of a request by keyword, and the questions still open.

    ``domain``, ``languages`` and ``target_model`` name columns with values given besides the
    text; what neither text nor column supplies is asked for.
    """
    lowered = F.lower(tx.strip(F.coalesce(F.col(text), F.lit(""))))

    def named(words: tuple[str, ...]) -> Column:
        return F.array_compact(F.array(*[F.when(lowered.contains(w), w) for w in words]))

    def given(name: str | None) -> Column:
        return tx.blank_to_null(F.col(name)) if name else F.lit(None).cast("string")

    found_domain = F.coalesce(F.get(named(DOMAINS), 0), given(domain))
    found_languages = F.coalesce(F.nullif(F.array_join(named(LANGUAGES), ","), F.lit("")), given(languages))
    missing = F.array_compact(
        F.array(
            F.when(found_domain.isNull(), QUESTIONS["domain"]),
            F.when(found_languages.isNull(), QUESTIONS["languages"]),
            F.when(given(target_model).isNull(), QUESTIONS["target_model"]),
        )
    )
    return requests.select(
        "*",
        F.coalesce(found_domain, F.lit("general")).alias("found_domain"),
        F.coalesce(found_languages, F.lit("english")).alias("found_languages"),
        tx.any_word_in(lowered, GENERATION_MARKERS).alias("requires_generation"),
        tx.any_word_in(lowered, SEARCH_MARKERS).alias("search_only"),
        tx.any_word_in(lowered, CLEANING_MARKERS).alias("cleaning_only"),
        F.array_join(missing, " ").alias("questions"),
    )


def field_role(name: Column) -> Column:
    """Role of a field by its name; the first rule that fits decides."""
    n = F.lower(name)
    return (
        F.when(n.isin("id", "uuid", "index") | n.endswith("_id"), "identifier")
        .when(n.contains("instruction") | n.contains("prompt") | n.contains("question"), "instruction")
        .when(n.contains("response") | n.contains("answer") | n.contains("completion") | n.contains("output"), "response")
        .when(n.isin("label", "target", "class", "category", "sentiment") | n.endswith("_label"), "label/target")
        .when(n.contains("date") | n.contains("time") | n.contains("year"), "temporal")
        .when(n.contains("lang"), "language")
        .otherwise("text")
    )


def training_task(fields: DataFrame, dataset: str, field: str) -> DataFrame:
    """Most likely training task of each dataset from the roles of its fields."""
    roles = fields.groupBy(dataset).agg(F.collect_set(field_role(F.col(field))).alias("roles"))
    has = lambda r: F.array_contains("roles", r)
    return roles.select(
        dataset,
        F.array_join(F.array_sort("roles"), ", ").alias("roles"),
        F.when(has("instruction") & has("response"), "instruction tuning (supervised fine-tuning)")
        .when(has("label/target"), "supervised classification or regression")
        .when(has("text") | has("instruction"), "language modeling, embeddings, or retrieval")
        .otherwise("exploratory analysis")
        .alias("task"),
    )


def embedded_json(text: Column) -> Column:
    """JSON of an answer: the whole text, else the widest bracketed span in it; null if neither parses."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(F.regexp_extract(text, JSON_SPAN, 1), F.lit(""))))


def answer_rows(answers: DataFrame, answer_id: str, text: str, fields: list[str], count: int) -> DataFrame:
    """Rows of answers that are JSON lists: objects with all ``fields``, at most ``count`` each."""
    parsed = answers.select(answer_id, embedded_json(F.col(text)).alias("doc"))
    is_list = F.coalesce(F.schema_of_variant("doc").startswith("ARRAY"), F.lit(False))
    items = parsed.where(is_list).select(answer_id, F.posexplode(F.col("doc").cast("array<variant>")).alias("at", "item"))
    is_object = F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False))
    keys = F.map_keys(F.when(is_object, F.col("item")).cast("map<string,variant>"))
    complete = F.size(F.array_except(F.array(*[F.lit(f) for f in fields]), keys)) == 0
    good = items.where(is_object).where(complete)
    rank = F.row_number().over(Window.partitionBy(answer_id).orderBy("at"))
    return (
        good.withColumn("row_number", rank)
        .where(F.col("row_number") <= count)
        .select(answer_id, "row_number", *[F.try_variant_get("item", f"$.{f}", "string").alias(f) for f in fields])
    )


def answer_verdicts(answers: DataFrame, answer_id: str, text: str) -> DataFrame:
    """Verdict, score and issues of critiques; others are left out."""
    parsed = answers.select(answer_id, embedded_json(F.col(text)).alias("doc"))
    is_object = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    verdict = F.try_variant_get("doc", "$.verdict", "string")
    issues = F.try_variant_get("doc", "$.issues", "array<string>")
    return (
        parsed.where(is_object)
        .select(
            answer_id,
            verdict.alias("verdict"),
            F.coalesce(F.try_variant_get("doc", "$.score", "int"), F.lit(0)).alias("score"),
            F.coalesce(F.size(issues), F.lit(0)).alias("n_issues"),
        )
        .where(F.col("verdict").isin(*VERDICTS))
    )


def placeholder_rows(needs: DataFrame, dataset: str, missing: str, fields: list[str], topic: Column) -> DataFrame:
    """Tagged synthetic rows to fill each dataset's gap (``missing`` rows, from 0).

    A gap is cut into chunks that are spread before they are filled, so that one dataset
    lacking very many rows is not generated by one task.
    """
    gaps = needs.where(F.col(missing) > 0).select(dataset, F.col(missing).alias("_n"), topic.alias("_topic"))
    last_chunk = F.floor((F.col("_n") - 1) / PLACEHOLDER_CHUNK).cast("int")
    chunks = gaps.select("*", F.explode(F.sequence(F.lit(0), last_chunk)).alias("_chunk")).repartition(dataset, "_chunk")
    start = F.col("_chunk").cast("long") * PLACEHOLDER_CHUNK
    numbered = chunks.select(
        dataset, "_topic", F.explode(F.sequence(start, F.least(F.col("_n").cast("long"), start + PLACEHOLDER_CHUNK) - 1)).alias("_i")
    )
    return numbered.select(
        dataset,
        F.col("_i").alias("row_number"),
        *[
            F.concat(F.lit(f"[deterministic] {f} #"), F.col("_i").cast("string"), F.lit(" about "), "_topic").alias(f)
            for f in fields
        ],
        F.lit(True).alias("synthetic"),
    )
