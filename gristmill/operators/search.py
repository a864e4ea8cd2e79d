"""Ranking a dataset catalog and public candidates against a table of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.scratch import Scratch

# One-hop synonyms used for the semantic vectors.
VECTOR_SYNONYMS = {
    "accident": ("crash", "collision", "incident"),
    "accidents": ("crashes", "collisions", "incidents"),
    "traffic": ("road", "vehicle", "transport"),
    "diabetes": ("glucose", "insulin", "bmi", "outcome"),
    "fraud": ("anomaly", "risk", "transaction"),
    "healthcare": ("medical", "clinical", "patient"),
    "crop": ("agriculture", "plant", "farm"),
}

# Synonyms used to expand search intent.
INTENT_SYNONYMS = {
    "qa": ("question", "answer", "question_answering"),
    "sentiment": ("polarity", "emotion", "opinion"),
    "medical": ("healthcare", "clinical", "biomedical"),
    "health": ("healthcare", "medical", "clinical"),
    "finance": ("financial", "fintech", "market"),
    "legal": ("law", "contract", "judicial"),
    "image": ("vision", "visual", "picture"),
    "speech": ("audio", "voice", "asr"),
    "code": ("programming", "source", "software"),
    "chat": ("dialogue", "conversation", "instruction"),
}

# Words that hint at a domain; earlier domains win ties.
DOMAIN_HINTS = {
    "healthcare": ("medical", "health", "clinical", "diabetes", "patient", "healthcare"),
    "finance": ("finance", "financial", "market", "stock", "fintech", "bank"),
    "legal": ("legal", "law", "contract", "court", "judicial"),
    "climate": ("climate", "weather", "rainfall", "temperature", "emissions"),
    "mobility": ("traffic", "accident", "accidents", "transport", "mobility", "vehicle"),
    "nlp": ("chat", "qa", "sentiment", "instruction", "dialogue", "text"),
}
RECENCY_WORDS = ("recent", "latest", "2024", "2025")

# Words dropped from broadened queries, and from the one-word domain hint.
VARIANT_STOP_WORDS = (
    "find", "show", "get", "dataset", "datasets", "data", "for", "with", "and", "the",
)
HINT_STOP_WORDS = ("find", "dataset", "datasets", "for", "the", "with")

# Search intensities.
INTENSITIES = (
    ("easy", 5, 1, 1, "Easy", "single-provider quick lookup"),
    ("medium", 12, 2, 1, "Medium", "balanced multi-provider lookup"),
    ("hard", 25, 3, 2, "Hard", "multi-provider lookup plus broad query pass"),
    ("very_hard", 50, 4, 3, "Very Hard", "deep lookup with broad and dataset-focused query passes"),
    ("intense", 100, 4, 4, "Intense", "exhaustive lookup with multiple broadened query passes"),
)
DEFAULT_INTENSITY = "medium"

# Weights of the record score and of the public-candidate score.
RECORD_WEIGHTS = {"relevance": 0.5, "quality": 0.2, "completeness": 0.15, "credibility": 0.1, "freshness": 0.05}
LOCAL_CREDIBILITY, OTHER_CREDIBILITY = 0.9, 0.75
PUBLIC_WEIGHTS = {"relevance": 0.55, "popularity": 0.20, "metadata": 0.15, "provider": 0.10}
METADATA_WEIGHTS = {"description": 0.4, "tags": 0.3, "url": 0.3}
PROVIDER_WEIGHTS = {"huggingface": 0.9, "kaggle": 0.85, "data.gov": 0.8}
OTHER_PROVIDER_WEIGHT = 0.7
FULL_POPULARITY = 5000
# Rows of query terms that go to every task at a time, some 10 MB.
BLOCK_TERMS = 100_000
# Shared terms of queries and records that a task sums up.
TASK_MATCHES = 1 << 18


def _strings(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _synonym_map(synonyms: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), _strings(v))])


def with_synonyms(tokens: Column, synonyms: dict[str, tuple[str, ...]]) -> Column:
    """Tokens in order, each followed by its synonyms."""
    table = _synonym_map(synonyms)
    none = F.array().cast("array<string>")
    return F.flatten(
        F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), none)))
    )


def term_vectors(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf) of the tokens with synonyms."""
    terms = with_synonyms(tx.token_bag(text), VECTOR_SYNONYMS)
    return (
        df.select(key, F.explode(terms).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).cast("double").alias("tf"))
    )


def query_blocks(terms: DataFrame, query: str) -> list[DataFrame]:
    """Query terms in blocks of whole queries small enough to go to every task.

    A block has about ``BLOCK_TERMS`` rows; each block is a pass over the other side, which
    thus is never shuffled by term.
    """
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    block = F.pmod(F.xxhash64(query), F.lit(blocks))
    return [F.broadcast(terms.where(block == n)) for n in range(blocks)]


def cosine_top_k(left: DataFrame, left_key: str, right: DataFrame, right_key: str, k: int) -> DataFrame:
    """The ``k`` rows of ``right`` most similar to each of ``left``; only rows sharing a term count.

    Both are term vectors. ``right`` is placed by its key once; a pair then is summed up where
    its row lies, and each task puts out at most ``k`` rows per query. There are so many tasks
    that each sums up about ``TASK_MATCHES`` shared terms.
    """
    right = Scratch(right.sparkSession, "top-k").keep(right, "vectors")
    often = [side.groupBy("term").agg(F.count(F.lit(1)).alias(n)) for side, n in ((left, "n_left"), (right, "n_right"))]
    matches = often[0].join(often[1], "term").agg(F.sum(F.col("n_left") * F.col("n_right"))).first()[0] or 0

    def normed(vectors: DataFrame, key: str, tf: str, norm: str) -> DataFrame:
        total = F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(key))
        return vectors.select(key, "term", F.col("tf").alias(tf), F.sqrt(total).alias(norm))

    placed = normed(right.repartition(1 + matches // TASK_MATCHES, right_key), right_key, "r", "rn")
    found = [
        placed.join(block, "term")
        .groupBy(left_key, right_key)
        .agg(F.sum(F.col("l") * F.col("r")).alias("dot"), F.max("ln").alias("ln"), F.max("rn").alias("rn"))
        .select(left_key, right_key, F.bround(F.col("dot") / (F.col("ln") * F.col("rn")), 6).alias("cosine"))
        for block in query_blocks(normed(left, left_key, "l", "ln"), left_key)
    ]
    best = [top_k(pairs, [left_key], [F.desc("cosine"), F.asc(right_key)], k) for pairs in found]
    return reduce(DataFrame.union, best)


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; each task forwards at most ``k`` rows per group."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(
        F.col(rank) <= k
    )


def semantic_top_k(queries: DataFrame, query: str, text: str, docs: DataFrame, doc: str, doc_text: str, k: int) -> DataFrame:
    """The ``k`` documents most similar to each query."""
    return cosine_top_k(
        term_vectors(queries, query, F.col(text)), query, term_vectors(docs, doc, F.col(doc_text)), doc, k
    )


def _record_texts() -> tuple[Column, Column]:
    tags, names = F.array_join("tags", " "), F.array_join("columns", " ")
    lexical = F.concat_ws(" ", "title", "filename", "description", tags, names)
    semantic = F.concat_ws(" ", "title", "description", "ai_summary", tags, names)
    return lexical, semantic


def _sides(df: DataFrame, key: str, lexical: Column, semantic: Column, *carried: str) -> DataFrame:
    """(key, term, sem, lex, norm): frequency in the semantic vector, lexical or not, vector length.

    ``key`` identifies a row of ``df``. The rows are placed by key once, before their texts
    are cut up; counting terms and the vector length then need no further shuffle.
    ``carried`` columns ride along.
    """
    entry = F.concat(
        F.transform(with_synonyms(semantic, VECTOR_SYNONYMS), lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("sem"), F.lit(0).alias("lex"))),
        F.transform(lexical, lambda t: F.struct(t.alias("term"), F.lit(0.0).alias("sem"), F.lit(1).alias("lex"))),
    )
    length = F.sqrt(F.sum(F.col("sem") * F.col("sem")).over(Window.partitionBy(key)))
    return (
        df.repartition(key)
        .select(key, *carried, F.explode(entry).alias("e"))
        .select(key, *carried, "e.*")
        .groupBy(key, *carried, "term")
        .agg(F.sum("sem").alias("sem"), F.max("lex").alias("lex"))
        .withColumn("norm", length)
    )


def record_score(relevance: Column, quality: Column, missing_ratio: Column, provider: Column) -> Column:
    w = RECORD_WEIGHTS
    credibility = F.when(provider == "local", LOCAL_CREDIBILITY).otherwise(OTHER_CREDIBILITY)
    return F.bround(
        relevance * w["relevance"]
        + F.coalesce(quality, F.lit(0)) / 100 * w["quality"]
        + (1.0 - F.coalesce(missing_ratio, F.lit(0.0))) * w["completeness"]
        + credibility * w["credibility"]
        + F.lit(1.0) * w["freshness"],
        4,
    )


def catalog_search(
    queries: DataFrame,
    catalog: DataFrame,
    k: int = 10,
    min_relevance: float | None = None,
) -> DataFrame:
    """The ``k`` best catalog records for each query.

    ``queries`` has ``query_id`` and ``query``; ``catalog`` has ``dataset_id, title, filename,
    description, ai_summary, tags, columns, quality_score, missing_ratio, provider``.

    Only pairs sharing a term are joined. A record matching nothing scores by its own merits
    alone, so the ``k`` best records by merit complete every query exactly. ``min_relevance``
    drops weaker matches and, when positive, all records without a match.
    """
    merits = ["quality_score", "missing_ratio", "provider"]
    asked = queries.select("query_id", tx.token_set(F.col("query")).alias("_tokens")).withColumn(
        "n_tokens", F.size("_tokens")
    )
    query_terms = _sides(asked, "query_id", F.col("_tokens"), F.array_sort("_tokens"), "n_tokens")
    lexical, semantic = _record_texts()
    record_terms = _sides(catalog, "dataset_id", tx.token_set(lexical), tx.token_bag(semantic), *merits)
    records = record_terms.select(
        "dataset_id", *merits, "term", F.col("sem").alias("rs"), F.col("lex").alias("rl"), F.col("norm").alias("rn")
    )
    asked_terms = query_terms.select(
        "query_id", "n_tokens", "term", F.col("sem").alias("qs"), F.col("lex").alias("ql"), F.col("norm").alias("qn")
    )
    found = [_matched(records.join(block, "term"), merits, k, min_relevance) for block in query_blocks(asked_terms, "query_id")]
    # The best records by merit, as one short array; each query gets them as records without a match.
    merit = record_score(F.lit(0.0), *[F.col(c) for c in merits])
    best = catalog.select("dataset_id", *merits, merit.alias("_merit")).orderBy(F.desc("_merit"), "dataset_id").limit(k)
    best_list = best.agg(F.collect_list(F.struct("dataset_id", *merits))).scalar()
    fillers = asked.select("query_id", "n_tokens", F.explode(best_list).alias("b")).select(
        "query_id", "n_tokens", "b.*", F.lit(0.0).alias("semantic"), F.lit(0).alias("common"), F.lit("").alias("matched_terms")
    )
    scored = reduce(DataFrame.unionByName, [*found, _scored(fillers, merits, min_relevance)])
    # A record can be here with and without its match; the match scores no less.
    once = top_k(scored, ["query_id", "dataset_id"], [F.desc("relevance_score"), F.desc("semantic_relevance"), F.desc("matched_terms")], 1, "_same")
    return top_k(once.drop("_same"), ["query_id"], [F.desc("relevance_score"), F.asc("dataset_id")], k)


def _matched(shared: DataFrame, merits: list[str], k: int, min_relevance: float | None) -> DataFrame:
    """The ``k`` best matches per query of a block; pairs are summed up where their record lies."""
    both = F.col("ql") * F.col("rl")
    pairs = shared.groupBy("query_id", "n_tokens", "dataset_id", *merits).agg(
        F.coalesce(F.try_divide(F.sum(F.col("qs") * F.col("rs")), F.max(F.col("qn") * F.col("rn"))), F.lit(0.0)).alias("semantic"),
        F.sum(both).alias("common"),
        # At most one entry per query token.
        F.array_join(F.array_sort(F.collect_set(F.when(both == 1, F.col("term")))), ", ").alias("matched_terms"),
    )
    scored = _scored(pairs, merits, min_relevance)
    return top_k(scored, ["query_id"], [F.desc("relevance_score"), F.asc("dataset_id")], k, "_best").drop("_best")


def _scored(pairs: DataFrame, merits: list[str], min_relevance: float | None) -> DataFrame:
    lexical = F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.try_divide("common", "n_tokens"))
    candidates = pairs.withColumn("lexical", lexical)
    relevance = F.greatest("lexical", "semantic")
    if min_relevance is not None:
        candidates = candidates.where(relevance >= min_relevance)
    return candidates.select(
        "query_id",
        "dataset_id",
        record_score(relevance, *[F.col(c) for c in merits]).alias("relevance_score"),
        F.bround("semantic", 4).alias("semantic_relevance"),
        F.bround("lexical", 4).alias("lexical_relevance"),
        "matched_terms",
    )


def public_score(query: Column, title: Column, description: Column, tags: Column, url: Column, downloads: Column, provider: Column) -> Column:
    """Score of a public candidate for the query it was found with."""
    asked = tx.token_set(query)
    searchable = tx.token_set(F.concat_ws(" ", title, description, F.array_join(tags, " ")))
    overlap = F.size(F.array_intersect(asked, searchable))
    weight = F.lit(OTHER_PROVIDER_WEIGHT)
    for name, value in PROVIDER_WEIGHTS.items():
        weight = F.when(F.lower(provider) == name, value).otherwise(weight)
    metadata = (
        F.when(F.coalesce(description, F.lit("")) != "", METADATA_WEIGHTS["description"]).otherwise(0.0)
        + F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, METADATA_WEIGHTS["tags"]).otherwise(0.0)
        + F.when(F.coalesce(url, F.lit("")) != "", METADATA_WEIGHTS["url"]).otherwise(0.0)
    )
    w = PUBLIC_WEIGHTS
    return F.least(
        F.lit(1.0),
        overlap / F.greatest(F.lit(1), F.size(asked)) * w["relevance"]
        + F.least(F.lit(1.0), F.coalesce(downloads, F.lit(0)) / FULL_POPULARITY) * w["popularity"]
        + metadata * w["metadata"]
        + weight * w["provider"],
    )


def first_seen(candidates: DataFrame, group: list[str], url: str, order: list[str]) -> DataFrame:
    """One candidate per URL: the one seen first in provider, query and result order."""
    ranked = top_k(candidates, [*group, url], [F.asc(c) for c in order], 1, "_seen")
    return ranked.drop("_seen")


def public_ranking(candidates: DataFrame, limit: int) -> DataFrame:
    """Candidates of each query: cut to ``limit`` by downloads first, then scored."""
    cut = top_k(candidates, ["query_id"], [F.desc("downloads"), F.asc("seen_order")], limit, "_cut").drop("_cut")
    return cut.withColumn(
        "discovery_score",
        F.bround(
            public_score(*[F.col(c) for c in ("query", "title", "description", "tags", "url", "downloads", "provider")]), 6
        ),
    )


def unified_ranking(local: DataFrame, public: DataFrame, limit: int) -> DataFrame:
    """Local and public results of each query in one list."""
    merged = local.unionByName(public, allowMissingColumns=True)
    score = F.coalesce("relevance_score", "discovery_score", F.lit(0.0))
    return top_k(
        merged.withColumn("score", score), ["query_id"], [F.desc("score"), F.asc("result_type"), F.asc("dataset_id")], limit
    )


def search_status(include_public: Column, enabled: Column, returned: Column, public_count: Column, warnings: Column) -> Column:
    """Outcome of a search from its counts."""
    plain = F.when(returned > 0, "complete").otherwise("empty")
    return (
        F.when(~include_public, plain)
        .when(~enabled, F.when(returned > 0, "partial").otherwise("disabled"))
        .when((warnings > 0) & (public_count == 0) & (returned == 0), "failed")
        .when(warnings > 0, "partial")
        .otherwise(plain)
    )


def resolve_intensity(name: Column) -> Column:
    key = F.regexp_replace(F.lower(tx.strip(F.coalesce(name, F.lit("")))), "[ -]", "_")
    return F.when(key.isin(*[i[0] for i in INTENSITIES]), key).otherwise(DEFAULT_INTENSITY)


def intensity_profile(name: Column) -> Column:
    """Limit, providers, passes, label and strategy of a (free-form) intensity name."""
    table = F.create_map(
        *[
            x
            for key, limit, providers, passes, label, strategy in INTENSITIES
            for x in (
                F.lit(key),
                F.struct(
                    F.lit(key).alias("intensity"),
                    F.lit(limit).alias("result_limit"),
                    F.lit(providers).alias("providers"),
                    F.lit(passes).alias("query_passes"),
                    F.lit(label).alias("label"),
                    F.lit(strategy).alias("strategy"),
                ),
            )
        ]
    )
    return table[resolve_intensity(name)]


def _without(tokens: Column, stop: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stop))


def query_variants(query: Column, passes: Column) -> Column:
    """Progressively broader forms of a query, distinct regardless of case, at most ``passes``."""
    normalized = tx.collapse_whitespace(F.coalesce(query, F.lit("")))

    def build(tokens: Column) -> Column:
        n = F.size(tokens)
        joined = F.array_join(tokens, " ")
        return F.array_compact(
            F.array(
                normalized,
                F.when(n > 0, joined),
                F.when(n > 0, F.concat(joined, F.lit(" dataset"))),
                F.when(n > 2, F.array_join(F.slice(tokens, 1, 2), " ")),
                F.when(n > 0, F.get(tokens, 0)),
            )
        )

    def distinct(variants: Column) -> Column:
        lowered = F.transform(variants, F.lower)
        return F.filter(variants, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)

    tokens = F.array(_without(tx.alnum_runs(normalized), VARIANT_STOP_WORDS))
    variants = F.transform(tokens, build)
    unique = F.element_at(F.transform(variants, distinct), 1)
    return F.when(normalized == "", F.array(F.lit(""))).otherwise(
        F.slice(unique, F.lit(1), F.greatest(F.lit(1), passes))
    )


def domain_hint(query: Column) -> Column:
    """First token that is not a filler word."""
    return F.coalesce(F.get(_without(tx.alnum_runs(query), HINT_STOP_WORDS), 0), F.lit("general"))


def guess_domain(tokens: Column) -> Column:
    """Domain with the most hint words among the tokens; the earlier one wins a tie."""
    best, best_overlap = F.lit("general"), F.lit(0)
    for domain, hints in DOMAIN_HINTS.items():
        overlap = F.size(F.array_intersect(tokens, _strings(hints)))
        best = F.when(overlap > best_overlap, domain).otherwise(best)
        best_overlap = F.greatest(overlap, best_overlap)
    return best


def search_intent(df: DataFrame, query: str) -> DataFrame:
    """Expanded terms, domain and filters of each query, and the sentence about them."""
    tokens = tx.alnum_runs(F.col(query))
    terms = F.array_sort(F.array_distinct(with_synonyms(tokens, INTENT_SYNONYMS)))
    staged = df.select("*", tokens.alias("_tokens"), F.array_join(terms, ", ").alias("terms"))
    staged = staged.withColumn("domain", guess_domain(F.col("_tokens")))
    filters = F.array_compact(
        F.array(
            F.when(F.arrays_overlap("_tokens", _strings(RECENCY_WORDS)), "freshness=recent"),
            F.when(F.col("domain") != "general", F.concat(F.lit("domain="), "domain")),
        )
    )
    staged = staged.withColumn("filters", F.array_join(filters, ", "))
    sentence = F.concat(
        F.lit("Normalized intent terms: "), "terms", F.lit(". Likely domain: "), "domain",
        F.lit(". Suggested filters: "), F.when(F.col("filters") == "", "none").otherwise(F.col("filters")), F.lit("."),
    )
    blank = tx.blank_to_null(F.col(query)).isNull()
    return staged.withColumn(
        "intent", F.when(blank, "Empty query; provide search terms to expand intent.").otherwise(sentence)
    ).drop("_tokens")
