"""Registered queries of the subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import (
    best_fit,
    dart_minhash,
    decontaminate,
    license_scan,
    oracles,
    pii,
    quality,
    repetitions,
    spelling,
    token_count,
    token_output,
    toxicity,
    vector_search,
    warc,
)
from gristmill.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_decontamination", oracles.DECONTAMINATION)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(documents, "text", table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        decontaminate.items_digest("item_ids").alias("items_sha256"),
        "contaminated",
    )


@query("op1_dart_minhash")
def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = toxicity.held_out("doc_id", 5, 0)
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(documents.withColumn("held_out", held_out), model, drop=("text",))


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = toxicity.held_out("doc_id", 3, 1)
    model = quality.fit(documents, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(documents.withColumn("held_out", held_out), model, drop=("text",))


def tokenizer() -> str:
    """Place of the public tokenizer file that packing uses; every worker has it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), tokenizer())


@query("op10_token_output")
def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "packed-ids").folder
    return token_output.read_packed(
        token_output.write_packed(table(spark, sf_dir, "documents"), folder, tokenizer())
    )


@query("op7_warc", oracles.WARC)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "warc").folder
    warc.write_pages(table(spark, sf_dir, "pages"), folder)
    return warc.read_pages(spark, folder).drop("target_uri")


@query("op8_pii", oracles.pii())
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select(
        "doc_id",
        *[pii.count_of(kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")],
        F.sha2(pii.listed(pii.base_spans()), 256).alias("base_sha256"),
        pii.listed(F.col("pii")).alias("spans"),
    )


def document_path() -> Column:
    """Documents as a tree by the digits of their ids: 1234 of src0 is ``src0/1/12/123/1234.txt``."""
    digits = F.col("doc_id").cast("string")
    above = F.transform(F.sequence(F.lit(1), F.length(digits) - 1), lambda n: F.substring(digits, F.lit(1), n))
    above = F.when(F.length(digits) > 1, above).otherwise(F.array().cast("array<string>"))
    return F.concat_ws("/", F.concat(F.array("source"), above, F.array(F.concat(digits, F.lit(".txt")))))


@query("op3_license_scan", oracles.licences())
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", document_path().alias("path"))
    return license_scan.licences(documents, "path", "text", speaks=F.lit(True))


@query("op5_exact_topk", oracles.TOP_K)
def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return vector_search.top_k(embeddings, F.col("vec_id") % 50 == 0, 5)


@query("op11_spelling_variants", oracles.spelling())
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), plant=True)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetitions.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


def word_tokenizer() -> str:
    """Place of the public tokenizer file whose tokens are counted; every worker has it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), word_tokenizer())
