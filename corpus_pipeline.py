"""Corpus pipeline: toxicity, near-duplicates, benchmark contamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its decisions take effect, and
all but the last return the columns of the documents. ``run`` writes each stage's result as
Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import best_fit, dart_minhash, decontaminate, pii, toxicity
from gristmill.llm.queries import table, tokenizer
from gristmill.scratch import Scratch

# A classifier, hashed darts and a tokenizer have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns that a stage would replace renamed, and the columns that bring them back."""
    taken = {c: f"_own_{c}" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(taken), [F.col(taken.get(c, c)).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; null texts stay."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~toxicity.held_out("doc_id", 5, 0))
    rows, own = _aside(docs, ("score", "predicted"))
    scored = toxicity.score(rows, model)
    return scored.where(F.col("text").isNull() | (F.col("predicted") == 0)).select(own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of exact and near copies the document with the least id; null texts stay."""
    return dart_minhash.first_of_each_class(docs, "doc_id", "text").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    rows, own = _aside(docs, (*decontaminate.RESULT.names, "contaminated"))
    judged = decontaminate.contamination(rows, "text", table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col("contaminated")).select(own)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by ``<KIND>`` and ``n_chars`` brought in line."""
    length = "n_chars" if "n_chars" in docs.columns else None
    rows, own = _aside(docs, ("pii",))
    return pii.mask(rows, "text", length).select(own)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 1024 tokens."""
    return best_fit.pack(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written = Scratch(spark, "corpus-pipeline")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        docs = written.keep(stage(spark, docs, sf_dir), f"{number}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
