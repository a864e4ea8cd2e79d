"""The pipeline's stages, each judged on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from test_llm_decontaminate import words
from test_llm_near_duplicates import expected_classes

SF_DIR = "/root/testdata/sf0.001"
CLASHES = ("Score", "predicted", "digest", "n_hit", "contaminated", "pii", "node")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    # Repeated, null and empty rows beside the given ones.
    odd = spark.createDataFrame(
        [(90_001, None, "en", "s", 0), (90_002, "", None, None, None), (None, "mail a@b.cd", "en", "s", 11), (None, None, None, None, None)],
        docs.schema,
    )
    docs = docs.union(odd).union(docs.limit(3)).select("*", *[F.lit("clash").alias(c) for c in CLASHES]).cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF_DIR).cache())
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_stay(stages):
    for s in stages[:-1]:
        assert s.dtypes == stages[0].dtypes
        assert s.where(" or ".join(f"{c} <> 'clash'" for c in CLASHES)).count() == 0


def test_toxicity(spark, stages):
    toxic = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("toxic = 1")
    labelled, kept = stages[0].join(toxic, "doc_id").count(), stages[1].join(toxic, "doc_id").count()
    assert kept < labelled
    clean = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("toxic = 0")
    assert stages[1].join(clean, "doc_id").count() >= 0.97 * stages[0].join(clean, "doc_id").count()
    assert {90_001, None} <= {i for i, _ in rows(stages[1])}


def test_one_of_each_class_stays(stages):
    before = {i: t for i, t in rows(stages[1]) if t is not None and i is not None}
    expected = {i for i, c in expected_classes(list(before.items())).items() if i == c}
    after = [i for i, t in rows(stages[2]) if t is not None and i is not None]
    assert sorted(after) == sorted(expected)


def test_contaminated_go(spark, stages):
    windows = {}
    for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        w = words(r["text"])
        n = min(10, len(w))
        windows.update({(n, tuple(w[i : i + n])): 1 for i in range(len(w) - n + 1) if n})
    sizes = {n for n, _ in windows}

    def clean(text):
        w = words(text)
        return not any((n, tuple(w[i : i + n])) in windows for n in sizes for i in range(len(w) - n + 1))

    assert sorted(rows(stages[3]), key=str) == sorted((r for r in rows(stages[2]) if clean(r[1])), key=str)


def test_masks_take_effect(stages):
    before, after = dict(rows(stages[3])), dict(rows(stages[4]))
    assert before.keys() == after.keys()
    assert after[None] == "mail <EMAIL>" or after[None] is None
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].where("text is not null").collect())
    assert not [t for t in after.values() if t and ".example.com" in t and "@mail" in t]


def test_everything_is_packed(stages):
    packed = {r["doc_id"] for r in stages[5].collect()}
    assert packed == {i for i, _ in rows(stages[4])}


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))
