"""Features against plain Python, and accuracy on labels kept from learning."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from gristmill.llm import learning, ngrams, quality, textbatch, toxicity

SF_DIR = "/root/testdata/sf0.1"
ODD = [None, b"", b"   ", "ab cd abc".encode(), "Übermut, déjà vu!".encode(), b"x" * 300, b"a a a b"]


def plain_ngrams(text, sizes):
    out = []
    for token in text.split():
        marked = f" {token} "
        out += [marked[i : i + n] for n in sizes for i in range(len(marked) - n + 1)]
    # An n-gram reaches over one end of its word at most.
    return [g for g in out if not (g[0] == g[-1] == " ")]


def test_ngrams_are_those_of_marked_words():
    points, first = ngrams.code_points(ODD)
    places = [(n, p) for n, place, _ in ngrams.character_ngrams(points, range(3, 6), 1 << 20) for p in place.tolist()]
    flat = "".join(map(chr, points))
    for k, text in enumerate(ODD):
        own = sorted(flat[p : p + n] for n, p in places if first[k] <= p < first[k + 1])
        assert own == sorted(plain_ngrams((text or b"").decode(), range(3, 6)))


def test_equal_tokens_share_a_bucket():
    points, _ = ngrams.code_points([b"one two one", b"one"])
    _, bucket = ngrams.tokens(points, 1 << 30)
    assert bucket[0] == bucket[2] == bucket[3] != bucket[1]


def test_repeats_are_marked():
    bag = quality.bags([b"a a a b", b"a b a b", b"a", b"a"])
    assert [int((b == quality.REPEAT).sum()) for b in bag] == [2, 0, 0, 0]


def test_texts_are_worked_off_in_small_parts(spark):
    texts = ["w" * 1000, None, "", "z" * 300_000] + ["w" * 1000] * 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    sizes = lambda texts: np.full(len(texts), sum(len(t or b"") for t in texts))
    field = [T.StructField("held", T.LongType())]
    rows = learning.append(docs, "text", field, lambda _, texts: [sizes(texts)], None).collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == list(enumerate(texts))
    assert max(r["held"] for r in rows if r["doc_id"] != 3) <= 1 << 18 and rows[3]["held"] == 300_000
    sample = docs.selectExpr("doc_id AS order", "doc_id AS _id", "1 AS label", "text").where("doc_id > 3")
    features = lambda texts: [np.array([x]) for x in sizes(texts)]
    model = learning.fit(sample, features, lambda rows, _: np.concatenate([[len(rows)], *rows]).astype(np.int64).tobytes())
    seen, *held = np.frombuffer(model, dtype=np.int64).tolist()
    assert seen == 400 and max(held) <= 1 << 18


def test_parts_hold_every_text_once():
    texts = [None, "", "é" * 10, "abc", None, "x" * 50, "y", ""]
    for kind in (pa.string(), pa.large_string()):
        for column in (pa.array(texts, kind), pa.array(["before", *texts], kind).slice(1)):
            found = list(textbatch.parts(column, 20, 3))
            assert [t for _, part in found for t in part] == [None if t is None else t.encode() for t in texts]
            assert [first for first, _ in found] == np.cumsum([0, *[len(part) for _, part in found]])[:-1].tolist()
            assert all(len(part) == 1 or len(part) <= 3 and sum(len(t or b"") for t in part) <= 20 for _, part in found)
    assert list(textbatch.parts(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, module, label):
    texts = ["plain words here", "awful dreadful words", None, "", "z" * 100_000] * 8
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, score double, predicted string")
    docs = docs.union(docs.where("doc_id < 3"))
    labels = [(i, i % 5 == 1, 1) for i in range(30)] + [(None, True, 0), (7, None, 1), (3, True, 1), (3, False, 0)]
    labels = spark.createDataFrame([(i, None if v is None else int(v)) for i, v, _ in labels], f"doc_id bigint, {label} int")
    model = module.fit(docs, labels, F.lit(True))
    rows = module.score(docs, model).collect()
    assert len(rows) == 43 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["text"] is None or r["text"] == ""}) == 1
    untrained = module.score(docs, module.fit(docs, labels, F.lit(False)))
    assert {r["score"] for r in untrained.collect()} == {0.5}
    assert module.score(docs.where("false"), model).count() == 0


def test_sample_is_bounded_and_repeatable(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    picked = [
        sorted(r["_id"] for r in learning.labelled_sample(docs.repartition(n), labels, "doc_id", "text", "toxic", 7, F.lit(True)).collect())
        for n in (1, 5)
    ]
    assert picked[0] == picked[1] and len(picked[0]) == 7


@pytest.mark.parametrize(
    "name, label, least, rare_least, majority",
    [("op2_toxicity", "toxic", 0.97, 0.85, 0), ("op4_quality_classifier", "quality", 0.97, 0.9, 1)],
)
def test_held_out_accuracy(spark, name, label, least, rare_least, majority):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scored = entry.queries()[name](spark, SF_DIR).join(labels, "doc_id").where("held_out").toPandas()
    right = (scored["predicted"] == scored[label]).to_numpy()
    rare = (scored[label] != majority).to_numpy()
    print(name, len(right), right.mean(), right[rare].mean())
    assert right.mean() >= least
    assert right[rare].mean() >= rare_least
    assert right[~rare].mean() >= 0.99
    assert np.isfinite(scored["score"]).all()


def test_sparse_scores_are_those_of_present_buckets():
    texts = [b"plain words here", b"awful dreadful words", b"x" * 50_000, b"awful awful words", None] * 4
    labels = np.array([0, 1, 0, 1, 0] * 4)
    features = toxicity.present(texts)
    model = toxicity.train(features, labels)
    n = (len(model) - 4) // 8
    known = dict(zip(np.frombuffer(model, np.int32, n, 4).tolist(), np.frombuffer(model, np.float32, n, 4 + 4 * n).tolist()))
    bias = float(np.frombuffer(model, np.float32, 1)[0])
    for x, got in zip(features, toxicity._score(model, texts)[0]):
        own = [known[b] for b in x.tolist() if b in known]
        assert got == pytest.approx(1 / (1 + np.exp(-(sum(own) / max(1, len(own)) ** 0.5 + bias))))
