"""Text quality by supervised subword embeddings.

A text is the bag of its white-space separated tokens and of the n-grams of 3 to 5 characters
inside them (token ends marked, capitals kept) and of a marker for each repeated token, hashed into 2**17 buckets. Every bucket has a
learned vector; a text's vector is their average, and a softmax over the two classes is trained
together with the vectors by numpy stochastic gradient descent on the training texts. Averaging
and output are linear, so scoring needs one learned number per bucket. Every text is scored
whole.

Defined results: a null or empty text gets the score of the bias alone (0.5 without training
rows); repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from gristmill.llm import learning, ngrams

BUCKETS = 1 << 17
SIZES = range(3, 6)
# Bucket of the marker that stands beside a token equal to the one before it.
REPEAT = 0
DIMENSIONS = 8
EPOCHS = 5
STEP = 0.2
# Training rows at most; they are the ones with the least hash of their id.
SAMPLE = 2000


def _parts(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind of feature: where each text's features begin, and the buckets."""
    points, first = ngrams.code_points(texts)
    place, bucket = ngrams.tokens(points, BUCKETS)
    again = 1 + np.flatnonzero((bucket[1:] == bucket[:-1]) & (np.diff(np.searchsorted(first, place, "right")) == 0))
    found = [(place, bucket), (place[again], np.full(len(again), REPEAT))]
    found += [(place, bucket) for _, place, bucket in ngrams.character_ngrams(points, SIZES, BUCKETS)]
    return [(np.searchsorted(place, first), bucket) for place, bucket in found]


def bags(texts: list[bytes | None]) -> list[np.ndarray]:
    """Buckets of each text with repetition."""
    parts = _parts(texts)
    return [np.concatenate([bucket[cut[i] : cut[i + 1]] for cut, bucket in parts]) for i in range(len(texts))]


def train(features: list[np.ndarray], labels: np.ndarray) -> bytes:
    """bias, then one number per bucket: the bucket's vector times the difference of class vectors."""
    random = np.random.default_rng(0)
    vectors = random.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    output = np.zeros((DIMENSIONS, 2))
    bias = np.zeros(2)
    counted = [np.unique(x, return_counts=True) for x in features]
    steps, done = max(1, EPOCHS * len(counted)), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(counted)):
            at, count = counted[i]
            step, done = STEP * (1 - done / steps), done + 1
            share = count / max(1, count.sum())
            hidden = share @ vectors[at]
            logits = hidden @ output + bias
            chance = np.exp(logits - logits.max())
            slope = chance / chance.sum()
            slope[labels[i]] -= 1
            back = output @ slope
            output -= step * np.outer(hidden, slope)
            bias -= 0.1 * step * slope
            # Normalized, so that the text's average moves by the same step whatever its length.
            vectors[at] -= (step * share / max(share @ share, 1e-12))[:, None] * back
    difference = output[:, 1] - output[:, 0]
    return np.concatenate([[bias[1] - bias[0]], vectors @ difference]).astype(np.float32).tobytes()


def _score(model: bytes, texts: list[bytes | None]) -> list[np.ndarray]:
    values = np.frombuffer(model, dtype=np.float32)
    total, number = np.zeros(len(texts)), np.zeros(len(texts))
    for cut, bucket in _parts(texts):
        sums = np.concatenate([[0.0], np.cumsum(values[1:][bucket], dtype=np.float64)])
        total += sums[cut[1:]] - sums[cut[:-1]]
        number += np.diff(cut)
    score = learning.sigmoid(total / np.maximum(number, 1) + float(values[0]))
    return [score, (score >= 0.5).astype(np.int32)]


def fit(
    documents: DataFrame,
    labels: DataFrame,
    learn: Column,
    row_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
) -> bytes:
    """Model of half a MB, whatever the input, from at most ``sample`` labelled texts."""
    rows = learning.labelled_sample(documents, labels, row_id, text, label, sample, learn)
    return learning.fit(rows, bags, train)


def score(df: DataFrame, model: bytes, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``score`` (0 to 1, higher: better) and ``predicted`` (1 if 0.5 or more)."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return learning.append(df, text, fields, _score, model, drop)
