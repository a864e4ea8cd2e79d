"""Toxicity by a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the n-grams of 3 to 10 characters inside words (word ends marked, capitals lowered),
hashed into 2**21 buckets and taken as present or absent. A bucket's ratio is the logarithm of
its smoothed frequency in toxic over that in other training texts, drawn towards 0; a text's
features are these ratios, scaled to the text's number of known buckets. A logistic model is trained on them by
numpy gradient descent with per-weight steps. The model lists known buckets only, by number. Every
text is scored whole.

Defined results: a null, empty or unknown text gets the score of the bias alone (0.5 without any
training row); very long texts take one byte per bucket; repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm import learning, ngrams

BUCKETS = 1 << 21
# Words that mark toxic texts may share their first 5 to 7 characters with clean ones.
SIZES = range(3, 11)
SMOOTHING = 0.5
# Buckets seen in fewer training texts are not used.
LEAST_TEXTS = 3
# Ratios are drawn towards 0 by this much: a bucket without clear evidence is not used.
LEAST_RATIO = 2.0
EPOCHS = 8
STEP = 0.1
DECAY = 1e-3
# Training rows at most; they are the ones with the least hash of their id.
SAMPLE = 5000


def present(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted buckets of each text."""
    points, first = ngrams.code_points(texts)
    parts = []
    for _, place, bucket in ngrams.character_ngrams(ngrams.lowered(points), SIZES, BUCKETS):
        parts.append((np.searchsorted(place, first), bucket))
    seen = np.zeros(BUCKETS, dtype=bool)
    out = []
    for i in range(len(texts)):
        found = np.concatenate([np.empty(0, np.int64), *(bucket[cut[i] : cut[i + 1]] for cut, bucket in parts)])
        if len(found) < BUCKETS >> 6:
            found = np.sort(found)
            found = found[np.diff(found, prepend=-1) > 0]
        else:
            seen[found] = True
            found = np.flatnonzero(seen)
            seen[found] = False
        out.append(found)
    return out


def train(features: list[np.ndarray], labels: np.ndarray) -> bytes:
    """bias as float32, then the known buckets as int32, then their ratio x weight as float32."""
    counts = np.zeros((2, BUCKETS), dtype=np.int32)
    for x, label in zip(features, labels):
        counts[label, x] += 1
    of_class = np.bincount(labels, minlength=2) + 2 * SMOOTHING
    buckets = np.flatnonzero(counts[0] + counts[1] >= LEAST_TEXTS)
    clean, toxic = counts[:, buckets] + SMOOTHING
    ratio = np.log(toxic / of_class[1]) - np.log(clean / of_class[0])
    ratio = np.sign(ratio) * np.maximum(0, np.abs(ratio) - LEAST_RATIO)
    buckets, ratio = buckets[ratio != 0], ratio[ratio != 0]
    # All that follows has one number per known bucket.
    slot = np.full(BUCKETS, -1, dtype=np.int32)
    slot[buckets] = np.arange(len(buckets), dtype=np.int32)
    weight, moved = np.zeros(len(buckets)), np.full(len(buckets), 1e-8)
    bias, bias_moved = 0.0, 1e-8
    used = [found[found >= 0] for found in (slot[x] for x in features)]
    random = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in random.permutation(len(used)):
            at = used[i]
            x = ratio[at] / np.sqrt(max(1, len(at)))
            error = learning.sigmoid(x @ weight[at] + bias) - labels[i]
            slope = error * x + DECAY * weight[at]
            moved[at] += slope * slope
            weight[at] -= STEP * slope / np.sqrt(moved[at])
            bias_moved += error * error
            bias -= STEP * error / np.sqrt(bias_moved)
    values = (ratio * weight).astype(np.float32)
    return np.float32(bias).tobytes() + buckets.astype(np.int32).tobytes() + values.tobytes()


def _score(model: bytes, texts: list[bytes | None]) -> list[np.ndarray]:
    bias, n = float(np.frombuffer(model, np.float32, 1)[0]), (len(model) - 4) // 8
    # Slot 0 stands for all unknown buckets.
    slot = np.zeros(BUCKETS, dtype=np.int32)
    slot[np.frombuffer(model, np.int32, n, 4)] = np.arange(1, n + 1, dtype=np.int32)
    weight = np.concatenate([np.zeros(1, np.float32), np.frombuffer(model, np.float32, n, 4 + 4 * n)])
    points, first = ngrams.code_points(texts)
    rows, slots = [], []
    for _, place, bucket in ngrams.character_ngrams(ngrams.lowered(points), SIZES, BUCKETS):
        found = slot[bucket]
        at = np.flatnonzero(found)
        rows.append(np.searchsorted(first, place[at], side="right") - 1)
        slots.append(found[at].astype(np.int64))
    # Every known bucket of a text once.
    pairs = np.unique(np.concatenate([np.empty(0, np.int64), *(r * (n + 1) + k for r, k in zip(rows, slots))]))
    row = pairs // (n + 1)
    sums = np.bincount(row, weight[pairs % (n + 1)], minlength=len(texts))[: len(texts)]
    known = np.bincount(row, minlength=len(texts))[: len(texts)]
    score = learning.sigmoid(sums / np.sqrt(np.maximum(known, 1)) + bias)
    return [score, (score >= 0.5).astype(np.int32)]


def fit(
    documents: DataFrame,
    labels: DataFrame,
    learn: Column,
    row_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
) -> bytes:
    """Model of at most 16 MB, whatever the input, from at most ``sample`` labelled texts."""
    rows = learning.labelled_sample(documents, labels, row_id, text, label, sample, learn)
    return learning.fit(rows, present, train)


def score(df: DataFrame, model: bytes, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more)."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return learning.append(df, text, fields, _score, model, drop)


def held_out(row_id: str, folds: int, fold: int) -> Column:
    """Whether a row's labels are kept from learning; a null id's always are."""
    return F.coalesce(F.crc32(F.col(row_id).cast("string")) % folds == fold, F.lit(True))
