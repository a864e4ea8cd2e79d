"""Bounded labelled samples, fitting in one task and scoring in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm import textbatch

# An n-gram of every size begins at every character, so a text's features take some hundred times
# its bytes while they are made: bytes of texts that are worked off at a time.
PART_BYTES = 1 << 17


def labelled_sample(
    documents: DataFrame, labels: DataFrame, row_id: str, text: str, label: str, limit: int, learn: Column
) -> DataFrame:
    """At most ``limit`` (order, label, text) rows to learn from, the same ones on every run.

    ``learn`` says by ``row_id`` which labels may be used. Labels of repeated ids are averaged
    (0.5 counts as 1), null labels and ids are left out, and of repeated documents one text is
    taken. The chosen ids, at most ``limit`` and thus bounded, go to the scan of the documents.
    """
    order = F.xxhash64(row_id)
    chosen = (
        labels.where(learn & F.col(label).isNotNull() & F.col(row_id).isNotNull())
        .groupBy(row_id)
        .agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
        .orderBy(order, row_id)
        .limit(limit)
    )
    texts = documents.select(row_id, F.coalesce(text, F.lit("")).alias("_text"))
    return (
        texts.join(F.broadcast(chosen), row_id)
        .groupBy(row_id)
        .agg(F.first("_label").alias("label"), F.min("_text").alias("text"))
        .select(order.alias("order"), F.col(row_id).alias("_id"), "label", "text")
    )


def fit(sample: DataFrame, features: Callable, train: Callable) -> bytes:
    """Model trained in one task on the sample's features; ``sample`` has a bounded row count.

    ``features(texts)`` gives one int32 array per text, ``train(features, labels)`` the model's
    bytes. A lost task is simply run again: rows are sorted, so it gives the same model. No
    rows: ``train([], [])``.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, part in textbatch.parts(batch.column("text"), PART_BYTES):
                found.extend(np.asarray(x, dtype=np.int32).tobytes() for x in features(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("_id").cast(pa.string()), batch.column("label"), pa.array(found, pa.binary())],
                ["order", "_id", "label", "features"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            # Views of the batch, not copies.
            rows += [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in batch.column("features")]
            labels += batch.column("label").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([train(rows, np.array(labels, dtype=np.int64))], pa.binary())], ["model"])

    extracted = sample.mapInArrow(extract, "order bigint, _id string, label int, features binary")
    alone = extracted.repartition(1).sortWithinPartitions("order", "_id")
    models = [r["model"] for r in alone.mapInArrow(learn, "model binary").collect()]
    # Without any row there may be no task.
    return models[0] if models else train([], np.empty(0, dtype=np.int64))


def append(
    df: DataFrame, text: str, fields: list[T.StructField], compute: Callable, state: object, drop: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` without ``drop`` plus ``fields``, computed chunk by chunk from the texts.

    ``compute(state, texts)`` gives one array per field. ``state`` is broadcast: its size must
    not grow with the data. Columns of ``df`` with the new names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(state)
    new = [f.name for f in fields]
    names = [c for c in df.columns if c not in drop and c.lower() not in new]
    schema = T.StructType([*[df.schema[c] for c in names], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for first, part in textbatch.parts(batch.column(text), PART_BYTES):
                own = batch.slice(first, len(part))
                made = [pa.array(x, kind) for x, kind in zip(compute(shared.value, part), kinds)]
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in names], *made], [*names, *new])

    return df.mapInArrow(run, schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
