"""Packed token-id matrices as binary files.

Every task gathers the pieces of its documents until a bounded number of tokens is reached and
packs them by best-fit decreasing: pieces by falling length, each into the open row with the
least free space that holds it, found by a segment tree over free spaces. Overlong documents are
cut losslessly into rows of their own and a shorter first piece. Nothing is shuffled.

One file holds a matrix of ids (rows padded with ``PAD_ID``), the cumulative segment lengths of
each row, the offsets where positions restart at 0, and which piece of which document a segment
is. A task writes under a name of its own attempt and returns the name; only names in the
finished manifest count, so a lost executor or a repeated attempt leaves no partial result.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm import shared_files, textbatch
from gristmill.scratch import Scratch
from gristmill.llm.tokens import Encoder, pieces

CAPACITY = 1024
END_ID = 2
PAD_ID = 0
# Tokens that a task holds and packs together; a document may exceed this by its own length.
BUFFER_TOKENS = 4 << 20


class FreeSpaces:
    """Segment tree over free spaces 0 to ``capacity``; a leaf lists the rows with that space."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, space: int, by: int) -> None:
        node = space + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        self._add(space, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(space, row) of the least space of at least ``length``, no longer free."""
        node = length + self.size
        while not self.count[node]:
            # Up to the next subtree on the right.
            while node & 1:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.size:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        space = node - self.size
        self._add(space, -1)
        return space, self.rows[space].pop()


def pack_rows(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers by best-fit decreasing; equal lengths in order of number."""
    free, rows = FreeSpaces(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = free.take(n)
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        space, row = found
        rows[row].append(i)
        if space > n:
            free.put(space - n, row)
    return rows


def _matrix(ids: list[np.ndarray], docs: list, starts: list[int], numbers: list[int], capacity: int) -> bytes:
    """One file's bytes for the given pieces."""
    lengths = np.array([len(x) for x in ids])
    rows = pack_rows(lengths, capacity)
    order = np.array([i for row in rows for i in row], dtype=np.int64)
    matrix = np.full((len(rows), capacity), PAD_ID, dtype="<u4")
    cumulative, splits = [], np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    for k, row in enumerate(rows):
        filled = np.concatenate([ids[i] for i in row])
        matrix[k, : len(filled)] = filled
        cumulative.append(np.concatenate([[0], np.cumsum(lengths[row])]))
    # Ids below 65536 take half of the space.
    small = matrix.size == 0 or int(matrix.max()) < 1 << 16
    out = io.BytesIO()
    np.savez(
        out,
        ids=matrix.astype("<u2") if small else matrix,
        cu_seqlens=np.concatenate(cumulative).astype("<i4"),
        position_resets=np.concatenate([c[:-1] for c in cumulative]).astype("<i4"),
        segments=splits.astype("<i8"),
        doc=np.array([-1 if docs[i] is None else docs[i] for i in order.tolist()], dtype="<i8"),
        doc_known=np.array([docs[i] is not None for i in order.tolist()], dtype=bool),
        start=np.array(starts, dtype="<i8")[order],
        piece=np.array(numbers, dtype="<i4")[order],
    )
    return out.getvalue()


def _write(tokenizer: str, folder: str, capacity: int, end_id: int, buffer_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, end_id)
        ids, docs, starts, numbers, held = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, docs, starts, numbers, held
            if ids:
                path = shared_files.fresh(folder, ".npz")
                shared_files.write(path, _matrix(ids, docs, starts, numbers, capacity))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([len(ids)], pa.int64()), pa.array([held], pa.int64())],
                    ["path", "pieces", "tokens"],
                )
            ids, docs, starts, numbers, held = [], [], [], [], 0

        for batch in batches:
            for doc, text in zip(batch.column("_id").to_pylist(), textbatch.utf8(batch.column("_text"))):
                own = encode((text or b"").decode("utf-8", "replace"))
                for k, (a, n) in enumerate(pieces(len(own), capacity)):
                    ids.append(own[a : a + n])
                    docs.append(doc)
                    starts.append(a)
                    numbers.append(k)
                held += len(own)
                if held >= buffer_tokens:
                    yield from flush()
        yield from flush()

    return run


def write_packed(
    documents: DataFrame,
    folder: str,
    tokenizer: str,
    row_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """Packs and writes all documents below ``folder``; the manifest (path, pieces, tokens).

    ``folder`` is one that driver and executors share; ids are whole numbers or null. Null and
    empty texts are the end id alone; repeated rows are written one by one; no documents give
    no files.
    """
    scratch = Scratch(documents.sparkSession, "token-output")
    rows = documents.select(F.col(row_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    manifest = rows.mapInArrow(
        _write(tokenizer, folder, capacity, end_id, buffer_tokens), "path string, pieces bigint, tokens bigint"
    )
    return scratch.keep(manifest, "manifest")


PACKED = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("n_segments", T.IntegerType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("pieces", T.ArrayType(T.IntegerType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("position_resets", T.ArrayType(T.IntegerType())),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def read_packed(manifest: DataFrame) -> DataFrame:
    """One row per packed row of the manifest's files, without the ids themselves.

    ``ids_crc32`` is over the row's ids, without padding, as little-endian unsigned 32-bit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(PACKED)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                file = dict(np.load(io.BytesIO(shared_files.read(path))))
                ids, splits, ends = file["ids"], file["segments"], file["cu_seqlens"]
                docs = [d if known else None for d, known in zip(file["doc"].tolist(), file["doc_known"].tolist())]
                columns: list[list] = [[] for _ in schema]
                for k in range(len(ids)):
                    a, b = int(splits[k]), int(splits[k + 1])
                    own = ends[a + k : b + k + 1]
                    filled = ids[k, : own[-1]].astype("<u4")
                    segments = [file[x][a:b] for x in ("piece", "start")]
                    resets, crc = file["position_resets"][a:b], zlib.crc32(filled.tobytes())
                    name = path.rpartition("/")[2]
                    values = (name, k, len(filled), b - a, docs[a:b], *segments, own, resets, crc)
                    for column, value in zip(columns, values):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
                )

    return manifest.select("path").mapInArrow(run, PACKED)

