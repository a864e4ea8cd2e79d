"""Benchmark decontamination by Wu-Manber search over words.

Every 10 consecutive words of a benchmark item are a pattern; an item with fewer words, but not
none, is one pattern of its own length. Patterns of one length form one search:

* the *block shift table* tells by the hash of the two words that end at a position how far the
  next possible pattern end lies; most positions are skipped;
* where the shift is zero, the *suffix bucket* of the block (with the pattern's first two words)
  selects the test strings;
* *direct comparison* of the lowered words confirms an occurrence.

The scan runs in lockstep over many short stretches of a chunk's words, so that one numpy call
advances all of them. Texts are read once, in place, and never shuffled.

Defined results: null and word-free texts have no words and no hits; null and word-free items
have no patterns; items without an id are searched for, but count in the hit words only; repeated document rows are judged one by one; equal windows of several items
count for each item; ids of repeated items count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.hashing import GOLDEN, mix
from gristmill.llm import textbatch
from gristmill.scratch import Scratch

WINDOW = 10
BLOCK = 2
STRETCH = 64
SHIFT_BITS = 20
# Pattern tables are built for at most this many benchmark bytes at a time and sent to the tasks;
# a larger benchmark is searched for in several passes.
PATTERN_BYTES = 1 << 20

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


@dataclass
class Patterns:
    """Search tables of all patterns of one length in words."""

    length: int
    block: int
    shift: np.ndarray
    bucket: np.ndarray  # sorted keys of suffix and prefix block
    pattern: list[bytes]  # in bucket order
    items: list[list[int]]  # per pattern


def _slot(block_hash: np.ndarray) -> np.ndarray:
    return (block_hash >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)


def build_patterns(items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> list[Patterns]:
    """Tables for the items' windows; ``items`` are (id, text) pairs."""
    by_length: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = {}
    w = textbatch.words([text for _, text in items])
    lowered = w.data.tobytes()
    for k in range(len(items)):
        first, n = int(w.first[k]), int(w.per_doc[k])
        length = min(n, window)
        for at in range(first, first + n - length + 1) if n else ():
            text = b" ".join(lowered[w.start[i] : w.end[i]] for i in range(at, at + length))
            found = by_length.setdefault(length, {}).setdefault(text, (w.hash[at : at + length], set()))
            found[1].add(k)
    out = []
    for length, found in sorted(by_length.items()):
        block = min(BLOCK, length)
        hashes = np.stack([h for h, _ in found.values()])
        longest = length - block + 1
        shift = np.full(1 << SHIFT_BITS, longest, dtype=np.uint8)
        for end in range(block, length + 1):
            ends = textbatch.runs(hashes[:, end - block : end].ravel(), block)[::block]
            np.minimum.at(shift, _slot(ends), np.uint8(length - end))
        suffix = textbatch.runs(hashes[:, length - block :].ravel(), block)[::block]
        prefix = textbatch.runs(hashes[:, :block].ravel(), block)[::block]
        key = mix(suffix + prefix * GOLDEN)
        order = np.argsort(key)
        texts, owners = list(found), [sorted(s) for _, s in found.values()]
        out.append(Patterns(length, block, shift, key[order], [texts[i] for i in order], [owners[i] for i in order]))
    return out


def search(w: textbatch.Words, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(first word, pattern) of every occurrence in the chunk's words."""
    n, length, block = len(w.hash), patterns.length, patterns.block
    none = np.empty(0, dtype=np.int64)
    if n < length:
        return none, none
    blocks = textbatch.runs(w.hash, block)
    # A stretch looks at pattern ends in [begin, stop); what it reads before may lie outside.
    begin = np.arange(length - 1, n, STRETCH)
    stop = np.minimum(begin + STRETCH, n)
    ends = []
    while len(begin):
        step = patterns.shift[_slot(blocks[begin - block + 1])].astype(np.int64)
        ends.append(begin[step == 0])
        begin = begin + np.maximum(step, 1)
        inside = begin < stop
        begin, stop = begin[inside], stop[inside]
    end = np.sort(np.concatenate(ends))
    first = end - length + 1
    end, first = end[same := w.doc[first] == w.doc[end]], first[same]
    key = mix(blocks[end - block + 1] + blocks[first] * GOLDEN)
    low, high = np.searchsorted(patterns.bucket, key, "left"), np.searchsorted(patterns.bucket, key, "right")
    at, which = [], []
    for i in np.flatnonzero(high > low):
        a = int(first[i])
        text = b" ".join(w.data[w.start[j] : w.end[j]].tobytes() for j in range(a, a + length))
        for p in range(low[i], high[i]):
            if patterns.pattern[p] == text:
                at.append(a)
                which.append(p)
    return np.array(at, dtype=np.int64), np.array(which, dtype=np.int64)


def judge(texts: list[bytes | None], ids: list[str | None], tables: list[Patterns]) -> Iterator[dict]:
    """One result per text: words, hit words, ids of the occurring items, spans of hit words."""
    for _, part in textbatch.chunks(texts):
        w = textbatch.words(part)
        covered = np.zeros(len(w.hash) + 1, dtype=np.int64)
        found: dict[int, set[int]] = {}
        for patterns in tables:
            at, which = search(w, patterns)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + patterns.length, -1)
            for doc, p in zip(w.doc[at].tolist() if len(at) else (), which.tolist()):
                found.setdefault(doc, set()).update(patterns.items[p])
        hit = np.cumsum(covered)[:-1] > 0
        for row in range(len(part)):
            first, n = int(w.first[row]), int(w.per_doc[row])
            spans: list[list[int]] = []
            if row in found:
                marks = np.flatnonzero(np.diff(np.concatenate([[0], hit[first : first + n].astype(np.int8), [0]])))
                spans = marks.reshape(-1, 2).tolist()
            names = sorted({ids[k] for k in found.get(row, ()) if ids[k] is not None})
            yield {
                "n_words": n,
                "n_hit": sum(b - a for a, b in spans),
                "n_items": len(names),
                "item_ids": names,
                "hit_spans": spans,
            }


def _search_pass(df: DataFrame, text: str, out: str, items: list[Row], window: int, drop: list[str]) -> DataFrame:
    """Adds the judgement of every row against ``items`` as the struct column ``out``."""
    pairs = [(None if r["id"] is None else str(r["id"]), r["text"].encode() if r["text"] is not None else None) for r in items]
    shared = df.sparkSession.sparkContext.broadcast(pairs)
    names = [c for c in df.columns if c not in drop]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(out, RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        ids = [item for item, _ in shared.value]
        tables = build_patterns(shared.value, window)
        kind = to_arrow_type(RESULT)
        for batch in batches:
            judged = pa.array(list(judge(textbatch.utf8(batch.column(text)), ids, tables)), kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], judged], [*names, out])

    return df.mapInArrow(run, schema)


def contamination(
    documents: DataFrame,
    text: str,
    benchmark: DataFrame,
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    keep_text: bool = True,
) -> DataFrame:
    """``documents`` with ``n_words, n_hit, n_items, item_ids, hit_spans, contaminated``.

    ``hit_spans`` are (first, end) word positions of hit stretches. What is sent to the tasks is
    bounded: the benchmark is cut, by hash, into parts of about ``PATTERN_BYTES`` each, every
    further part is a further pass over the texts, and the passes are united per row. Columns
    of ``documents`` with the names of the results are replaced; ``keep_text=False`` leaves the
    searched text out.
    """
    scratch = Scratch(documents.sparkSession, "decontaminate")
    items = scratch.keep(
        benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
        .where("text IS NOT NULL")
        .dropDuplicates(),
        "items",
    )
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // PATTERN_BYTES))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(parts))
    results = [f.name for f in RESULT.fields] + ["contaminated"]
    rows = documents.drop(*[c for c in documents.columns if c.lower() in results and c != text])
    passes = [f"_pass{k}" for k in range(parts)]
    for k, name in enumerate(passes):
        unused = [text] if k == parts - 1 and not keep_text else []
        rows = _search_pass(rows, text, name, items.where(part == k).collect(), window, unused)
    scratch.drop("items")
    rows = rows.withColumn("_found", F.col(passes[0]) if parts == 1 else _united(passes)).drop(*passes)
    return (
        rows.select("*", *[F.col(f"_found.{f.name}").alias(f.name) for f in RESULT.fields])
        .drop("_found")
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def _united(passes: list[str]):
    """Judgements of one text against several parts of the benchmark as one."""
    spans = F.array_sort(F.flatten(F.array(*[F.col(f"{p}.hit_spans") for p in passes])))
    empty = F.array().cast("array<array<bigint>>")
    apart = F.aggregate(
        spans,
        empty,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(F.try_element_at(acc, F.lit(-1)), F.lit(2)) >= s[0]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(
                    F.array(
                        F.try_element_at(F.try_element_at(acc, F.lit(-1)), F.lit(1)),
                        F.greatest(F.try_element_at(F.try_element_at(acc, F.lit(-1)), F.lit(2)), s[1]),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    names = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{p}.item_ids") for p in passes]))))
    hit = F.aggregate(apart, F.lit(0).cast("bigint"), lambda acc, s: acc + s[1] - s[0])
    return F.struct(
        F.col(f"{passes[0]}.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size(names).cast("bigint").alias("n_items"),
        names.alias("item_ids"),
        apart.alias("hit_spans"),
    )


def items_digest(item_ids):
    """Lower-case hex SHA-256 of the sorted ids joined by commas."""
    return F.sha2(F.array_join(item_ids, ","), 256)

