"""Packing and token output against one-by-one models and exact round trips."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gristmill.llm import best_fit, queries, token_output
from gristmill.scratch import Scratch
from gristmill.llm.tokens import Encoder, pieces

LIBRARY = Tokenizer.from_file(queries.tokenizer())
ENCODE = Encoder(queries.tokenizer(), 2)
TEXTS = [None, "", "  \n\t ", "plain words", "plain words", "<|endoftext|> é ß 漢字 🤦🏼   x", "ab " * 5000, "1 2 3" * 700, "y" * 3000]


def ids_of(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " "])), max_size=5))
def test_ids_are_those_of_the_library(parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    assert ENCODE.fast is not None
    assert ENCODE(text).tolist() == ids_of(text).tolist()


def test_special_strings_are_special_tokens():
    assert ENCODE("a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 2]


def one_by_one(lengths, capacity):
    """Space left in each bin after best-fit decreasing of single items."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= n]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 32, 100])
    lengths = [min(capacity, int(rng.paretovariate(1))) if seed % 2 else rng.randint(1, capacity) for _ in range(rng.randrange(0, 400))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    slots = best_fit.plan(histogram, capacity)
    filled, ranks = {}, {}
    for s in slots:
        for i in range(s.sequences * s.per_sequence):
            sequence = s.first_sequence + i // s.per_sequence
            at = s.offset + i % s.per_sequence * s.length
            filled.setdefault(sequence, []).append((at, s.length))
            ranks.setdefault(s.length, []).append(s.first_rank + i)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    left = []
    for parts in filled.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        left.append(capacity - end)
    assert sorted(left) == one_by_one(lengths, capacity)
    rows = token_output.pack_rows(np.array(lengths, dtype=np.int64), capacity)
    assert sorted(capacity - sum(lengths[i] for i in r) for r in rows) == sorted(left)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))


def test_plan_is_small_for_many_documents():
    rng = random.Random(0)
    histogram = {n: rng.randrange(1, 10**9) for n in range(1, 1025)}
    slots = best_fit.plan(histogram, 1024)
    assert len(slots) <= 3 * 1024 * 10
    total = sum(n * c for n, c in histogram.items())
    assert max(s.first_sequence + s.sequences for s in slots) <= -(-total // 1024) * 1.01


def test_pieces():
    assert pieces(5, 10) == [(0, 5)] and pieces(10, 10) == [(0, 10)]
    assert pieces(25, 10) == [(0, 5), (5, 10), (15, 10)] and pieces(20, 10) == [(0, 10), (10, 10)]


def documents(spark):
    rows = [(i, t, 5, "z") for i, t in enumerate(TEXTS)] + [(None, "no id", 5, "z"), (3, "plain words", 5, "z")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, length bigint, offset string"), rows


def test_pack_round_trip(spark):
    docs, rows = documents(spark)
    out = best_fit.pack(docs, queries.tokenizer()).collect()
    expected = []
    for doc, text, *_ in rows:
        ids = ids_of(text)
        expected += [(str(doc), k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(pieces(len(ids), 1024))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(expected)
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        ends = [0]
        for at, n in sorted(parts):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 1024
    assert len(by_sequence) == len(one_by_one([e[3] for e in expected], 1024))
    assert best_fit.pack(docs.where("false"), queries.tokenizer()).count() == 0


@pytest.mark.parametrize("buffer_tokens", [100, 1 << 22])
def test_token_output_round_trip(spark, buffer_tokens):
    docs, rows = documents(spark)
    manifest = token_output.write_packed(docs.coalesce(2), Scratch(spark, "ids").folder, queries.tokenizer(), buffer_tokens=buffer_tokens)
    out = token_output.read_packed(manifest).collect()
    own = {}
    for doc, text, *_ in rows:
        own.setdefault(doc, ids_of(text))
    seen = []
    for r in out:
        ends = r["cu_seqlens"]
        assert r["position_resets"] == ends[:-1] and ends[-1] == r["n_tokens"] <= 1024 and len(ends) == r["n_segments"] + 1
        parts = [own[d][s : s + b - a] for d, s, a, b in zip(r["doc_ids"], r["starts"], ends, ends[1:])]
        assert zlib.crc32(np.concatenate(parts).tobytes()) == r["ids_crc32"]
        seen += [(str(d), p) for d, p in zip(r["doc_ids"], r["pieces"])]
    assert sorted(seen) == sorted((str(d), k) for d, t, *_ in rows for k in range(len(pieces(len(ids_of(t)), 1024))))
    empty = token_output.write_packed(docs.where("false"), Scratch(spark, "ids").folder, queries.tokenizer())
    assert token_output.read_packed(empty).count() == 0
