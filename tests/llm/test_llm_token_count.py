"""Token counts against the library itself."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gristmill.llm import queries, token_count

LIBRARY = Tokenizer.from_file(queries.word_tokenizer())
COUNT = token_count.Counter(queries.word_tokenizer())
TEXTS = [None, "", "  \n\t ", "Plain WORDS, isn't it? they'll", "Plain WORDS, isn't it? they'll", "<|endoftext|> é ß 漢字 🤦🏼   x",
         "a<|startoftext|><|endoftext|>b <|endoftext", "ab " * 5000, "1 2 3" * 700, "y" * 30_000, "é Å İ ΣΑΣ ǅ ſ", "\x00\x1c\x85\xa0"]


def by_library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "'s", "'LL", " the ", "ing"])), max_size=6))
def test_counts_are_those_of_the_library(parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    assert COUNT(text) == by_library(text)


def test_every_plain_character():
    for c in map(chr, range(token_count.PLAIN_END)):
        for text in (c, f"a{c}b", f"{c}{c} {c}", f"1{c}'s", f"A'{c}"):
            assert COUNT(text) == by_library(text), text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeinorst", min_size=1, max_size=40))
def test_merging_of_one_word(word):
    # Remembered and counted anew, and pair by pair without a heap.
    symbols = [COUNT.words.stand_in[b] for b in word.encode()]
    symbols[-1] += COUNT.words.last
    while True:
        ranked = [(COUNT.words.rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in COUNT.words.rank]
        if not ranked:
            break
        _, i = min(ranked)
        symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
    assert COUNT.words.count(word) == COUNT.words[word] == len(symbols)


def test_query_rows(spark):
    docs = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "x"), (3, "3")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, n_tokens int, n_bytes int")
    got = token_count.token_counts(df, queries.word_tokenizer(), limit=20)
    want = [(i, len((t or "").encode()), by_library(t), by_library(t) > 20) for i, t in docs]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_count.token_counts(df.limit(0), queries.word_tokenizer()).collect() == []


def test_other_kinds_of_files_are_refused(tmp_path):
    with open(queries.tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="word ends"):
        token_count.Counter(str(path))
