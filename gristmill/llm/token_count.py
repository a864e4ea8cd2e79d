"""Token counts by byte-pair merging, without any identifiers.

The vocabulary file fixes how a text becomes words (its normalizer and splitter) and the ranked
list of merges. A word is a linked list of symbols; a heap holds its adjacent pairs by rank and
place. The pair of lowest rank is popped and merged until none is left; the count is the number
of initial symbols less the merges. A word of n symbols takes n log n steps, so a text that is
one single word is no exception. Counts of words are remembered within a task, up to
``REMEMBERED`` of them, each of at most ``LONGEST`` characters.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import textbatch
from gristmill.llm.tokens import byte_characters

LIMIT = 2048
REMEMBERED = 1 << 18
LONGEST = 64
# Up to here characters are letters, numbers, spaces or neither alike in all Unicode versions in
# use, and composed already; other texts are split by the library's own steps.
PLAIN_END = 0x180
PLAIN = re.compile(f"[\\x00-\\u{PLAIN_END - 1:04x}]*")


def _class(starts: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN_END) if unicodedata.category(chr(c))[0] in starts)


def _spaces() -> str:
    return "".join(re.escape(chr(c)) for c in (*range(9, 14), 32, 0x85, 0xA0))


class Merger(dict):
    """Number of tokens of a word, given as its symbols in byte characters' stead."""

    def __init__(self, model: dict):
        super().__init__()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: k for k, pair in reversed(list(enumerate(merges)))}
        self.known = model["vocab"]
        self.last = model.get("end_of_word_suffix") or ""
        self.stand_in = {b: c for c, b in byte_characters().items()}

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n

    def count(self, word: str) -> int:
        symbols = [self.stand_in[b] for b in word.encode("utf-8")]
        if not symbols:
            return 0
        symbols[-1] += self.last
        symbols = [s for s in symbols if s in self.known]
        return len(symbols) - self._merges(symbols)

    def _merges(self, symbol: list[str]) -> int:
        rank, n = self.rank, len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i) for i, p in enumerate(zip(symbol, symbol[1:])) if p in rank]
        heapify(heap)
        merges = 0
        while heap:
            k, i = heappop(heap)
            j = after[i]
            # A symbol merged away is empty, so a stale entry has another rank or none.
            if j >= n or rank.get((symbol[i], symbol[j])) != k:
                continue
            symbol[i] += symbol[j]
            symbol[j] = ""
            after[i] = j = after[j]
            merges += 1
            if j < n:
                before[j] = i
                if (symbol[i], symbol[j]) in rank:
                    heappush(heap, (rank[symbol[i], symbol[j]], i))
            h = before[i]
            if h >= 0 and (symbol[h], symbol[i]) in rank:
                heappush(heap, (rank[symbol[h], symbol[i]], h))
        return merges


class Counter:
    """Tokens of a text as the ``tokenizers`` library counts them for a word-end BPE file.

    Strings of special tokens in a text are one token each, as by the library's default.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _require(spec)
        self.library = Tokenizer.from_file(path)
        self.words = Merger(spec["model"])
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        letters, numbers, spaces = _class("L"), _class("N"), _spaces()
        # The file's own splitting pattern for the plain characters.
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")

    def __call__(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._count(text)
        return len(self.special.findall(text)) + sum(map(self._count, self.special.split(text)))

    def _count(self, text: str) -> int:
        if PLAIN.fullmatch(text):
            return sum(map(self.words.__getitem__, self.split.findall(text.lower())))
        return sum(map(self.words.__getitem__, self._library_words(text)))

    def _library_words(self, text: str) -> Iterator[str]:
        """Words by the library's normalizer and splitter; of a byte-level word its characters."""
        as_byte = byte_characters()
        for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
            yield bytes(as_byte[c] for c in word).decode("utf-8")


SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _require(spec: dict) -> None:
    """Stops with a message for a file that splits or merges by other rules."""
    model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    normal = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    fits = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and normal == ["NFC", "Replace", "Lowercase"]
        and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"] == {"Regex": SPLITTER}
        and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
    )
    if not fits:
        raise ValueError("token counts need a lower-casing byte-level BPE file with word ends")


def token_counts(
    documents: DataFrame, tokenizer: str, text: str = "text", row_id: str = "doc_id", limit: int = LIMIT
) -> DataFrame:
    """One row per document: ``row_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    ``tokenizer`` is the path of a tokenizer file that every worker has. Null and empty texts
    have no bytes and no tokens; repeated rows are counted one by one; no documents give no
    rows. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(tokenizer)
        for batch in batches:
            texts = textbatch.utf8(batch.column("_text"))
            n_tokens = [count(t.decode("utf-8", "replace")) if t else 0 for t in texts]
            n_bytes = [len(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                ["_id", "n_bytes", "n_tokens"],
            )

    id_type = documents.schema[row_id].dataType.simpleString()
    rows = documents.select(F.col(row_id).alias("_id"), F.col(text).alias("_text"))
    counted = rows.mapInArrow(run, f"_id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("_id").alias(row_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
