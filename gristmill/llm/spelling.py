"""Spelling variants: words one edit apart, found by walking a trie that is a table of edges.

Words are counted natively in the scan, with partial sums. The frequent ones, forwards and
backwards, form one trie. Its nodes are prefixes where words part; an edge holds the letters up
to the next such prefix, or up to the end of the only word left (*leaf*). Edges lie in a table
keyed by the node they leave, and a node has as many edges as letters follow it.

A state is (word, position, node, edits). A word's states start at the first parting at or after
half of its length, which is where its neighbours can differ from it in that direction: if the
first difference lies before the middle, the reversed words agree up to the middle. All states
advance by one edge in one join, level by level: without an edit along exactly the same letters,
with none left over for a second one; with the first edit along letters one replacement,
insertion or deletion away. A state that reaches the end of its word with one edit at the end of
a leaf is a neighbour, checked by direct comparison.

Nodes have a 64-bit hash of their prefix for a name. Two prefixes of the same name would share
their edges, which adds states but loses none. A join on a node that holds very many states is
split by adaptive execution; each level is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.hashing import mix
from gristmill.scratch import Scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LETTERS = 6
LEAST_COUNT = 5
FORM_FACTOR = 5
SLIP_EVERY = 199
# Least half of a word.
SHORTEST = LEAST_LETTERS // 2

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def word_counts(
    documents: DataFrame, row_id: str = "doc_id", text: str = "text", plant: bool = False, least: int = LEAST_COUNT
) -> DataFrame:
    """(word, n) of all words of at least ``LEAST_LETTERS`` letters with at least ``least`` occurrences.

    Words are maximal runs of Latin letters with A-Z lowered. ``plant`` deletes one letter of the
    occurrences whose id and word ask for it (none for a null id).
    """
    lowered = F.translate(F.col(text), UPPER, UPPER.lower())
    # A greedy match of at least so many letters is a whole run.
    found = F.regexp_extract_all(lowered, F.lit(f"([a-z\\u00C0-\\u00FF]{{{LEAST_LETTERS},}})"), F.lit(1))
    words = documents.select(F.col(row_id).cast("string").alias("_id"), F.explode(found).alias("word"))
    if plant:
        h = F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary"))
        at = F.pmod(h, F.length("word")).cast("int")
        slipped = F.concat(F.substring("word", F.lit(1), at), F.substr("word", at + 2))
        words = words.select(F.when(h % SLIP_EVERY == 0, slipped).otherwise(F.col("word")).alias("word"))
        words = words.where(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of each word: letters, half, and for its prefixes their names and what follows."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        letters = words + [w[::-1] for w in words]
        size = np.array([len(w) for w in letters], dtype=np.int64)
        half = size // 2
        half[len(words) :] = size[len(words) :] - half[len(words) :]
        backward = np.arange(len(letters)) >= len(words)
        codes = np.frombuffer("".join(letters).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        first = np.cumsum(size) - size
        at = np.arange(len(codes)) - np.repeat(first, size)
        powers = np.cumprod(np.full(int(size.max(initial=1)), _BASE, dtype=np.uint64), dtype=np.uint64)
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        marked = codes + (np.repeat(backward, size).astype(np.uint64) << _U(32))
        np.cumsum(mix(marked) * powers[at], dtype=np.uint64, out=sums[1:])
        # From the least place where a word of this vocabulary can begin to differ.
        kept = at >= SHORTEST - 1
        names = mix(sums[1:] - np.repeat(sums[first], size))[kept].view(np.int64)
        last = at == np.repeat(size, size) - 1
        follows = np.where(last, 0, np.append(codes[1:], _U(0)))[kept].astype(np.int32)
        cuts = pa.array(np.concatenate([[0], np.cumsum(size - SHORTEST + 1)]), pa.int32())
        n = batch.column("n").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(words + words, pa.string()),
                pa.array(np.concatenate([n, n]), pa.int64()),
                pa.array(letters, pa.string()),
                pa.array(half, pa.int32()),
                pa.ListArray.from_arrays(cuts, pa.array(names, pa.int64())),
                pa.ListArray.from_arrays(cuts, pa.array(follows, pa.int32())),
            ],
            ["word", "n", "letters", "half", "node", "follows"],
        )


def _letter_bits(code: Column) -> tuple[Column, Column]:
    """Two numbers with one bit among them set for a letter, or for 0, the end of a word.

    Together they have a bit for each letter of the alphabet, a to z and U+00C0 to U+00FF, so the
    letters that follow a node are two numbers, whatever their count.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    small = F.when(code == 0, 26).otherwise(code - ord("a")).cast("int")
    return (
        F.when(code < 0xC0, F.call_function("shiftleft", one, small)).otherwise(none),
        F.when(code >= 0xC0, F.call_function("shiftleft", one, (code - 0xC0).cast("int"))).otherwise(none),
    )


class Trie:
    """Edge table of the words in both directions, and where each word starts in it."""

    def __init__(self, words: DataFrame, scratch: Scratch):
        both = words.select("word", "n").mapInArrow(
            _prefixes,
            "word string, n bigint, letters string, half int, node array<bigint>, follows array<int>",
        )
        strings = scratch.keep(both.withColumn("string", F.monotonically_increasing_id()), "strings")
        # Narrow rows: a word has as many prefixes as letters. What follows a whole word is 0.
        prefixes = strings.select("string", F.posexplode(F.arrays_zip("node", "follows")).alias("at", "p"))
        prefixes = prefixes.select("string", (F.col("at") + SHORTEST).alias("depth"), "p.node", "p.follows")
        low, high = _letter_bits(F.col("follows"))
        follows = prefixes.groupBy("node").agg(F.bit_or(low).alias("low"), F.bit_or(high).alias("high"))
        parting = follows.where(F.bit_count("low") + F.bit_count("high") > 1)
        path = (
            prefixes.drop("follows")
            .join(parting, "node")
            .groupBy("string")
            .agg(F.sort_array(F.collect_list(F.struct("depth", "node", "low", "high"))).alias("path"))
        )
        partings = scratch.keep(strings.drop("node", "follows").join(path, "string"), "partings")
        # From each parting of a word to its next one, or to its end.
        after = F.expr(
            "transform(path, (x, i) -> named_struct('node', x.node,"
            " 'label', substr(letters, x.depth + 1, coalesce(get(path, i + 1).depth, length(letters)) - x.depth),"
            " 'child', get(path, i + 1).node, 'low', get(path, i + 1).low, 'high', get(path, i + 1).high))"
        )
        edges = partings.select("word", "n", F.explode(after).alias("e")).select(
            "e.*",
            F.when(F.col("e.child").isNull(), F.col("word")).alias("near"),
            F.when(F.col("e.child").isNull(), F.col("n")).alias("near_n"),
        )
        self.edges = scratch.keep(edges.distinct(), "edges")
        first = F.expr("get(filter(path, x -> x.depth >= half), 0)")
        here = partings.select("word", "letters", "half", first.alias("p")).where("p is not null")
        state = "named_struct('position', {0}, 'edits', {1})"
        starts = F.expr(
            f"concat(array({state.format('p.depth', 0)}),"
            f" if(p.depth > half, array({state.format('p.depth - 1', 1)}), array()),"
            f" if(p.depth > half and p.depth < length(letters), array({state.format('p.depth + 1', 1)}), array()))"
        )
        self.starts = here.select("word", "letters", F.col("p.node").alias("node"), F.explode(starts).alias("s")).select(
            "word", "letters", "node", "s.position", "s.edits"
        )


def _advanced() -> Column:
    """(position, edits) after an edge's letters, null for each way to go that they don't fit."""
    length = F.length("label")
    same = F.substr("letters", F.col("position") + 1, length) == F.col("label")
    outcome = lambda position, edits: F.struct(position.cast("int").alias("position"), F.lit(edits).alias("edits"))
    exact = F.when(same, outcome(F.col("position") + length, 0))
    edited = []
    for more in (-1, 0, 1):
        end = F.col("position") + length + more
        one = (
            (end >= F.col("position"))
            & (end <= F.length("letters"))
            & (F.levenshtein(F.substr("letters", F.col("position") + 1, length + more), "label", 1) == 1)
        )
        edited.append(F.when(one, outcome(end, 1)))
    second = F.when(same, outcome(F.col("position") + length, 1))
    return F.when(F.col("edits") == 1, F.array(second)).otherwise(F.array(exact, *edited))


def _useful() -> Column:
    """Whether a state is a neighbour or can still become one."""
    over = F.col("position") == F.length("letters")
    letter = F.ascii(F.substr("letters", F.col("position") + 1, F.lit(1)))
    low, high = _letter_bits(F.when(over, 0).otherwise(letter))
    further = (F.col("low").bitwiseAND(low) != 0) | (F.col("high").bitwiseAND(high) != 0)
    return F.when(F.col("node").isNull(), over & (F.col("edits") == 1)).otherwise((F.col("edits") == 0) | further)


def neighbours(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, near, near_n) for all words of ``words`` (word, n) that are one edit apart, both ways."""
    trie = Trie(words, scratch)
    found, level = [], 0
    states = scratch.keep(trie.starts, "states-0")
    while not states.isEmpty():
        moved = (
            states.join(trie.edges, "node")
            .select("word", "letters", "child", "near", "near_n", "low", "high", F.explode(_advanced()).alias("s"))
            .select("word", "letters", F.col("child").alias("node"), "near", "near_n", "low", "high", "s.position", "s.edits")
            .where(F.col("position").isNotNull() & _useful())
            .drop("low", "high")
        )
        level += 1
        states = scratch.keep(moved, f"states-{level}")
        found.append(states.where("node is null").select("word", "near", "near_n"))
        states = states.where("node is not null").drop("near", "near_n")
    if not found:
        return states.select("word", F.col("word").alias("near"), F.lit(0).cast("bigint").alias("near_n"))
    pairs = reduce(DataFrame.unionAll, found).where(F.levenshtein("word", "near", 1) == 1)
    return pairs.distinct()


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the end.

    Counts grow by ``FORM_FACTOR`` with each step, so a chain has a few dozen words at most; each
    round doubles the steps taken.
    """
    steps = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots-0")
    number = 0
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = steps.join(onward, "root", "left")
        if joined.where("further is not null").isEmpty():
            return steps
        number += 1
        steps = scratch.keep(joined.select("word", F.coalesce("further", "root").alias("root")), f"roots-{number}")


def spelling_variants(documents: DataFrame, row_id: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """One row per frequent word: ``word, form, root, n, n_near, form_n``.

    ``n_near`` counts the words one inserted, deleted or replaced letter away. ``form`` is the one
    of them with the largest n (ties: smallest in code-point order) if that is at least
    ``FORM_FACTOR`` times the word's own, else null; ``root`` is reached by following forms and is
    the word itself without one. Null and empty texts have no words; repeated rows count each;
    no documents, or no frequent words, give no rows. Other columns don't matter.
    """
    scratch = Scratch(documents.sparkSession, "spelling")
    words = scratch.keep(word_counts(documents, row_id, text, plant), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("by_n"), F.col("near")))
    near = neighbours(words, scratch).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), (-F.col("best.by_n")).alias("top"), "best.near"
    )
    has_form = F.col("top") >= FORM_FACTOR * F.col("n")
    judged = scratch.keep(
        judged.select(
            "word", "n", "n_near", F.when(has_form, F.col("near")).alias("form"), F.when(has_form, F.col("top")).alias("form_n")
        ),
        "judged",
    )
    roots = _roots(judged.where("form is not null").select("word", "form"), scratch)
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
