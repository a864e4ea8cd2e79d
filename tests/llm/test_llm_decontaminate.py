"""Wu-Manber search against comparing every window with every place."""

import random
import re

import pytest

from gristmill.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def expected(text, items):
    own = words(text)
    hit, found = set(), set()
    for item, body in items:
        w = words(body)
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1) if n else ():
            if tuple(own[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(own), len(hit), len(found), sorted(found)


def run(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "kept", 3) for i, t in enumerate(texts)], "doc_id bigint, text string, n_hit string, item_id bigint")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontaminate.contamination(docs, "text", bench).collect()
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], list(r["item_ids"])) for r in out}


@pytest.mark.parametrize("pattern_bytes", [1 << 20, 300])
def test_random_texts(spark, monkeypatch, pattern_bytes):
    monkeypatch.setattr(decontaminate, "PATTERN_BYTES", pattern_bytes)
    rng = random.Random(pattern_bytes)
    vocabulary = ["The", "of", "é", "a1", "x", "Über"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 9, 10, 11, 25])))) for i in range(8, 30)]
    texts = [", ".join(rng.choice(vocabulary + ["q", "z"]) for _ in range(rng.randrange(0, 120))) for _ in range(60)]
    for i in range(0, 60, 3):
        texts[i] += " ... " + rng.choice(items)[1].upper().replace("ÜBER", "Über").replace("É", "é")
    found = run(spark, texts, items)
    assert found == {i: expected(t, items) for i, t in enumerate(texts)}


def test_odd_rows(spark):
    passage = " ".join(f"word{i}" for i in range(12))
    items = [(1, passage), (1, passage), (2, None), (3, ""), (4, "!!"), (None, passage), (10, passage + " more"), (9, passage)]
    filler = " ".join(f"f{i}" for i in range(30_000))
    texts = [None, "", "?!", passage, filler + " " + passage + " " + filler, passage, passage[:40]]
    found = run(spark, texts, items)
    assert found[0] == found[1] == found[2] == (0, 0, 0, [])
    assert found[3] == found[5] == (12, 12, 3, ["1", "10", "9"])
    assert found[4] == (60_012, 12, 3, ["1", "10", "9"])
    assert found[6][1] == 0
    assert run(spark, ["some text here"], []) == {0: (3, 0, 0, [])}
    assert run(spark, [], items) == {}


@pytest.mark.parametrize("pattern_bytes", [1 << 20, 30])
def test_passage_that_only_an_item_without_id_holds(spark, monkeypatch, pattern_bytes):
    monkeypatch.setattr(decontaminate, "PATTERN_BYTES", pattern_bytes)
    passage, other = (" ".join(f"{w}{i}" for i in range(12)) for w in ("word", "other"))
    found = run(spark, [f"x {passage} y", f"{passage} {other}", "x y"], [(None, passage), (7, other)])
    assert found == {0: (14, 12, 0, []), 1: (24, 24, 1, ["7"]), 2: (2, 0, 0, [])}
