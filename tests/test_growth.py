"""Work that must not grow faster than the input."""

from collections import Counter
from pathlib import Path

import pytest

from gristmill.functions import hashing
from gristmill.operators import assembly, buckets, curate, gates, json_rows, overlap, search
from gristmill.plans import export_plans
from gristmill.scratch import Scratch
from gristmill.sources import readers
from gristmill.streaming import jobs
from gristmill.streaming.machines import TokenBucket


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles_of(df, column):
    return sum("Exchange hashpartitioning(" in line and f"{column}#" in line for line in plan_of(df).splitlines())


@pytest.mark.parametrize("limit", [export_plans.LIST_BYTES, 500])
def test_lists_are_as_many_as_the_bytes_need(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(export_plans, "LIST_BYTES", limit)
    monkeypatch.setattr(export_plans, "_folder", lambda _, name: f"{tmp_path}/{name}")
    rows = [(i * 100 if i % 7 else None, f"text {i} \n\"é" * 5 if i % 5 else None, "en", "ab"[i % 2] if i % 11 else None) for i in range(300)]
    spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = export_plans.json_document_files(spark, str(tmp_path))
    want = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id", "lang", "source", "md5(text) AS text_md5")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    files = len(list(Path(f"{tmp_path}/json").rglob("*.txt")))
    assert files == 3 if limit > 500 else 30 < files < 120


def test_keys_of_collections_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PART_BYTES", 10, raising=False)
    df = spark.createDataFrame([("a", "one two three four five six")], "name string, text string")
    other = spark.createDataFrame([("two three four five six",)], "body string")
    assert shuffles_of(curate.overlap_between(df, "name", "text"), "hi") == 1
    # One more for the distinct keys of the other collection.
    assert shuffles_of(curate.overlap_with(df, "name", "text", other, "body"), "hi") == 2


def test_masked_texts_are_not_masked_again(spark):
    rows = spark.createDataFrame([("d1", "a", "en", " x@y.org ", "mit"), ("d2", "b", "en", "x@y.org", "mit")], "row_id string, origin string, language string, text string, license string")
    cleaned = assembly.clean_stage(rows)
    assert "regexp_replace" not in plan_of(cleaned)
    assert [(r.row_id, r.text, r.lineage, r.copies) for r in cleaned.collect()] == [("d1", "[email]", ["a", "b"], 2)]


def test_marks_of_personal_data(spark):
    texts = ["a@b.co", "+1 (555) 123-4567", "10.0.0.1", "1234567890123456", "+1(555) 1.2.3", "@.", "", None, "x@y.zz 10.0.0.1 +12 (555) 123-4567 1234567890123456."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    counts = gates.pii_counts(df.t)
    got = [tuple(r) for r in df.select(gates.mask_pii(df.t), *counts.values()).collect()]
    one = [("[email]", 1, 0, 0, 0), ("[phone]", 0, 1, 0, 0), ("[ipv4]", 0, 0, 1, 0), ("[card]", 0, 0, 0, 1)]
    none = [("+1(555) 1.2.3", 0, 0, 0, 0), ("@.", 0, 0, 0, 0), ("", 0, 0, 0, 0), (None, None, None, None, None)]
    assert got == [*one, *none, ("[email] [ipv4] [phone] [card].", 1, 1, 1, 1)]


def test_lines_are_read_once(spark, tmp_path, monkeypatch):
    """Rejected lines, profile and measures come from one pass over the lines, verdicts from one table."""
    lines = [("a", '{"text": "x y", "n": 1}'), ("a", '{"text": " "}'), ("a", "[1]"), ("b", '{"k": "a@b.org"}'), ("b", '{"k":'), ("c", "{}"), ("d", "7")]
    spark.createDataFrame(lines, "name string, line string").write.parquet(f"{tmp_path}/lines")
    plans = {}
    kept = json_rows.Scratch.keep
    monkeypatch.setattr(json_rows.Scratch, "keep", lambda self, df, name: (plans.setdefault(name, plan_of(df)), kept(self, df, name))[1])
    rows = spark.read.parquet(f"{tmp_path}/lines")
    verdicts = spark.createDataFrame([("a", "PASS", "FAIL")], "name string, license string, critical_toxicity string")
    facts = json_rows.json_facts(readers.parse_json_lines(rows, "line"), "name", "row", language="lang", verdicts=verdicts)
    got = {r.name: r for r in facts.collect()}
    # The profile comes from the reduced rows and reads no line again.
    assert "parsejson" not in plans["columns"].lower() and "parsejson" in plans["narrow"].lower()
    assert {n: (r.row_count, r.rejected, r.missing_cells, r.fields, r.field_types, r.gate_pii) for n, r in got.items()} == {
        "a": (2, 1, 2, ["n", "text"], ["integer", "string"], "PASS"),
        "b": (1, 1, 0, ["k"], ["string"], "FAIL"),
        "c": (1, 0, 0, [], [], "PASS"),
    }
    assert (got["a"].gate_license, got["a"].critical_toxicity, got["b"].gate_license) == ("PASS", "FAIL", "USER_PROVIDED")


def test_released_keys_share_state(spark, tmp_path):
    """Rows without a time are dropped; keys and ids may be null, and whole numbers stay whole."""
    big = 2**53 + 1
    rows = [(i, 1_700_000_000 + 60 * i, i % 40 + big) for i in range(400)] + [(big, 1_700_000_100, None), (None, 1_700_000_160, big), (7, None, 5), (900, 1_700_100_000, 1)]
    spark.createDataFrame(rows, "id bigint, s bigint, k bigint").selectExpr("id", "timestamp_seconds(s) AS ts", "k").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id BIGINT, ts TIMESTAMP, k BIGINT").parquet(f"{tmp_path}/in")
    with jobs.rocksdb_state(spark):
        released = jobs.released_stream(stream, "k", "ts", "id", TokenBucket(capacity=1, token_us=10**12), "1 hour", groups=4)
        got = [(r.id, r.k, r.code) for r in jobs.run_to_files(released, f"{tmp_path}/out", f"{tmp_path}/state").collect()]
    order = sorted((r for r in rows[:402]), key=lambda r: (r[1], r[0] is not None and r[0] or 0))
    seen, want = set(), []
    for i, _, k in order:
        want.append((i, k, int(k not in seen)))
        seen.add(k)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_matches_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_MATCHES", 50, raising=False)
    queries = spark.createDataFrame([(q, "red bolt part") for q in range(5)], "q bigint, t string")
    docs = spark.createDataFrame([(d, f"red part {d}") for d in range(100)], "d bigint, t string")
    found = search.semantic_top_k(queries, "q", "t", docs, "d", "t", 3)
    assert any("REPARTITION_BY_NUM" in line and ", 21)" in line for line in plan_of(found).splitlines())
    assert sorted((r.q, r.d, r["rank"]) for r in found.collect()) == [(q, d, d + 1) for q in range(5) for d in range(3)]


def test_a_text_in_many_pairs_is_worked_off_once():
    seen, sets = [], curate.gram_sets(3)

    def counted(texts):
        seen.extend(texts)
        return sets(texts)

    a, b = b"one two three four five six seven", [b"one two three four five six seven", b"one two three four five", b"", b"x y"]
    assert buckets.similarity(counted, [a] * 4, b).tolist() == [1.0, 0.6, 0.0, 0.0]
    assert seen.count(a) == 2


@pytest.mark.parametrize("partners", [1, 4])
def test_a_slice_is_worked_off_once_per_block(spark, monkeypatch, partners):
    """A bucket of 12 slices: every pair of rows is in one block, every block begins with one slice."""
    monkeypatch.setattr(buckets, "SLICE", 10)
    monkeypatch.setattr(buckets, "PARTNERS", partners, raising=False)
    rows = spark.range(120).selectExpr("1L AS bucket", "id AS node", "id AS component")
    dealt = buckets._slices(rows, Scratch(spark, "t")).toPandas()
    pairs, slices = Counter(), 0
    for _, block in dealt.groupby("block"):
        assert set(block.side) in ({2}, {0, 1})
        first, others = block[block.side != 1].node.tolist(), block[block.side != 0].node.tolist()
        pairs.update({tuple(sorted((x, y))) for x in first for y in others if x != y})
        slices += len(block) / 10
    assert len(pairs) == 120 * 119 / 2 and set(pairs.values()) == {1}
    assert slices > 140 if partners == 1 else slices < 120


def test_few_texts_are_found_without_a_shuffle_of_all(spark, tmp_path, monkeypatch):
    plans = {}
    kept = Scratch.keep
    monkeypatch.setattr(curate.Scratch, "keep", lambda self, df, name: (plans.setdefault(name, plan_of(df)), kept(self, df, name))[1])
    monkeypatch.setattr(curate.overlap, "BROADCAST_KEYS", 5)
    for n in (2, 9):
        plans.clear()
        rows = [(i, f"a b c d e f g h i j k l m n o p {i} {'.' * i}") for i in range(n)]
        spark.createDataFrame(rows, "id bigint, text string").write.parquet(f"{tmp_path}/{n}")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            got = curate.near_duplicates(spark.read.parquet(f"{tmp_path}/{n}"), "id", "text").collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert {r.copy_of for r in got if r.id} == {0}
        assert ("Exchange hashpartitioning" in plans["texts"]) == (n > 5)


def test_hashes_of_words():
    words = ["a", "b", "ab", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "é", "日本語テキスト", "a\0", "a\0\0", "\0", "x" * 5000, "x" * 5001]
    found = hashing.word_hashes(words)
    assert len(set(found.tolist())) == len(words) and [hashing.word_hashes([w])[0] for w in words] == found.tolist()
    assert len(hashing.word_hashes([])) == 0
    # All words of a chunk may be one word, and all texts may be empty.
    row, key = curate.grams([b"", b"one", b"a b c d", b" ", b"One\xc2\xa0"], 3)
    assert row.tolist() == [1, 2, 2, 4] and key[0] == key[3] and len(set(key.tolist())) == 3
    assert [len(x) for x in curate.grams([b""], 3)] == [0, 0]
