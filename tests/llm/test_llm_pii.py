"""Spans and masks against Python's own matcher."""

import re

import pytest

import __spark_entry__ as entry
from gristmill.llm import pii
from oracle_compare import compare, connect

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def expected(text):
    text = text or ""
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text) if valid(k, m[0])]


TEXTS = [
    None,
    "",
    "a@b.c_d@e.f x.y%z@mail-7.example.com. @no a@b no@dot. é🤦 q@r.st",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 001.02.3.4 0000.0.0.0 12.1.2.3é9.9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111111111111111, 4111  1111 1111 1111 79927398713",
    "+1 (555) 123-4567 ++49 30 1234567 +1 +123456789012345 +1234567890123456 +1 234 567 89 (",
    "call me at 030 123 4567 today; and so on for more than forty characters, 030 123 4567 is a sum",
    "IBAN DE89 3704 0044 0532 0130 00 ok, GB82WEST12345698765432, DE88370400440532013000 wrong",
    "9" * 30_000 + " " + "a" * 50_000 + "@x " + "1-" * 10_000,
    "z@y.xx " * 3000,
    "é" * 200 + " m@n.op " + "🤦" * 50 + "1.1.1.1",
]
SCHEMA = "doc_id bigint, text string, pii string, n_chars bigint, kind string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "old", len(t or ""), "k") for i, t in enumerate(texts)], SCHEMA)


def test_base_spans(spark):
    out = pii.find(frame(spark, TEXTS + TEXTS[:3]), "text").collect()
    base = {k.name for k in pii.KINDS if k.base}
    for r in out:
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii"] if s["kind"] in base] == expected(r["text"])
        assert all(0 < s["score"] <= 1 for s in r["pii"])
    added = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["pii"] if s["kind"] not in base] for r in out}
    assert added[6] == ["030 123 4567"]
    assert added[7] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert pii.find(frame(spark, []), "text").count() == 0


def test_masks(spark):
    out = pii.mask(frame(spark, TEXTS), "text", "n_chars").collect()
    for r, text in zip(sorted(out, key=lambda r: r["doc_id"]), TEXTS):
        if text is None:
            assert r["text"] is None
            continue
        assert r["n_chars"] == len(r["text"])
    texts = {r["doc_id"]: r["text"] for r in out}
    assert texts[10] == "é" * 200 + " <EMAIL> " + "🤦" * 50 + "<IP>"
    assert texts[9] == "<EMAIL> " * 3000
    assert texts[7].startswith("IBAN <IBAN> ok, <IBAN>, DE88")
    spans = pii.find(frame(spark, ["+4111 1111 1111 1111 1 x"]), "text").collect()[0]["pii"]
    assert spans is not None


@pytest.mark.parametrize("values", [[], [3], list(range(1000))])
def test_running_totals(spark, values):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(values,)], "v array<int>")
    got = df.select(pii.running(F.col("v"), F.lit(0), lambda a, x: a + x).alias("r")).collect()[0]["r"]
    assert got == [sum(values[:i]) for i in range(len(values))]


def test_sql_twin_on_odd_texts(spark, tmp_path):
    # The twin's own sums are slow on very many matches of one text.
    frame(spark, [t for t in TEXTS if len(t or "") < 5000]).coalesce(1).write.parquet(str(tmp_path / "d"))
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    (tmp_path / "documents.parquet").symlink_to(tmp_path / "d")
    assert compare(spark, con, str(tmp_path), entry.queries()["op8_pii"], entry.oracle_sql()["op8_pii"]) is None
