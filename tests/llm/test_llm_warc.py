"""WARC archives: exact round trips, predicates, foreign files."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from gristmill.llm import shared_files, warc
from gristmill.scratch import Scratch

LONG, OTHER = "<p>é" + "x" * 1500, "y" * 1000
PAGES = [
    (1, "http://a/\r\nX: y", LONG),
    (5, None, LONG),
    (3, "http://b", LONG),
    (4, "http://c", "short"),
    (6, "http://d", "short"),
    (7, "http://e", None),
    (8, "http://f", ""),
    (9, "http://g", OTHER),
    (10, "http://h", OTHER),
    (10, "http://h", OTHER),
    (11, "http://i", "z" * 300_000),
    (None, "http://j", "null id"),
]


def expected(rows):
    out = []
    for page, _, html in rows:
        body = html or ""
        first = max((p for p, _, h in rows if (h or "") == body and p is not None), default=None)
        revisit = len(body.encode()) >= 1000 and page != first
        digest = hashlib.sha1(body.encode()).hexdigest()
        out.append((page, len(body.encode()), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "p", "t") for r in rows], "page_id bigint, url string, html string, payload string, type string")


@pytest.mark.parametrize("file_bytes", [1 << 26, 500])
def test_round_trip(spark, monkeypatch, file_bytes):
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    folder = Scratch(spark, "warc-test").folder
    warc.write_pages(pages(spark), folder)
    out = warc.read_pages(spark, folder).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in out), key=str) == expected(PAGES)
    targets = {r["page_id"]: r["target_uri"] for r in out}
    assert targets[1] == "http://a/ X: y" and targets[5] is None


def test_no_pages(spark):
    folder = Scratch(spark, "warc-test").folder
    warc.write_pages(pages(spark, []), folder)
    assert warc.read_pages(spark, folder).count() == 0


def record(kind, n, body):
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{n}>"), ("WARC-Target-URI", f"http://host{n % 2}/{n}")]
    return warc.header_block(fields, len(body)) + body + b"\r\n\r\n"


def test_foreign_archives_and_predicates(spark, tmp_path):
    bodies = [(k, n, bytes([65 + n % 26]) * (n * 700)) for n, k in enumerate(["response", "request", "metadata"] * 6)]
    (tmp_path / "plain.warc").write_bytes(b"".join(record(k, n, b) for k, n, b in bodies))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(record(k, n + 100, b)) for k, n, b in bodies))
    (tmp_path / "cut.warc").write_bytes(record("response", 300, b"whole") + b"WARC/1.1\r\nWARC-Type: resp")
    (tmp_path / "notes.txt").write_bytes(b"not an archive")
    warc.register(spark)
    source = spark.read.format("warc").load(str(tmp_path))
    assert source.count() == 37
    got = source.where("type = 'response' and target_uri like 'http://host1%' and content_length > 0")
    assert sorted((r["record_id"], bytes(r["payload"])) for r in got.collect()) == sorted(
        (f"<urn:{n + more}>", b) for more in (0, 100) for k, n, b in bodies if k == "response" and (n + more) % 2 and b
    )
    bare = spark.read.format("warc").option("payload", "none").load(str(tmp_path))
    assert bare.where("record_id in ('<urn:3>', '<urn:103>')").select("payload", "content_length").collect() == [(None, 2100)] * 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan or "EqualTo" in plan or "warc" in plan.lower()


@pytest.mark.parametrize("per_member", [1, 2, 5, 100])
def test_members_of_several_records(tmp_path, per_member):
    """Payloads that look like headers, empty ones and ones larger than what is inflated at a time."""
    bodies = [b"", b"a\r\n\r\nWARC/1.1\r\n\r\nb", b"\r\n\r\n", bytes(range(256)) * 900, b"last"] * 4
    every = [record("response" if n % 2 else "request", n, b) for n, b in enumerate(bodies)]
    members = [b"".join(every[i : i + per_member]) for i in range(0, len(every), per_member)]
    path = tmp_path / "several.warc.gz"
    path.write_bytes(b"".join(map(gzip.compress, members)))
    for payload in (True, False):
        for wanted in (lambda h: True, lambda h: h["WARC-Type"] == "response"):
            with open(path, "rb") as f:
                got = [(h["WARC-Record-ID"], b) for h, b in warc.records(f, path.stat().st_size, wanted, payload)]
            kept = [(f"<urn:{n}>", b if payload else None) for n, b in enumerate(bodies) if n % 2 or wanted({"WARC-Type": ""})]
            assert got == kept


def test_predicates_reach_the_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = warc.WarcReader("/nowhere", True)
    rest = GreaterThan(("content_length",), 5)
    assert list(reader.pushFilters([EqualTo(("type",), "response"), rest, In(("record_id",), ("a", "b"))])) == [rest]
    assert reader._wanted({"WARC-Type": "response", "WARC-Record-ID": "b"})
    assert not reader._wanted({"WARC-Type": "response", "WARC-Record-ID": "c"}) and not reader._wanted({})


def test_files_of_unfinished_writes_are_not_read(spark):
    folder = Scratch(spark, "warc-test").folder
    warc.write_pages(pages(spark, PAGES[:2]), folder)
    shared_files.write(f"{folder}/lost.warc.gz", warc.gzip_member(record("response", 1, b"lost attempt")))
    assert warc.read_pages(spark, folder).count() == 2
    assert spark.read.format("warc").load(folder).where(F.col("record_id") == "<urn:1>").count() == 0
