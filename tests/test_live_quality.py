"""Running totals of micro-batches against scoring all rows at once."""

import json

import pytest

from gristmill.operators import json_rows, quality
from gristmill.sources import readers
from gristmill.streaming.live_quality import LiveQuality, dimensions
from test_json_rows import DATASETS

SCHEMA = "name string, position long, line string"


@pytest.fixture(scope="module")
def lines():
    out = [(name, i, json.dumps(r)) for name, rows in DATASETS.items() for i, r in enumerate(rows)]
    return out + [("pairs", 50, "{broken"), ("pairs", 51, "[1]"), ("only broken", 1, "nothing"), ("single", 77, "  ")]


def one_by_one(spark, folder, lines, cuts):
    live = LiveQuality(spark, folder)
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        live.ingest(spark.createDataFrame([x for x in lines if a <= x[1] < b], SCHEMA), number)
    return live


def result(live):
    return {r["name"]: r.asDict() for r in dimensions(live.totals()).collect()}


def test_totals_are_those_of_all_rows(spark, tmp_path, lines):
    live = one_by_one(spark, str(tmp_path / "live"), lines, [0, 2, 5, 6, 100])
    got = result(live)
    good, _ = readers.split_objects(readers.parse_json_lines(spark.createDataFrame(lines, SCHEMA), "line"))
    want = {r["name"]: r.asDict() for r in json_rows.json_quality(good, "name", "row", "position").collect()}
    for name, row in want.items():
        assert {k: got[name][k] for k in row} == row
    assert got["pairs"]["rejected"] == 2 and got["only broken"]["rejected"] == 1
    assert (got["only broken"]["ready"], got["only broken"]["row_count"], got["pairs"]["ready"]) == (False, 0, True)
    assert {(r["name"], r["line"], r["reason"]) for r in live.quarantine().collect()} == {
        ("pairs", "{broken", "not JSON"),
        ("pairs", "[1]", "not an object"),
        ("only broken", "nothing", "not JSON"),
    }


def test_a_repeated_micro_batch_counts_once(spark, tmp_path, lines):
    live = one_by_one(spark, str(tmp_path / "live"), lines, [0, 3, 100])
    before = result(live)
    live.ingest(spark.createDataFrame([x for x in lines if x[1] >= 3], SCHEMA), 1)
    assert result(live) == before
    # Totals without their mark are the rest of a stopped attempt.
    (tmp_path / "live/total/batch=1/_SUCCESS").unlink()
    assert result(live) != before
    live.ingest(spark.createDataFrame([x for x in lines if x[1] >= 3], SCHEMA), 1)
    assert result(live) == before and live.quarantine().count() == 3


def test_the_first_micro_batch_sets_the_structure(spark, tmp_path):
    lines = [("d", 1, '{"text": "one two"}'), ("d", 2, '{"instruction": "a b", "response": "c"}'), ("d", 3, '{"text": "one two"}')]
    row = result(one_by_one(spark, str(tmp_path / "live"), lines, [1, 2, 3, 4]))["d"]
    assert (row["structure"], row["row_count"], row["consistency"], row["diversity"]) == ("single", 3, 0.6667, 0.6667)
    assert row["model_compatibility"] == quality.BASE_COMPATIBILITY["single"]


def test_stream(spark, tmp_path, lines):
    for load in range(3):
        part = [x for x in lines if x[1] % 3 == load]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live = LiveQuality(spark, str(tmp_path / "live"))
    live.run(stream, str(tmp_path / "progress"))
    got = result(live)
    assert {n: got[n]["row_count"] for n in DATASETS} == {n: len(r) for n, r in DATASETS.items()}
    assert len(list((tmp_path / "live/total").glob("batch=*"))) == 3


def test_nothing_arrived(spark, tmp_path):
    live = LiveQuality(spark, str(tmp_path / "live"))
    assert dimensions(live.totals()).collect() == []
    live.ingest(spark.createDataFrame([], SCHEMA), 0)
    assert dimensions(live.totals()).collect() == [] and live.quarantine().collect() == []
