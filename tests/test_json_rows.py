"""Schema-less JSON rows against a row-by-row model."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from gristmill.operators import json_rows, quality
from gristmill.sources import readers

CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
LONG = "word " * 5000

DATASETS = {
    "pairs": [{"instruction": f"say it {i}", "response": f"it is {i}"} for i in range(20)],
    "blanks": [{"instruction": f"say it {i}", "response": "  " if i < 2 else f"it is {i}"} for i in range(10)],
    "same": [{"instruction": "same", "response": "same"}] * 10,
    "ragged": [{"instruction": "a b", "response": f"c {i}", **({"extra": "z"} if i == 5 else {})} for i in range(10)],
    "padded": [{"instruction": f"  padded {i}  ", "response": f"trailing {i}\t"} for i in range(10)],
    "long": [{"instruction": LONG, "response": LONG}] * 5,
    "single": [{"text": f"a sentence number {i}"} for i in range(10)],
    "numbers": [{"foo": i, "bar": i * 2} for i in range(10)],
    # The first row decides, also against most of the others.
    "first": [{"content": "only text"}] + [{"instruction": "x y", "response": "z z"}] * 6,
    "precedence": [{"input": "i j", "output": "o p", "text": "t", "question": "q", "answer": "a b"}] * 3,
    "kinds": [
        {"prompt": True, "completion": 1.5},
        {"prompt": ["a", {"b": None}], "completion": {"x": " y "}},
        {"prompt": None, "completion": ""},
        {"completion": "bell\x07", "prompt": "é ß"},
        {"prompt": "1.5"},
        {},
    ],
    "empty": [{}, {}],
}


def words(text):
    return text.split()


def as_text(value):
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def model(rows):
    first = rows[0]
    kind, fields = "none", ()
    for pair in quality.FIELD_PAIRS:
        if kind == "none" and all(f in first for f in pair):
            kind, fields = "pair", pair
    for f in quality.SINGLE_TEXT_FIELDS:
        if kind == "none" and f in first:
            kind, fields = "single", (f,)
    n = len(rows)
    texts = [" ".join(as_text(r.get(f)) for f in fields).strip() if fields else json.dumps(r, sort_keys=True) for r in rows]
    values = [v for r in rows for v in r.values()]
    clean = [v for v in map(lambda v: "" if v is None else as_text(v), values) if v and v == v.strip() and not CONTROL.search(v)]
    over = sum(math.ceil(len(words(t)) / 0.75) > 2048 for t in texts)
    dims = {
        "completeness": sum(all(as_text(r.get(f)).strip() for f in fields) for r in rows) / n if fields else 0.0,
        "consistency": sum(set(r) == set(first) for r in rows) / n,
        "diversity": len(set(texts)) / n,
        "duplicate_ratio": len(set(texts)) / n,
        "formatting": len(clean) / len(values) if values else 0.0,
        "readability": sum(2 <= len(words(t)) <= 400 for t in texts) / n if fields else 0.0,
        "model_compatibility": quality.BASE_COMPATIBILITY[kind] * (1 - over / n),
    }
    overall = sum(dims[d] * w for d, w in quality.WEIGHTS.items())
    return {"structure": kind, "row_count": n, "overall": overall, **dims}


@pytest.fixture(scope="module")
def parsed(spark):
    lines = [(name, i, json.dumps(r)) for name, rows in DATASETS.items() for i, r in enumerate(rows)]
    lines += [("ragged", 99, "{broken"), ("ragged", 98, "[1]"), ("only broken", 1, "nothing"), ("single", 77, "  ")]
    return readers.parse_json_lines(spark.createDataFrame(lines[::-1], "name string, position int, line string"), "line").cache()


def test_scores(parsed):
    good, _ = readers.split_objects(parsed)
    got = {r["name"]: r.asDict() for r in json_rows.json_quality(good, "name", "row", "position").collect()}
    assert got.keys() == DATASETS.keys()
    for name, rows in DATASETS.items():
        for key, value in model(rows).items():
            assert got[name][key] == pytest.approx(value, abs=0.006) if key != "structure" else got[name][key] == value, (name, key)


def test_large_dataset_is_spread(spark):
    rows = spark.range(3000).select(
        F.lit("a").alias("name"), "id", F.parse_json(F.to_json(F.struct(F.concat(F.lit("t "), "id").alias("text")))).alias("row")
    )
    (got,) = json_rows.json_quality(rows, "name", "row", "id").collect()
    assert (got["row_count"], got["diversity"], got["structure"]) == (3000, 1.0, "single")


def test_no_rows(parsed):
    assert json_rows.json_quality(parsed.limit(0), "name", "row", "position").collect() == []
    assert json_rows.json_facts(parsed.limit(0), "name", "row").collect() == []


def test_normalized_rows(spark):
    df = spark.sql("""SELECT parse_json('{"a": " x ", "b": "  ", "c": null, "d": {"e": " y "}, "f": 1.0, "g": false}') AS v""")
    assert json.loads(df.select(F.to_json(json_rows.normalized(F.col("v")))).first()[0]) == {"a": "x", "d": {"e": " y "}, "f": 1.0, "g": False}


def test_facts(parsed):
    got = {r["name"]: r for r in json_rows.json_facts(parsed, "name", "row").collect()}
    assert got.keys() == DATASETS.keys()
    ragged = got["ragged"]
    assert (ragged["row_count"], ragged["rejected"], ragged["schema_parse"]) == (10, 2, "FAIL")
    assert (ragged["fields"], ragged["field_types"]) == (["extra", "instruction", "response"], ["string"] * 3)
    # The field of one row is a field of all, so nine cells are missing and no row is ragged.
    assert (ragged["missing_cells"], ragged["consistency"], ragged["formatting"]) == (9, 100, 70)
    assert (got["same"]["duplicate_rows"], got["blanks"]["missing_cells"], got["blanks"]["completeness"]) == (9, 2, 80)
    kinds = got["kinds"]
    assert (kinds["fields"], kinds["field_types"], kinds["missing_cells"]) == (["completion", "prompt"], ["mixed", "mixed"], 5)
    # After stripping, padded texts are clean, and rows whose values are all missing are copies.
    assert (got["padded"]["formatting"], kinds["duplicate_rows"], got["empty"]["duplicate_rows"]) == (100, 1, 1)
    # Over all rows "first" has a pair, which precedes its first row's single field.
    assert got["first"]["completeness"] == 86


def test_certificate_needs_every_gate(spark):
    rows = [("good", {"instruction": f"say it {i}", "response": f"it is {i}", "language": "en"}) for i in range(20)]
    rows += [("leaky", {"instruction": f"say it {i}", "response": "write to a.b@c.example"}) for i in range(20)]
    rows += [("unjudged", {"instruction": f"say it {i}", "response": f"it is {i}"}) for i in range(20)]
    lines = spark.createDataFrame([(n, json.dumps(r)) for n, r in rows], "name string, line string")
    verdicts = spark.createDataFrame(
        [("good", "PASS", "PASS"), ("leaky", "PASS", "PASS")], "name string, license string, critical_toxicity string"
    )
    facts = json_rows.json_facts(readers.parse_json_lines(lines, "line"), "name", "row", verdicts=verdicts)
    texts = {(r["name"], r["report"]): r["text"] for r in json_rows.json_reports(facts).collect()}
    intelligence = {n: texts[n, "dataset_intelligence_report"].split("Certification: ")[1].strip() for n in ("good", "leaky", "unjudged")}
    assert intelligence == {"good": "Research Ready", "leaky": "none", "unjudged": "none"}
    assert "- pii: FAIL" in texts["leaky", "quality_report"] and "- license: USER_PROVIDED" in texts["unjudged", "quality_report"]
    assert "Languages: en" in texts["good", "bias_report"]
