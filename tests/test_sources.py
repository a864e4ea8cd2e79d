import json

import pytest
from pyspark.sql import functions as F

from gristmill import session
from gristmill.operators import process, profile
from gristmill.sources import readers, tables, writers


def test_csv_is_all_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,age,condition\nAsha, 42 ,diabetes\nRavi,,asthma\nAsha, 42 ,diabetes\n\nshort\n")
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), multi_line=True)
    clean = profile.normalize(rows.drop("_corrupt_record")).withColumn("ds", F.lit("d"))
    got = {r["column"]: r for r in profile.column_profile(clean, "ds").collect()}
    assert got["age"].missing_count == 2 and got["age"].type == "string" and got["age"].unique_count == 1
    stats = profile.dataset_stats(clean, "ds").first()
    assert stats.row_count == 4 and stats.duplicate_rows == 1 and stats.missing_cells == 3


def test_csv_keeps_surplus_fields_for_inspection(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n1,2,3\n')
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), multi_line=True).cache().collect()
    assert rows[0].b == "x\ny" and rows[1]["_corrupt_record"] is not None


@pytest.mark.parametrize(
    "doc,n",
    [([{"a": 1}, {"a": 2}], 2), ({"records": [{"a": 1}]}, 1), ({"data": {"x": 1}, "rows": [{"a": 1}, {"a": 3}]}, 2), ({"a": 5}, 1)],
)
def test_json_shapes(spark, tmp_path, doc, n):
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    rows = readers.read_json(spark, str(tmp_path / "d.json"))
    good, bad = readers.split_objects(rows)
    assert good.count() == n and bad.count() == 0


def test_json_reports_position_of_bad_row(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"a": 1}, 3]')
    _, bad = readers.split_objects(readers.read_json(spark, str(tmp_path / "d.json")))
    assert bad.first().position == 2


def test_jsonl_types(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"instruction": "a", "label": true, "n": 1}\n\n{"instruction": "b", "label": false, "n": 1.0}\n')
    rows = readers.read_jsonl(spark, str(tmp_path / "d.jsonl")).withColumn("ds", F.lit("d"))
    got = {r["column"]: r for r in profile.variant_profile(rows, "ds", "row").collect()}
    assert got["instruction"].type == "string" and got["label"].type == "boolean" and got["n"].type == "number"
    assert got["n"].unique_count == 2


def test_unknown_format_stops(spark):
    df = spark.createDataFrame([("a.xlsx",)], "p string").select(readers.require_format(F.col("p")))
    with pytest.raises(Exception, match="unsupported dataset format"):
        df.collect()


def test_explicit_format_wins(spark):
    row = spark.range(1).select(readers.detect_format(F.lit("a.txt"), F.lit("JSONL")).alias("f")).first()
    assert row.f == "jsonl"


def test_empty_datasets(spark):
    names = spark.createDataFrame([("a",), ("b",)], "ds string")
    rows = spark.createDataFrame([("a", 1)], "ds string, x int")
    assert [r.ds for r in readers.empty_datasets(names, rows, "ds").collect()] == ["b"]


def test_jsonl_sink_sorts_keys_and_keeps_nulls(spark, tmp_path):
    out = str(tmp_path / "o")
    writers.write_jsonl(spark.createDataFrame([(None, "x")], "b string, a string"), out)
    assert spark.read.text(out).first().value == '{"a":"x","b":null}'


@pytest.mark.parametrize("fmt", ["jsonl", "csv", "parquet"])
def test_export_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([("x", "1"), ("y", None)], "a string, b string")
    writers.export(df, str(tmp_path / fmt), fmt)
    reader = spark.read.schema(df.schema)
    back = reader.option("header", "true").csv(str(tmp_path / fmt)) if fmt == "csv" else getattr(reader, "parquet" if fmt == "parquet" else "json")(str(tmp_path / fmt))
    assert sorted(back.collect()) == sorted(df.collect())


def test_export_rejects_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.export(spark.range(1), str(tmp_path / "x"), "xlsx")


def test_candidates_when_no_rows(spark):
    empty = spark.createDataFrame([], "a string")
    candidates = spark.createDataFrame([("c",)], "id string")
    assert writers.rows_or_candidates(empty, candidates).columns == ["id"]


def test_process_and_package(spark, tmp_path):
    raw = spark.createDataFrame(
        [("up.csv", " Say hi ", "Hello there", "english"), ("up.csv", "Say bye", "Good bye", "english")],
        "ds string, instruction string, response string, language string",
    )
    frames = process.process_collection(raw, "ds", language="language")
    facts = frames["facts"].first()
    assert facts.row_count == 2 and facts.column_count == 3 and facts.score > 0 and facts.languages == ["english"]
    manifest = writers.package(frames, str(tmp_path / "pkg"), "run-9")
    listed = spark.read.json(manifest).collect()
    assert {r.run_id for r in listed} == {"run-9"} and all(len(r.sha256) == 64 for r in listed)
    assert any("report=quality_report" in r.artifact for r in listed)
    assert writers.list_reports(spark, str(tmp_path / "pkg/reports")).count() == 7
    written = spark.read.json(str(tmp_path / "pkg/reports")).where("name = 'up.csv' and report = 'dataset_intelligence_report'").collect()
    assert "Rows: 2" in written[0].text and "Certification: none" in written[0].text


def test_upsert_many_rows_loses_nothing(spark):
    base = spark.createDataFrame([], "id long, v string, version long")
    changes = spark.range(200).selectExpr("id", "concat('v', id) AS v", "1L AS version")
    after = tables.upsert(base, changes, ["id"], "version")
    again = tables.upsert(after, changes.selectExpr("id", "'new' AS v", "2L AS version").where("id < 50"), ["id"], "version")
    assert again.count() == 200 and again.where("v = 'new'").count() == 50


def test_snapshot_defaults(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "s.json").write_text('{"dataset_id": "a", "title": "t"}\n')
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("dataset_id", "title", "provider")])
    row = readers.read_snapshot(spark, str(tmp_path / "s.json"), schema, {"provider": "local"}).first()
    assert row.provider == "local"


def test_no_temporary_checkpoint_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
