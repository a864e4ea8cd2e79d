"""Chains of stages: skipped when finished, taken up after a kill, run anew on change."""

import json
import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gristmill.operators import assembly
from gristmill.operators.stages import Stage, StageRun

ROOT = Path(__file__).resolve().parent.parent


def chain(calls, fail=None, version="1"):
    def step(name, change):
        def run(*frames):
            calls.append(name)
            if name == fail:
                raise RuntimeError("stopped")
            return change(*frames)

        return run

    return [
        Stage("double", ("numbers",), step("double", lambda n: n.select("id", (F.col("v") * 2).alias("v")))),
        Stage("odd", ("double",), step("odd", lambda d: d.where("id % 2 = 1")), version),
        Stage("joined", ("double", "odd"), step("joined", lambda d, o: d.join(o.select("id"), "id", "left_semi"))),
    ]


@pytest.fixture
def numbers(spark, tmp_path):
    path = str(tmp_path / "numbers")
    spark.range(100).selectExpr("id", "id * 10 AS v").write.parquet(path)
    return lambda: spark.read.parquet(path), path


def run(spark, tmp_path, numbers, stages):
    one = StageRun(spark, str(tmp_path / "run"))
    return one, one.run({"numbers": numbers[0]()}, stages)


def test_finished_stages_are_read(spark, tmp_path, numbers):
    calls = []
    first, frames = run(spark, tmp_path, numbers, chain(calls))
    want = sorted(map(tuple, frames["joined"].collect()))
    assert want == [(i, i * 20) for i in range(1, 100, 2)] and first.ran == calls == ["double", "odd", "joined"]
    again, frames = run(spark, tmp_path, numbers, chain(calls))
    assert (again.ran, again.skipped, len(calls)) == ([], ["double", "odd", "joined"], 3)
    assert sorted(map(tuple, frames["joined"].collect())) == want and frames["joined"].columns == ["id", "v"]


def test_a_failed_stage_is_taken_up(spark, tmp_path, numbers):
    calls = []
    with pytest.raises(RuntimeError, match="stopped"):
        run(spark, tmp_path, numbers, chain(calls, fail="odd"))
    after, frames = run(spark, tmp_path, numbers, chain(calls))
    assert (after.skipped, after.ran) == (["double"], ["odd", "joined"]) and frames["odd"].count() == 50


def test_rest_of_a_stopped_stage_is_overwritten(spark, tmp_path, numbers):
    first, frames = run(spark, tmp_path, numbers, chain([]))
    (manifest,) = (tmp_path / "run" / "odd").glob("*/manifest/_SUCCESS")
    manifest.unlink()
    (part,) = list((tmp_path / "run" / "odd").glob("*/rows/*.parquet"))[:1]
    part.rename(part.with_name("part-of-another-attempt.parquet"))
    after, frames = run(spark, tmp_path, numbers, chain([]))
    assert after.ran == ["odd"] and frames["odd"].count() == 50


def test_changes_run_what_follows(spark, tmp_path, numbers):
    run(spark, tmp_path, numbers, chain([]))
    newer, _ = run(spark, tmp_path, numbers, chain([], version="2"))
    assert (newer.skipped, newer.ran) == (["double"], ["odd", "joined"])
    spark.range(100, 110).selectExpr("id", "id * 10 AS v").write.mode("append").parquet(numbers[1])
    changed, frames = run(spark, tmp_path, numbers, chain([], version="2"))
    assert changed.ran == ["double", "odd", "joined"] and frames["joined"].count() == 55
    assert changed.history().groupBy("stage").count().where("stage <> 'double'").select("count").distinct().first()[0] == 3


def test_manifest_describes_the_rows(spark, tmp_path, numbers):
    _, frames = run(spark, tmp_path, numbers, chain([]))
    history = {r["stage"]: r for r in StageRun(spark, str(tmp_path / "run")).history().collect()}
    total = frames["odd"].agg(F.sum(F.xxhash64("id", "v").cast("decimal(20,0)")).cast("string")).first()[0]
    assert (history["odd"]["row_count"], history["odd"]["checksum"]) == (50, total)
    assert history["joined"]["inputs"] == {"double": history["double"]["key"], "odd": history["odd"]["key"]}
    assert json.loads(history["odd"]["schema"])["fields"][0]["name"] == "id"


def test_names_are_unique(spark, tmp_path, numbers):
    with pytest.raises(ValueError, match="named double"):
        run(spark, tmp_path, numbers, chain([])[:1] * 2)


def test_a_killed_process_is_taken_up(spark, tmp_path, numbers):
    """Another process is killed inside its third stage; this one runs only what it had not finished."""
    script = textwrap.dedent(f"""
        import os, signal, sys
        sys.path[:0] = [{str(ROOT)!r}, {str(ROOT / "tests")!r}]
        from gristmill.operators.stages import StageRun
        from gristmill.session import build_session
        from test_stages import chain
        spark = build_session("killed", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
        stages = chain([])
        stages[2] = type(stages[2])("joined", ("double", "odd"), lambda d, o: os.kill(os.getpid(), signal.SIGKILL))
        StageRun(spark, {str(tmp_path / "run")!r}).run({{"numbers": spark.read.parquet({numbers[1]!r})}}, stages)
    """)
    ended = subprocess.run([sys.executable, "-c", script], env=os.environ, capture_output=True, timeout=240)
    assert ended.returncode == -9
    after, frames = run(spark, tmp_path, numbers, chain([]))
    assert (after.skipped, after.ran) == (["double", "odd"], ["joined"])
    assert frames["joined"].count() == 50


ROWS = [
    ("d1", "a", "en", " Write to x@y.example "),
    ("d2", "a", "en", "twice"),
    ("d3", "b", "de", "twice "),
    ("d4", "b", "de", "  "),
    ("d5", "b", None, None),
    ("d6", "closed", "en", "not for us"),
    ("d7", "b", "fr", "write to [email]"),
]
CANDIDATES = [("a", "MIT"), ("b", "apache-2.0"), ("closed", "gpl-3.0"), ("nameless", None)]


def assembled(spark, tmp_path, rows, candidates=CANDIDATES):
    for name, data, schema in (
        ("rows", rows, "row_id string, origin string, language string, text string"),
        ("candidates", candidates, "origin string, license_name string"),
    ):
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(str(tmp_path / name))
    sources = {n: spark.read.parquet(str(tmp_path / n)) for n in ("rows", "candidates")}
    one = StageRun(spark, str(tmp_path / "stages"))
    return one, one.run(sources, assembly.stages(str(tmp_path / "corpus"), [("en", 2), ("de", 1)]))


def test_assembly(spark, tmp_path):
    _, frames = assembled(spark, tmp_path, ROWS)
    got = {r["row_id"]: r for r in assembly.read_export(spark, str(tmp_path / "corpus")).collect()}
    assert {i: (r["text"], r["lineage"], r["license"]) for i, r in got.items()} == {
        "d1": ("Write to [email]", ["a"], "mit"),
        "d2": ("twice", ["a", "b"], "mit"),
        "d7": ("write to [email]", ["b"], "apache-2.0"),
    }
    assert frames["clean"].where("row_id = 'd2'").first()["copies"] == 2
    told = {(r["stage"], r["subject"], r["measure"]): r["value"] for r in assembly.summary(frames).collect()}
    assert told["license", "closed", "status"] == "REJECTED" and told["license", "nameless", "status"] == "UNKNOWN"
    assert (told["coverage", "de", "short_by"], told["coverage", "en", "coverage"]) == ("1", "1.0")
    assert (told["validate", "closed", "ready"], told["validate", "b", "mode"]) == ("false", "dataset")
    assert told["score", "a", "row_count"] == "2"
    assert all(len(r["sha256"]) == 64 for r in frames["format"].collect())


def test_assembly_without_rows_exports_candidates(spark, tmp_path):
    _, frames = assembled(spark, tmp_path, [r for r in ROWS if r[0] in ("d4", "d5", "d6")])
    exported = [json.loads(line) for f in (tmp_path / "corpus").glob("*.json") for line in f.read_text().splitlines()]
    assert sorted(r["origin"] for r in exported) == ["a", "b"]
    modes = {r["origin"]: (r["ready"], r["mode"]) for r in frames["validate"].collect()}
    assert modes["a"] == (True, "metadata") and modes["closed"] == (False, "metadata")
    again, _ = assembled(spark, tmp_path, ROWS)
    assert "clean" in again.ran and assembly.read_export(spark, str(tmp_path / "corpus")).count() == 3
