"""A chain of stages that can be stopped anywhere and taken up again.

Every stage writes its rows into a folder named by a key, and then a manifest. The key is a digest
of the stage's name and version and of the keys of its inputs; a source's key is a digest of its
files' names, sizes and times. A stage whose manifest exists is read and not run. Changed source
files, or a new version of a stage, give new keys for it and for all that follows, and leave the
older results alone. A folder without a manifest is the rest of a run that was stopped and is
overwritten.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "stage STRING, version STRING, key STRING, inputs MAP<STRING, STRING>, row_count BIGINT, checksum STRING, schema STRING"


@dataclass(frozen=True)
class Stage:
    """``run`` gets the frames of ``needs`` (sources or earlier stages) by name and returns its rows."""

    name: str
    needs: tuple[str, ...]
    run: Callable[..., DataFrame]
    version: str = "1"


def _digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def source_key(df: DataFrame) -> str:
    """Digest of the files a table is read from: names, sizes and times of change.

    What is selected from them is no part of it; give a source made in another way another name.
    """
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    files = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        files.append([name, status.getLen(), status.getModificationTime()])
    return _digest(files)


@dataclass
class StageRun:
    """Runs stages below ``folder``, a folder that driver and executors share."""

    spark: SparkSession
    folder: str
    ran: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)

    def run(self, sources: dict[str, DataFrame], stages: Sequence[Stage]) -> dict[str, DataFrame]:
        """The frames of all stages by name; only those without a finished result are computed."""
        keys = {name: source_key(df) for name, df in sources.items()}
        frames = dict(sources)
        for stage in stages:
            if stage.name in frames:
                raise ValueError(f"two inputs or stages are named {stage.name}")
            inputs = {name: keys[name] for name in stage.needs}
            key = _digest([stage.name, stage.version, inputs])
            place = f"{self.folder.rstrip('/')}/{stage.name}/{key}"
            done = self._finished(place)
            if done:
                self.skipped.append(stage.name)
            else:
                done = self._compute(stage, inputs, key, place, [frames[n] for n in stage.needs])
                self.ran.append(stage.name)
            keys[stage.name] = key
            frames[stage.name] = self.spark.read.schema(done["schema"]).parquet(f"{place}/rows")
        return {stage.name: frames[stage.name] for stage in stages}

    def _compute(self, stage: Stage, inputs: dict[str, str], key: str, place: str, frames: list[DataFrame]) -> dict:
        rows = stage.run(*frames)
        # Counted while writing; the sum doesn't depend on the order of rows.
        seen = Observation()
        observed = rows.observe(
            seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(20,0)")).cast("string").alias("sum")
        )
        observed.write.mode("overwrite").parquet(f"{place}/rows")
        counted = seen.get
        manifest = {
            "stage": stage.name,
            "version": stage.version,
            "key": key,
            "inputs": inputs,
            "row_count": counted["n"],
            "checksum": counted["sum"],
            "schema": rows.schema.json(),
        }
        line = self.spark.range(1).select(F.lit(json.dumps(manifest)).alias("value"))
        line.coalesce(1).write.mode("overwrite").text(f"{place}/manifest")
        return manifest | {"schema": rows.schema}

    def _finished(self, place: str) -> dict | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/manifest/_SUCCESS")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        manifest = json.loads(self.spark.read.text(f"{place}/manifest").first()[0])
        return manifest | {"schema": StructType.fromJson(json.loads(manifest["schema"]))}

    def history(self) -> DataFrame:
        """Manifests of all finished results below the folder, also those of earlier inputs and versions."""
        return self.spark.read.schema(MANIFEST).json(f"{self.folder.rstrip('/')}/*/*/manifest")
