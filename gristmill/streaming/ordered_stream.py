"""State rules over a stream, in event-time order across micro-batches and safe for hot keys.

Each micro-batch is cut to narrow rows once. Rows that the watermark has not passed wait in a
table; those it has passed are run in order by the batch scan, which spreads a key with very many
events over many tasks. What a key is left in goes into a state table. Every step writes folders
named by the micro-batch and reads those of the one before, so a micro-batch that is repeated
after a failure overwrites its own result and nothing is counted twice. States that mean the same
as none are dropped once the watermark has passed them, so idle keys don't pile up.

The input of a trigger is bounded by the reader's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.streaming.machines import FOREVER, NEVER
from gristmill.streaming.ordered_scan import scan_with_states


class OrderedStream:
    """A rule's outcome for every event of a stream, kept below ``folder``.

    Events more than ``late_us`` microseconds older than the newest one seen before their
    micro-batch come too late if their time has been released; they are written apart. An event
    without time is never in time.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, ts: str, event_id: str, rule, late_us: int, flag: str | None = None):
        self.spark, self.folder, self.rule, self.late_us = spark, folder.rstrip("/"), rule, late_us
        self.key, self.ts, self.event_id, self.flag = key, ts, event_id, flag

    def _path(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def _write(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        path = self._path(table, batch)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _mark(self, batch: int) -> int:
        """Time up to which events have been released after a micro-batch."""
        if batch < 0:
            return NEVER
        rows = self.spark.read.schema("mark BIGINT").json(self._path("mark", batch)).collect()
        return rows[0]["mark"]

    def _before(self, table: str, schema, batch: int) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(table, batch))

    def _narrow(self, events: DataFrame) -> DataFrame:
        return events.select(
            F.col(self.key).alias("_key"),
            F.col(self.ts).cast("timestamp").alias("_at"),
            F.col(self.event_id).alias("_id"),
            (F.col(self.flag) if self.flag else F.lit(True)).alias("_flag"),
        )

    def step(self, events: DataFrame, batch: int, final: bool = False) -> None:
        """One micro-batch; ``final`` releases all that waits and takes no further one."""
        arrived = self._write(self._narrow(events), "arrived", batch)
        before = max((n for n in self._done() if n < batch), default=-1)
        mark = self._mark(before)
        newest = arrived.agg(F.max(F.unix_micros("_at"))).first()[0]
        new_mark = FOREVER if final else max(mark, (newest if newest is not None else NEVER) - self.late_us)
        in_time = F.coalesce(F.unix_micros("_at") >= mark, F.lit(False))
        self._write(arrived.where(~in_time), "late", batch)
        waiting = self._before("waiting", arrived.schema, before).unionByName(arrived.where(in_time))
        passed = F.unix_micros("_at") < new_mark
        self._write(waiting.where(~passed), "waiting", batch)
        state_schema = f"_key {arrived.schema['_key'].dataType.simpleString()}, _time bigint, _count bigint"
        states = self._before("state", state_schema, before)
        scanned = self._write(
            scan_with_states(waiting.where(passed), "_key", "_at", "_id", self.rule, "_flag", states), "scan", batch
        )
        # A key has one last row per partition, at most.
        left = scanned.where("_last").groupBy("_key").agg(
            F.max_by(F.struct("_time", "_count"), F.struct("_t", "_id")).alias("s")
        ).select("_key", "s._time", "s._count")
        self._write(left.where((F.col("_count") != 0) | (F.col("_time") > new_mark)), "state", batch)
        line = json.dumps({"mark": new_mark})
        self.spark.range(1).select(F.lit(line).alias("value")).coalesce(1).write.mode("overwrite").text(self._path("mark", batch))
        # A repeated micro-batch needs the tables of the one before, nothing needs older ones.
        for older in [n for n in self._done() if n < before]:
            for table in ("arrived", "waiting", "state"):
                self._delete(self._path(table, older))

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Process what is available, trigger by trigger."""

        def on_batch(events: DataFrame, batch: int) -> None:
            self.step(events, batch)

        started = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        started.awaitTermination()
        if started.exception():
            raise started.exception()

    def finish(self, empty: DataFrame) -> None:
        """The stream is at its end: what still waits is released."""
        last = max(self._done(), default=-1)
        if last >= 0 and self._mark(last) != FOREVER:
            self.step(empty, last + 1, final=True)

    def _folder(self, path: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        path, system = self._folder(path)
        system.delete(path, True)

    def _done(self) -> list[int]:
        """Micro-batches whose mark, written last, is complete."""
        path, system = self._folder(f"{self.folder}/mark")
        if not system.exists(path):
            return []
        marks = [s.getPath() for s in system.listStatus(path)]
        return [int(p.getName().partition("=")[2]) for p in marks if system.exists(self._folder(f"{p}/_SUCCESS")[0])]

    def outcome(self, schema) -> DataFrame:
        """(event_id, key, ts, code) of all released events; ``schema`` is that of the stream."""
        key, event_id = schema[self.key].dataType.simpleString(), schema[self.event_id].dataType.simpleString()
        scanned = self.spark.read.schema(f"_id {event_id}, _key {key}, _t bigint, code int").parquet(f"{self.folder}/scan")
        return scanned.where(F.col("_t") != NEVER).select(
            F.col("_id").alias(self.event_id),
            F.col("_key").alias(self.key),
            F.timestamp_micros("_t").cast(schema[self.ts].dataType).alias(self.ts),
            "code",
        )
