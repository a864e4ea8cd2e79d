"""Time-driven checks over streams of events, and their batch forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gristmill.operators import profile
from gristmill.operators.sketches import quantile, values_sketch
from gristmill.sources import readers
from gristmill.streaming.machines import START

STATE_SCHEMA = "time bigint, count bigint"


def keyed_stream(
    events: DataFrame, key: str, ts: str, event_id: str, rule, flag: str | None = None, late: str | None = None
) -> DataFrame:
    """The rule's outcome code for every event of a stream, state kept per key.

    Events of one micro-batch are taken in time order; across batches in order of arrival.
    With ``late``, events later than that are dropped and the state of a key is removed once
    the watermark has passed the time it speaks of, so idle keys do not pile up.
    """
    key_type = events.schema[key].dataType.simpleString()
    id_type = events.schema[event_id].dataType.simpleString()

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        current = tuple(state.get) if state.exists else START
        arrived = pd.concat(list(batches)).sort_values(["_t", "_id"])
        codes = []
        for t, ok in zip(arrived["_t"], arrived["_flag"]):
            current, code = rule.step(current, int(t), bool(ok))
            codes.append(code)
        state.update(current)
        # A past time with an empty counter means the same as no state.
        if late and current[1] == 0:
            state.setTimeoutTimestamp(max(current[0] // 1000, state.getCurrentWatermarkMs()) + 1000)
        yield pd.DataFrame({"_id": arrived["_id"], "_key": keys[0], "_t": arrived["_t"], "code": codes})

    source = events.withWatermark(ts, late) if late else events
    prepared = source.select(
        F.col(key).alias("_key"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"),
        F.col(event_id).alias("_id"),
        (F.col(flag) if flag else F.lit(True)).alias("_flag"),
        ts,
    )
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    outcome = prepared.groupBy("_key").applyInPandasWithState(
        update, f"_id {id_type}, _key {key_type}, _t bigint, code int", STATE_SCHEMA, "append", timeout
    )
    return outcome.select(
        F.col("_id").alias(event_id), F.col("_key").alias(key), F.timestamp_micros("_t").cast(events.schema[ts].dataType).alias(ts), "code"
    )


def _outcomes(events: list[tuple], codes: list[int]) -> pd.DataFrame:
    """Columns of plain objects: texts of the library's own type don't fit into a struct."""
    return pd.DataFrame(
        {
            "event": pd.Series([e[1] if e[2] else None for e in events], dtype=object),
            "entity": pd.Series([e[4] for e in events], dtype=object),
            "micros": pd.Series([e[0] for e in events], dtype="int64"),
            "code": pd.Series(codes, dtype="int64"),
        }
    )


class _Released(StatefulProcessor):
    """Buffers the events of some keys and runs the rule over each key's once the watermark has passed them."""

    def __init__(self, rule, id_type: str):
        self.rule, self.id_type = rule, id_type

    def init(self, handle) -> None:
        self.handle = handle
        self.states = handle.getListState("states", f"entity string, {STATE_SCHEMA}")
        self.waiting = handle.getListState(
            "waiting", f"micros bigint, event {self.id_type}, named boolean, flag boolean, entity string"
        )

    def _wake(self, first_us: int, now_ms: int) -> None:
        """One timer, for the earliest waiting event; one that has expired goes."""
        at = max(first_us // 1000 + 1, now_ms + 1)
        for timer in list(self.handle.listTimers()):
            if now_ms < timer <= at:
                return
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N803
        first = None
        for batch in rows:
            arrived = list(zip(*(batch[c].tolist() for c in ("micros", "event", "named", "flag", "entity"))))
            if arrived:
                self.waiting.appendList(arrived)
                least = min(e[0] for e in arrived)
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first, timerValues.getCurrentWatermarkInMs())
        yield _outcomes([], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: e[:3])
        ready = [e for e in events if e[0] < mark]
        rest = events[len(ready) :]
        states = {entity: (time, count) for entity, time, count in self.states.get()} if self.states.exists() else {}
        codes = []
        for t, _, _, flag, entity in ready:
            states[entity], code = self.rule.step(states.get(entity, START), int(t), bool(flag))
            codes.append(code)
        # A past time with an empty counter means the same as no state.
        awaited = {e[4] for e in rest}
        kept = [(e, *s) for e, s in states.items() if s[1] != 0 or s[0] > mark or e in awaited]
        if kept:
            self.states.put(kept)
        else:
            self.states.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0], timerValues.getCurrentWatermarkInMs())
        else:
            self.waiting.clear()
        yield _outcomes(ready, codes)

    def close(self) -> None:
        pass


def released_stream(
    events: DataFrame, key: str, ts: str, event_id: str, rule, late: str, flag: str | None = None, groups: int = 512
) -> DataFrame:
    """The rule's outcome code for every event of a stream, in event-time order across micro-batches.

    Events wait in state until the watermark, ``late`` behind the newest event, has passed them;
    later ones, and those without a time, are dropped. Keys are dealt to ``groups``, which hold
    their keys' events and states together: a state costs a few calls a group and not a key. One
    task holds what waits of a group, so this form is for keys of bounded rate; ``ordered_stream``
    also serves a key that has most events. Needs the RocksDB state store.
    """
    key_type = events.schema[key].dataType
    id_type = events.schema[event_id].dataType.simpleString()
    entity = F.col(key).cast("string")
    prepared = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(
        F.pmod(F.xxhash64(entity), F.lit(groups)).alias("keys"),
        entity.alias("entity"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"),
        # A null would turn whole numbers of a batch into floating ones.
        F.coalesce(F.col(event_id), F.lit(0).cast(id_type)).alias("event"),
        F.col(event_id).isNotNull().alias("named"),
        (F.col(flag) if flag else F.lit(True)).alias("flag"),
        ts,
    )
    outcome = prepared.groupBy("keys").transformWithStateInPandas(
        _Released(rule, id_type), f"event {id_type}, entity string, micros bigint, code int", "append", "eventTime"
    )
    return outcome.select(
        F.col("event").alias(event_id), F.col("entity").cast(key_type).alias(key),
        F.timestamp_micros("micros").cast(events.schema[ts].dataType).alias(ts), "code",
    )


def drop_repeats(events: DataFrame, keys: list[str], ts: str, delay: str = "300 seconds") -> DataFrame:
    """Cheap repeat suppression of a stream: repeats within the delay are dropped for sure, later ones perhaps."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def rolling_metrics(events: DataFrame, metric: str, ts: str, value: str, length: str, slide: str | None = None,
                    late: str | None = None) -> DataFrame:
    """Count, sum, min, max, mean and p95 per metric and time window; batch or stream.

    The percentile comes from a sketch: exact up to ``SKETCH_K`` values in a window, then within
    its rank error.
    """
    source = events.withWatermark(ts, late) if late else events
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (
        source.groupBy(window.alias("w"), metric)
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.bround(F.sum(value), 4).alias("sum"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.bround(F.avg(value), 8).alias("avg"),
            values_sketch(value).alias("sketch"),
        )
        .select(metric, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "count", "sum", "min", "max", "avg", quantile("sketch", 0.95).alias("p95"))
    )


def session_stream(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Activity sessions of a stream; a session ends when nothing follows within the gap."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("s"), key)
        .agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        .select(key, "first_ts", "last_ts", "n_events")
    )


def sessions(events: DataFrame, key: str, ts: str, gap_us: int, slice_us: int = 3_600_000_000) -> DataFrame:
    """Activity sessions of a table, cut per time slice first and then joined per key.

    The per-key step sees pieces of sessions, not events, so a key with very many events
    stays small there.
    """
    ts_type = events.schema[ts].dataType
    timed = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    sliced = timed.withColumn("_slice", F.floor(F.col("_t") / slice_us))

    def numbered(df: DataFrame, within: list[str], order: str, previous: Column) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(order)
        starts = F.coalesce((F.col(order) - previous.over(w) > gap_us).cast("long"), F.lit(1))
        return df.withColumn("_new", starts).withColumn("_session", F.sum("_new").over(w))

    local = (
        numbered(sliced, [key, "_slice"], "_t", F.lag("_t"))
        .groupBy(key, "_slice", "_session")
        .agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.count(F.lit(1)).alias("_n"))
        .drop("_session")
    )
    return (
        numbered(local, [key], "_from", F.lag("_to"))
        .groupBy(key, "_session")
        .agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_n").alias("n_events"))
        .select(
            key,
            F.timestamp_micros("_from").cast(ts_type).alias("first_ts"),
            F.timestamp_micros("_to").cast(ts_type).alias("last_ts"),
            "n_events",
        )
    )


def live_sessions(logins: DataFrame, login_ts: str, now: Column, lifetime_days: int = 7) -> DataFrame:
    """Sessions not yet expired at ``now``; the others are due for purging."""
    expires = F.col(login_ts) + F.make_interval(days=F.lit(lifetime_days))
    return logins.withColumn("expires_at", expires).where(F.col("expires_at") > now)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """The state store that ``released_stream`` needs, for queries started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is available, write it as Parquet and read it back."""
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", path)
    started = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def incremental_ingest(
    spark: SparkSession, landing: str, out: str, checkpoint: str, dataset: Column,
    on_batch: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """JSON-lines files are parsed, split into good and rejected rows and profiled as they arrive.

    Each micro-batch overwrites its own folders, so a repeated batch leaves no duplicates.
    """
    lines = spark.readStream.text(landing).select(F.col("_metadata.file_path").alias("file"), "value")

    def ingest(batch: DataFrame, batch_id: int) -> None:
        rows = readers.parse_json_lines(batch.withColumn("dataset", dataset), "value").persist()
        good, bad = readers.split_objects(rows)
        good.select("dataset", "file", F.to_json("row").alias("row")).write.mode("overwrite").json(f"{out}/rows/batch={batch_id}")
        bad.select("dataset", "file", F.to_json("row").alias("row")).write.mode("overwrite").json(f"{out}/rejected/batch={batch_id}")
        profile.variant_profile(good, "dataset", "row").write.mode("overwrite").json(f"{out}/profile/batch={batch_id}")
        if on_batch:
            on_batch(good, batch_id)
        rows.unpersist()

    return lines.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
