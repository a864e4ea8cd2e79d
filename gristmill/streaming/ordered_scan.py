"""Run of a state rule over events in order, exact also when one key has most events.

Events are range-partitioned and sorted by (key, time, id), so a key with very many events
spreads over many partitions. Only the first key of a partition can have begun earlier. A
first pass describes what each partition does to that key for every possible entry state; the
descriptions of a key are chained (one short row per partition); a second pass then runs every
partition from its true entry state. The first pass looks at the first and the last key of a
partition only. Memory per task is one Arrow batch.

A key may come with a state from earlier events: a row before all of its events that sets it.
With ``states`` the result carries such rows along, and the state that each key is left in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import durable
from gristmill.streaming.machines import NEVER, START, Pieces

_PIECES = (
    "lo array<bigint>, hi array<bigint>, entry_count array<bigint>, moves array<boolean>, "
    "val array<bigint>, count array<bigint>"
)


def _new_key(batch: pd.DataFrame) -> np.ndarray:
    """Where a row's key differs from the one before; null keys are one key."""
    codes = pd.factorize(batch["_key"], use_na_sentinel=True)[0]
    return np.concatenate(([True], codes[1:] != codes[:-1]))


def _same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def _set_state(row_time: int, row_count: int) -> tuple[int, int]:
    return int(row_time), int(row_count)


def _summaries(rule):
    """Per partition: the effect on its first key, and the state its last key is left in."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first_key, effect = None, None, None
        key, state, beyond = None, START, False
        for batch in batches:
            if not len(batch):
                continue
            starts = np.flatnonzero(_new_key(batch))
            keys = batch["_key"].tolist()
            if effect is None:
                part, first_key, effect = int(batch["_part"].iloc[0]), keys[0], Pieces.identity(rule.counts)
            begin = 0
            if not beyond and _same(keys[0], first_key):
                begin = int(starts[1]) if len(starts) > 1 else len(batch)
                for t, flag, time, count in _rows(batch, 0, begin):
                    if t == NEVER:
                        effect = Pieces.fixed(_set_state(time, count), rule.counts)
                    else:
                        rule.advance(effect, t, flag)
            if begin < len(batch):
                # Only the last key of the batch can go on in the next one or end the partition.
                last = max(int(starts[-1]), begin)
                if not beyond or last > 0 or not _same(keys[last], key):
                    state = START
                beyond, key = True, keys[last]
                for t, flag, time, count in _rows(batch, last, len(batch)):
                    state = _set_state(time, count) if t == NEVER else rule.step(state, t, flag)[0]
        if effect is None:
            return
        rows = [{"_part": part, "_key": first_key, "begins": False, **effect.columns()}]
        if beyond:
            rows.append({"_part": part, "_key": key, "begins": True, **Pieces.fixed(state, rule.counts).columns()})
        yield pd.DataFrame(rows)

    return scan


def _rows(batch: pd.DataFrame, begin: int, end: int) -> Iterator[tuple]:
    own = batch.iloc[begin:end]
    return zip(own["_t"].tolist(), own["_flag"].tolist(), own["_time"].tolist(), own["_count"].tolist())


def _entries(rows: pd.DataFrame) -> pd.DataFrame:
    """Entry state of a key in each partition it is first in."""
    state, out = START, []
    for row in rows.sort_values("_part").to_dict("records"):
        if not row["begins"]:
            out.append({"_part": row["_part"], "entry_time": state[0], "entry_count": state[1]})
        state = Pieces.from_columns(row).apply(state)
    return pd.DataFrame(out, columns=["_part", "entry_time", "entry_count"])


def _run(rule):
    """Code of each event and the state after it; ``_last`` marks a key's last row in the partition."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, started = None, START, False
        held = None
        for batch in batches:
            if not len(batch):
                continue
            fresh = _new_key(batch)
            keys = batch["_key"].tolist()
            if not started:
                state, started = (int(batch["entry_time"].iloc[0]), int(batch["entry_count"].iloc[0])), True
                fresh[0] = False
            else:
                fresh[0] = not _same(keys[0], key)
            codes, times, counts = [], [], []
            for new, (t, flag, time, count) in zip(fresh.tolist(), _rows(batch, 0, len(batch))):
                if new:
                    state = START
                if t == NEVER:
                    state, code = _set_state(time, count), 0
                else:
                    state, code = rule.step(state, t, flag)
                codes.append(code)
                times.append(state[0])
                counts.append(state[1])
            key = keys[-1]
            last = np.concatenate((fresh[1:], [False]))
            out = pd.DataFrame(
                {"_id": batch["_id"], "_key": batch["_key"], "_t": batch["_t"], "code": codes, "_time": times, "_count": counts, "_last": last}
            )
            # Whether a batch's last row ends its key is known with the next batch.
            if held is not None:
                held.loc[held.index[-1], "_last"] = bool(fresh[0])
                yield held
            held = out
        if held is not None:
            held.loc[held.index[-1], "_last"] = True
            yield held

    return scan


def scan_with_states(
    events: DataFrame, key: str, ts: str, event_id: str, rule, flag: str | None = None, states: DataFrame | None = None
) -> DataFrame:
    """Rows ``_id, _key, _t`` (microseconds), ``code`` and the state after each (``_time, _count``).

    ``states`` (``_key, _time, _count``) are the states that keys begin with; their rows come back
    with ``_t`` = ``NEVER``. ``_last`` marks the last row of a key in each partition it has rows in.
    """
    key_type = events.schema[key].dataType.simpleString()
    id_type = events.schema[event_id].dataType.simpleString()
    prepared = events.select(
        F.col(key).alias("_key"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"),
        F.col(event_id).alias("_id"),
        (F.col(flag) if flag else F.lit(True)).alias("_flag"),
        F.lit(0).cast("bigint").alias("_time"),
        F.lit(0).cast("bigint").alias("_count"),
    )
    if states is not None:
        before = states.select(
            "_key", F.lit(NEVER).cast("bigint").alias("_t"), F.lit(None).cast(id_type).alias("_id"), F.lit(True).alias("_flag"), "_time", "_count"
        )
        prepared = prepared.unionByName(before)
    order = ["_key", "_t", "_id"]
    ranged = durable(
        prepared.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    )
    effects = ranged.mapInPandas(_summaries(rule), f"_part int, _key {key_type}, begins boolean, {_PIECES}")
    entries = effects.groupBy("_key").applyInPandas(_entries, "_part int, entry_time bigint, entry_count bigint")
    # One row per partition, so safe to broadcast; a broadcast join also keeps the row order.
    seeded = ranged.join(F.broadcast(entries), "_part")
    return seeded.mapInPandas(
        _run(rule), f"_id {id_type}, _key {key_type}, _t bigint, code int, _time bigint, _count bigint, _last boolean"
    )


def ordered_scan(events: DataFrame, key: str, ts: str, event_id: str, rule, flag: str | None = None) -> DataFrame:
    """(``event_id``, ``key``, ``ts``, code) with the rule's outcome code for every event."""
    return scan_with_states(events, key, ts, event_id, rule, flag).select(
        F.col("_id").alias(event_id), F.col("_key").alias(key), F.timestamp_micros("_t").cast(events.schema[ts].dataType).alias(ts), "code"
    )
