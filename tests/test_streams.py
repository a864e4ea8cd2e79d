import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.streaming import jobs
from gristmill.streaming.machines import START, CircuitBreaker, Pieces, RepeatWindow, TokenBucket
from gristmill.streaming.ordered_scan import ordered_scan, scan_with_states
from gristmill.streaming.ordered_stream import OrderedStream

RULES = [TokenBucket(4, 10), RepeatWindow(25), CircuitBreaker(3, 15)]


@pytest.mark.parametrize("rule", RULES, ids=lambda r: type(r).__name__)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.booleans()), min_size=1, max_size=60), st.data())
def test_pieces_agree_with_steps_at_every_cut(rule, gaps, data):
    t, events = 100, []
    for gap, ok in gaps:
        t += gap
        events.append((t, ok))
    cut = data.draw(st.integers(0, len(events)))
    state = START
    for time, ok in events[:cut]:
        state, _ = rule.step(state, time, ok)
    effect = Pieces.identity(rule.counts)
    plain = state
    for time, ok in events[cut:]:
        rule.advance(effect, time, ok)
        plain, _ = rule.step(plain, time, ok)
    after = effect.apply(state)
    # Equal, or both lie in the past of the last event, where they mean the same.
    last = events[-1][0]
    assert after == plain or (after[1] == plain[1] and max(after[0], plain[0]) <= last)


def reference(rule, events):
    """Plain loop per key; events are (id, key, t, flag)."""
    states, codes = {}, {}
    for i, key, t, ok in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        states[key], codes[i] = rule.step(states.get(key, START), t, ok)
    return codes


@pytest.mark.parametrize(
    "rule", [TokenBucket(5, 1_000_000), RepeatWindow(3_000_000), CircuitBreaker(3, 2_000_000)], ids=lambda r: type(r).__name__
)
def test_one_hot_key_spreads_and_stays_exact(spark, rule):
    """Nearly all events belong to one key that never rests."""
    rng = random.Random(5)
    events, t = [], 0
    for i in range(6000):
        t += rng.randrange(0, 700_000)
        events.append((i, "hot" if i % 10 else f"cold{i % 7}", t, rng.random() < 0.6))
    df = spark.createDataFrame(events, "id long, key string, t long, ok boolean").selectExpr("id", "key", "timestamp_micros(t) AS ts", "ok")
    got = {r.id: r.code for r in ordered_scan(df, "key", "ts", "id", rule, "ok").collect()}
    assert got == reference(rule, events)
    parts = df.repartitionByRange(8, "key", "ts", "id").selectExpr("spark_partition_id() AS p", "key").where("key = 'hot'").distinct().count()
    assert parts > 4


def test_bucket_refuses_then_recovers():
    rule, state, codes = TokenBucket(2, 10), START, []
    for t in (0, 0, 0, 10, 10, 40, 40, 40):
        state, code = rule.step(state, t, True)
        codes.append(code)
    assert codes == [1, 1, 0, 1, 0, 1, 1, 0]


def test_breaker_opens_and_reopens():
    rule, state, codes = CircuitBreaker(3, 30), START, []
    for t, ok in ((0, False), (1, False), (2, False), (10, True), (40, False), (50, True), (80, True), (81, False)):
        state, code = rule.step(state, t, ok)
        codes.append(code)
    assert codes == [2, 2, 3, 0, 3, 0, 1, 2]


def test_sessions_join_across_slices(spark):
    times = [0, 50, 99, 101, 180, 400]
    df = spark.createDataFrame([("u", t) for t in times], "u string, t long").selectExpr("u", "timestamp_micros(t) AS ts")
    rows = jobs.sessions(df, "u", "ts", gap_us=100, slice_us=100).orderBy("first_ts").collect()
    assert [r.n_events for r in rows] == [5, 1]


def test_repeats_within_the_delay_are_dropped(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 10), (3, "b", 20)], "id int, k string, s int").selectExpr("id", "k", "timestamp_seconds(s) AS ts")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = jobs.run_to_files(jobs.drop_repeats(stream, ["k"], "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert out.count() == 2


def test_stream_state_survives_between_runs(spark, tmp_path):
    """The second run continues from the first one's checkpoint."""
    rule = TokenBucket(2, 3_600_000_000)
    rows = lambda ids: spark.createDataFrame([(i, "u", i) for i in ids], "id long, k string, s int").selectExpr("id", "k", "timestamp_seconds(s) AS ts")
    for ids in ([1, 2], [3]):
        rows(ids).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, k string, ts timestamp").parquet(str(tmp_path / "in"))
        out = jobs.run_to_files(jobs.keyed_stream(stream, "k", "ts", "id", rule), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {r.id: r.code for r in out.collect()} == {1: 1, 2: 1, 3: 0}


@pytest.mark.parametrize("rule", [TokenBucket(2, 3_600_000_000), RepeatWindow(1_800_000_000), CircuitBreaker(2, 60_000_000)], ids=lambda r: type(r).__name__)
def test_dropping_idle_state_changes_nothing(spark, tmp_path, rule):
    rng = random.Random(2)
    events = [(i, f"k{rng.randrange(4)}", i * 600 + rng.randrange(500), rng.random() < 0.5) for i in range(60)]
    schema = "id long, k string, s long, ok boolean"
    for at in range(0, 60, 20):
        batch = spark.createDataFrame(events[at : at + 20], schema).selectExpr("id", "k", "timestamp_seconds(s) AS ts", "ok")
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, k string, ts timestamp, ok boolean").parquet(str(tmp_path / "in"))
        out = jobs.run_to_files(
            jobs.keyed_stream(stream, "k", "ts", "id", rule, "ok", late="10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp")
        )
    want = reference(rule, [(i, k, s * 1_000_000, ok) for i, k, s, ok in events])
    assert {r.id: r.code for r in out.collect()} == want


EVENT_SCHEMA = "id long, k string, s long, ok boolean"


def out_of_order(n, seed, hot="hot"):
    """(id, key, second, flag); one key has a third of all events, times are up to 20 minutes off."""
    rng = random.Random(seed)
    return [
        (i, hot if i % 3 == 0 else f"k{rng.randrange(6)}", 10_000 + i * 200 + rng.randrange(-1200, 1200), rng.random() < 0.6) for i in range(n)
    ]


def land(spark, path, events, load):
    for at in range(0, len(events), load):
        batch = spark.createDataFrame(events[at : at + load], EVENT_SCHEMA).selectExpr("id", "k", "timestamp_seconds(s) AS ts", "ok")
        batch.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("id long, k string, ts timestamp, ok boolean").option("maxFilesPerTrigger", 1).parquet(path)


SECOND_RULES = [TokenBucket(2, 900_000_000), RepeatWindow(1_800_000_000), CircuitBreaker(2, 600_000_000)]


@pytest.mark.parametrize("rule", SECOND_RULES, ids=lambda r: type(r).__name__)
def test_stream_in_order_of_events_equals_the_batch(spark, tmp_path, rule):
    events = out_of_order(240, 4)
    too_late = [(1000 + i, "hot", 10_000, True) for i in range(3)]
    stream = land(spark, str(tmp_path / "in"), events + too_late, 60)
    run = OrderedStream(spark, str(tmp_path / "run"), "k", "ts", "id", rule, 3_600_000_000, "ok")
    run.run(stream, str(tmp_path / "progress"))
    waiting = run.outcome(stream.schema).count()
    assert 0 < waiting < len(events)
    run.finish(spark.createDataFrame([], stream.schema))
    want = reference(rule, [(i, k, s * 1_000_000, ok) for i, k, s, ok in events])
    got = run.outcome(stream.schema).collect()
    assert {r.id: r.code for r in got} == want and len(got) == len(events)
    late = spark.read.parquet(str(tmp_path / "run/late"))
    assert sorted(r["_id"] for r in late.collect()) == [e[0] for e in too_late]
    # Only the last two micro-batches keep their tables.
    assert len(list((tmp_path / "run/state").iterdir())) == 2


def test_a_repeated_micro_batch_overwrites_itself(spark, tmp_path):
    events, rule = out_of_order(120, 8), TokenBucket(2, 900_000_000)
    rows = spark.createDataFrame(events, EVENT_SCHEMA).selectExpr("id", "k", "timestamp_seconds(s) AS ts", "ok")
    run = OrderedStream(spark, str(tmp_path / "run"), "k", "ts", "id", rule, 3_600_000_000, "ok")
    for number, (a, b) in enumerate([(0, 40), (40, 80), (40, 80), (80, 120)]):
        run.step(rows.where(f"id >= {a} and id < {b}"), number - (number > 1))
    run.finish(rows.limit(0))
    run.finish(rows.limit(0))
    got = run.outcome(rows.schema).collect()
    assert {r.id: r.code for r in got} == reference(rule, [(i, k, s * 1_000_000, ok) for i, k, s, ok in events])
    assert len(got) == len(events)


def test_events_without_time_or_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, "a", None), (4, "a", 7)], "id long, k string, s long")
    rows = rows.selectExpr("id", "k", "timestamp_seconds(s) AS ts")
    run = OrderedStream(spark, str(tmp_path / "run"), "k", "ts", "id", TokenBucket(1, 10_000_000), 1_000_000)
    run.step(rows, 0)
    run.finish(rows.limit(0))
    assert {r.id: r.code for r in run.outcome(rows.schema).collect()} == {1: 1, 2: 0, 4: 1}
    assert [r["_id"] for r in spark.read.parquet(str(tmp_path / "run/late")).collect()] == [3]


@pytest.mark.parametrize("rule", SECOND_RULES, ids=lambda r: type(r).__name__)
def test_states_carry_a_scan_on(spark, rule):
    """A table cut anywhere and scanned in parts, one hot key over many partitions, gives the same codes."""
    events = sorted(out_of_order(3000, 6), key=lambda e: e[2])
    states, codes = None, {}
    for at in range(0, 3000, 1000):
        part = spark.createDataFrame(events[at : at + 1000], EVENT_SCHEMA).selectExpr("id", "k", "timestamp_seconds(s) AS ts", "ok")
        rows = scan_with_states(part, "k", "ts", "id", rule, "ok", states).collect()
        codes.update({r["_id"]: r["code"] for r in rows if r["_id"] is not None})
        last = {}
        for r in sorted((r for r in rows if r["_last"]), key=lambda r: (r["_t"], r["_id"] or 0)):
            last[r["_key"]] = (r["_key"], r["_time"], r["_count"])
        states = spark.createDataFrame(list(last.values()), "_key string, _time long, _count long")
    assert codes == reference(rule, [(i, k, s * 1_000_000, ok) for i, k, s, ok in events])


def test_events_are_released_in_order_by_the_watermark(spark, tmp_path):
    events, rule = out_of_order(160, 9), TokenBucket(2, 900_000_000)
    stream = land(spark, str(tmp_path / "in"), events, 40)
    with jobs.rocksdb_state(spark):
        out = jobs.run_to_files(
            jobs.released_stream(stream, "k", "ts", "id", rule, "1 hour", "ok"), str(tmp_path / "out"), str(tmp_path / "progress")
        )
    want = reference(rule, [(i, k, s * 1_000_000, ok) for i, k, s, ok in events])
    mark = max(e[2] for e in events) - 3600
    got = out.collect()
    assert {r.id: r.code for r in got} == {i: want[i] for i, _, s, _ in events if s < mark} and len(got) > 100
