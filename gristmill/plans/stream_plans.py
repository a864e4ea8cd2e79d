"""Rate limits, repeat suppression, circuit breaking, sessions and rolling metrics over events."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import sketches
from gristmill.plans.registry import query, table
from gristmill.scratch import Scratch
from gristmill.session import ensure_checkpoint_dir
from gristmill.streaming import jobs
from gristmill.streaming.machines import CircuitBreaker, RepeatWindow, TokenBucket
from gristmill.streaming.ordered_scan import ordered_scan
from gristmill.streaming.ordered_stream import OrderedStream

# Events are sparse, so limits are scaled to them: three tokens, one back every six hours.
BUCKET = TokenBucket(capacity=3, token_us=6 * 3600 * 1_000_000)
REPEATS = RepeatWindow(ttl_us=12 * 3600 * 1_000_000)
BREAKER = CircuitBreaker(threshold=3, cooldown_us=24 * 3600 * 1_000_000)
LATE_US = 24 * 3600 * 1_000_000
LOADS = 4
FILES_PER_LOAD = 2
SESSION_GAP_US = 6 * 3600 * 1_000_000
EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of loads in which they arrive up to 20 hours late, a load a trigger."""
    landing = _folder(spark, "landed")
    late = F.pmod(F.xxhash64("event_id"), F.lit(20 * 3600)) * 1_000_000
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    events = events.withColumn("_arrival", F.unix_micros("ts") + late)
    first, last = events.agg(F.min("_arrival"), F.max("_arrival")).first()
    load = F.least(F.floor((F.col("_arrival") - first) / ((last - first) / LOADS)), F.lit(LOADS - 1))
    for number in range(LOADS):
        part = events.where(load == number).drop("_arrival").repartition(FILES_PER_LOAD)
        part.write.mode("append").parquet(landing)
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", FILES_PER_LOAD).parquet(landing)


def _ordered(spark: SparkSession, stream: DataFrame, key: str, rule, flag: str | None = None) -> DataFrame:
    """Codes of all events of a stream that ends."""
    run = OrderedStream(spark, _folder(spark, "ordered"), key, "ts", "event_id", rule, LATE_US, flag)
    run.run(stream, _folder(spark, "ordered-progress"))
    run.finish(spark.createDataFrame([], stream.schema))
    return run.outcome(stream.schema)


_NUMBERED_SQL = """
  e AS (SELECT event_id, {key} AS k, epoch_us(ts) AS t, event_type <> 'error' AS ok,
    row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events)"""

RATE_SQL = f"""
  WITH RECURSIVE {_NUMBERED_SQL.format(key='user_id')},
  r AS (SELECT event_id, k, rn, t, CAST({BUCKET.capacity - 1} * {BUCKET.token_us} AS BIGINT) AS tokens, 1 AS code FROM e WHERE rn = 1
    UNION ALL SELECT e.event_id, e.k, e.rn, e.t,
      CAST(least({BUCKET.capacity} * {BUCKET.token_us}, tokens + e.t - r.t) - CASE WHEN least({BUCKET.capacity} * {BUCKET.token_us}, tokens + e.t - r.t) >= {BUCKET.token_us}
        THEN {BUCKET.token_us} ELSE 0 END AS BIGINT),
      CASE WHEN least({BUCKET.capacity} * {BUCKET.token_us}, tokens + e.t - r.t) >= {BUCKET.token_us} THEN 1 ELSE 0 END
      FROM r JOIN e ON e.k = r.k AND e.rn = r.rn + 1)
  SELECT event_id, k AS user_id, code FROM r"""

REPEAT_SQL = f"""
  WITH RECURSIVE {_NUMBERED_SQL.format(key="event_type || ':' || user_id")},
  r AS (SELECT event_id, k, rn, CAST(t + {REPEATS.ttl_us} AS BIGINT) AS expiry, 1 AS code FROM e WHERE rn = 1
    UNION ALL SELECT e.event_id, e.k, e.rn, CAST(CASE WHEN e.t < expiry THEN expiry ELSE e.t + {REPEATS.ttl_us} END AS BIGINT),
      CASE WHEN e.t < expiry THEN 0 ELSE 1 END FROM r JOIN e ON e.k = r.k AND e.rn = r.rn + 1)
  SELECT event_id, code FROM r"""

BREAKER_SQL = f"""
  WITH RECURSIVE {_NUMBERED_SQL.format(key='user_id % 50')},
  r AS (SELECT event_id, k, rn, CASE WHEN ok THEN 0 ELSE 1 END AS failures, CAST(0 AS BIGINT) AS until, CASE WHEN ok THEN 1 ELSE 2 END AS code FROM e WHERE rn = 1
    UNION ALL SELECT e.event_id, e.k, e.rn, CASE WHEN e.t < until THEN failures WHEN ok THEN 0 ELSE least(3, failures + 1) END,
      CASE WHEN e.t < until THEN until WHEN NOT ok AND failures + 1 >= 3 THEN CAST(e.t + {BREAKER.cooldown_us} AS BIGINT) ELSE CAST(0 AS BIGINT) END,
      CASE WHEN e.t < until THEN 0 WHEN ok THEN 1 WHEN failures + 1 >= 3 THEN 3 ELSE 2 END FROM r JOIN e ON e.k = r.k AND e.rn = r.rn + 1)
  SELECT event_id, k AS provider, code FROM r"""


@query("rate_limit", RATE_SQL)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_scan(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", BUCKET).drop("ts")


@query("rate_limit_stream", RATE_SQL)
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, _landed(spark, sf_dir), "user_id", BUCKET).drop("ts")


@query(
    "rate_limit_released_stream",
    f"""SELECT r.* FROM ({RATE_SQL}) r JOIN events USING (event_id)
    WHERE epoch_us(ts) < (SELECT epoch_us(max(ts)) // 1000 * 1000 - {LATE_US} FROM events)""",
)
def rate_limit_released_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that the watermark, one day behind the newest event, has released from their keys' state."""
    with jobs.rocksdb_state(spark):
        stream = jobs.released_stream(_landed(spark, sf_dir), "user_id", "ts", "event_id", BUCKET, "1 day")
        return jobs.run_to_files(stream, _folder(spark, "released"), _folder(spark, "released-state")).drop("ts")


@query("ttl_dedup", REPEAT_SQL)
def ttl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", "event_type", "user_id"))
    return ordered_scan(keyed, "key", "ts", "event_id", REPEATS).select("event_id", "code")


@query("ttl_dedup_stream", REPEAT_SQL)
def ttl_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _landed(spark, sf_dir).withColumn("key", F.concat_ws(":", "event_type", "user_id"))
    return _ordered(spark, keyed, "key", REPEATS).select("event_id", "code")


@query("circuit_breaker", BREAKER_SQL)
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(
        "event_id", "ts", (F.col("user_id") % 50).alias("provider"), (F.col("event_type") != "error").alias("ok")
    )
    return ordered_scan(calls, "provider", "ts", "event_id", BREAKER, "ok").drop("ts")


@query("circuit_breaker_stream", BREAKER_SQL)
def circuit_breaker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _landed(spark, sf_dir).select(
        "event_id", "ts", (F.col("user_id") % 50).alias("provider"), (F.col("event_type") != "error").alias("ok")
    )
    return _ordered(spark, calls, "provider", BREAKER, "ok").drop("ts")


_SESSION_SQL = f"""
  WITH g AS (SELECT user_id, ts, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER w > {SESSION_GAP_US} AS INT), 1) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
  SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM s GROUP BY user_id, n"""


@query("session_windows", _SESSION_SQL)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sessions(table(spark, sf_dir, "events"), "user_id", "ts", SESSION_GAP_US)


@query(
    "session_stream",
    f"SELECT * FROM ({_SESSION_SQL}) WHERE epoch_us(last_ts) + {SESSION_GAP_US} <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 3600000000 FROM events)",
)
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions the stream has closed by its watermark, one hour behind the newest event."""
    stream = jobs.session_stream(_event_stream(spark, sf_dir), "user_id", "ts", "6 hours", "1 hour")
    return jobs.run_to_files(stream, _folder(spark, "session"), _folder(spark, "session-state"))


def _rolling_sql(starts: str, condition: str = "TRUE") -> str:
    return f"""WITH b AS (SELECT event_type, value, {starts} AS window_start FROM events)
    SELECT event_type, window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS count, round_even(sum(value), 4) AS sum,
      min(value) AS min, max(value) AS max, round_even(avg(value), 8) AS avg,
      list_sort(list(value))[CAST(ceil(round(0.95 * count(value), 7)) AS INT)] AS p95 FROM b GROUP BY 1, 2 HAVING {condition}"""


_TUMBLING = "to_timestamp(epoch_us(ts) // 21600000000 * 21600)::TIMESTAMP"
_SLIDING = "unnest([to_timestamp(epoch_us(ts) // 7200000000 * 7200 - i * 7200)::TIMESTAMP for i in [0, 1, 2]])"


@query("rolling_metrics", _rolling_sql(_TUMBLING))
def rolling_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.rolling_metrics(table(spark, sf_dir, "events"), "event_type", "ts", "value", "6 hours")


@query("rolling_metrics_sliding", _rolling_sql(_SLIDING))
def rolling_metrics_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.rolling_metrics(table(spark, sf_dir, "events"), "event_type", "ts", "value", "6 hours", "2 hours")


@query("rolling_metrics_stream", _rolling_sql(_TUMBLING, "window_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"))
def rolling_metrics_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows closed by the watermark, one hour behind the newest event."""
    stream = jobs.rolling_metrics(_event_stream(spark, sf_dir), "event_type", "ts", "value", "6 hours", late="1 hour")
    return jobs.run_to_files(stream, _folder(spark, "rolling"), _folder(spark, "rolling-state"))


@query(
    "metric_rollup",
    """SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(value) AS count, min(value) AS min, max(value) AS max,
      """ + ", ".join(
        f"list_sort(list(value))[CAST(ceil(round({share} * count(value), 7)) AS INT)] AS {name}"
        for name, share in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    ) + " FROM events GROUP BY ALL",
)
def metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sketches, kept as a table, added up to days."""
    hours = sketches.metric_sketches(table(spark, sf_dir, "events"), "event_type", "ts", "value")
    kept = Scratch(spark, "metrics").keep(hours, "hours")
    days = sketches.rolled_up(kept, "event_type")
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return days.select(
        "event_type", F.col("span").alias("day"), "count", "min", "max",
        *[sketches.quantile("sketch", share).alias(name) for name, share in shares.items()],
    )


@query(
    "live_sessions",
    """WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_id, user_id, ts + INTERVAL 7 DAY AS expires_at FROM events, n
    WHERE event_type = 'signup' AND ts + INTERVAL 7 DAY > now""",
)
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    logins = events.where("event_type = 'signup'").select("event_id", "user_id", "ts")
    now = events.agg(F.max("ts")).scalar()
    return jobs.live_sessions(logins, "ts", now).select("event_id", "user_id", "expires_at")


@query(
    "incremental_ingest",
    """SELECT event_type AS dataset, 'k' AS "column", 'integer' AS type, count(*) AS present FROM events WHERE event_id % 50 <> 0 GROUP BY 1
    UNION ALL SELECT event_type, 'value', 'number', count(*) FROM events WHERE event_id % 50 <> 0 GROUP BY 1""",
)
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events land as JSON-lines files per type and are profiled as they arrive."""
    landing, out = _folder(spark, "landing"), _folder(spark, "ingested")
    line = F.when(F.col("event_id") % 50 == 0, "[1]").otherwise(
        F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("value") + 0.001).alias("value")))
    )
    table(spark, sf_dir, "events").select("event_type", line.alias("value")).write.partitionBy("event_type").text(landing)
    dataset = F.regexp_extract("file", "event_type=([^/]+)", 1)
    jobs.incremental_ingest(spark, f"{landing}/*", out, _folder(spark, "ingest-state"), dataset).awaitTermination()
    rows = spark.read.schema("dataset STRING, row STRING").json(f"{out}/rows")
    fields = spark.read.schema("dataset STRING, column STRING, type STRING, missing_count BIGINT").json(f"{out}/profile")
    sizes = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return (
        fields.groupBy("dataset", "column").agg(F.max("type").alias("type"), F.sum("missing_count").alias("missing"))
        .join(sizes, "dataset")
        .select("dataset", "column", "type", (F.col("n") - F.col("missing")).alias("present"))
    )
