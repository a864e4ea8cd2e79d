"""Access rules, keyed changes and paging, with customers as users and orders as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.operators import access, paging
from gristmill.plans.registry import query, table
from gristmill.sources import tables

_WORLD_SQL = """
  teams AS (SELECT DISTINCT c_custkey // 20 AS team_id, 'team ' || c_custkey // 20 AS name, c_custkey // 20 % 7 AS created_at FROM customer),
  members AS (SELECT c_custkey // 20 AS team_id, c_custkey AS user_id, CASE c_custkey % 5 WHEN 0 THEN 'viewer' WHEN 1 THEN 'member'
      WHEN 2 THEN 'admin' WHEN 3 THEN 'owner' ELSE 'guest' END AS team_role FROM customer
    UNION ALL SELECT c_custkey // 20 + 1, c_custkey, 'member' FROM customer WHERE c_custkey % 4 = 0),
  records AS (SELECT o_orderkey AS resource_id, o_custkey AS owner_id FROM orders),
  shares AS (SELECT 'dataset' AS resource_type, o_orderkey AS resource_id, o_custkey // 20 AS team_id,
      CASE WHEN o_orderkey % 4 < 2 THEN 'edit' ELSE 'view' END AS permission FROM orders WHERE o_orderkey % 10 < 2
    UNION ALL SELECT 'run', o_orderkey, o_custkey // 20, 'edit' FROM orders WHERE o_orderkey % 10 = 3),
  ranked AS (SELECT m.user_id, s.resource_id, max(CASE WHEN m.team_role = 'viewer' OR s.permission = 'view' THEN 0 ELSE 1 END) AS rank
    FROM shares s JOIN members m USING (team_id) WHERE s.resource_type = 'dataset' AND m.team_role <> 'guest' GROUP BY 1, 2)"""


def _world(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    team = F.floor(F.col("c_custkey") / 20)
    role = (
        F.when(F.col("c_custkey") % 5 == 0, "viewer").when(F.col("c_custkey") % 5 == 1, "member")
        .when(F.col("c_custkey") % 5 == 2, "admin").when(F.col("c_custkey") % 5 == 3, "owner").otherwise("guest")
    )
    order_team = F.floor(F.col("o_custkey") / 20).alias("team_id")
    members = customers.select(team.alias("team_id"), F.col("c_custkey").alias("user_id"), role.alias("team_role"))
    second = customers.where("c_custkey % 4 = 0").select(
        (team + 1).alias("team_id"), F.col("c_custkey").alias("user_id"), F.lit("member").alias("team_role")
    )
    shares = orders.where("o_orderkey % 10 < 2").select(
        F.lit("dataset").alias("resource_type"), F.col("o_orderkey").alias("resource_id"), order_team,
        F.when(F.col("o_orderkey") % 4 < 2, "edit").otherwise("view").alias("permission"),
    )
    runs = orders.where("o_orderkey % 10 = 3").select(
        F.lit("run").alias("resource_type"), F.col("o_orderkey").alias("resource_id"), order_team, F.lit("edit").alias("permission")
    )
    return {
        "users": customers.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") == 0).alias("is_admin")),
        "teams": customers.select(
            team.alias("team_id"), F.concat(F.lit("team "), team.cast("string")).alias("name"), (team % 7).alias("created_at")
        ).distinct(),
        "members": members.unionByName(second),
        "records": orders.select(F.col("o_orderkey").alias("resource_id"), F.col("o_custkey").alias("owner_id")),
        "shares": shares.unionByName(runs),
    }


@query(
    "teams_for_user",
    f"WITH {_WORLD_SQL} SELECT user_id, team_id, team_role, name, created_at FROM members JOIN teams USING (team_id)",
)
def teams_for_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _world(spark, sf_dir)
    return access.teams_of_users(w["teams"], w["members"]).select("user_id", "team_id", "team_role", "name", "created_at")


@query(
    "shared_best_permission",
    f"WITH {_WORLD_SQL} SELECT user_id, resource_id, CASE rank WHEN 1 THEN 'edit' ELSE 'view' END AS permission FROM ranked",
)
def shared_best_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _world(spark, sf_dir)
    return access.shared_permissions(w["shares"], w["members"], "dataset")


@query(
    "visible_records",
    f"""WITH {_WORLD_SQL}, v AS (SELECT owner_id AS user_id, resource_id, 1 AS rank FROM records WHERE owner_id IN (SELECT c_custkey FROM customer)
      UNION ALL SELECT user_id, resource_id, rank FROM ranked WHERE resource_id IN (SELECT resource_id FROM records)
      UNION ALL SELECT 0, resource_id, 1 FROM records)
    SELECT user_id, resource_id, CASE max(rank) WHEN 1 THEN 'edit' ELSE 'view' END AS permission FROM v GROUP BY 1, 2""",
)
def visible_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _world(spark, sf_dir)
    args = (w["records"], w["shares"], w["members"], "dataset")
    admin = access.visible_to(0, True, *args).select(F.lit(0).cast("long").alias("user_id"), "resource_id", "permission")
    return access.visible_records(w["users"], *args).unionByName(admin)


@query(
    "visible_to_user",
    f"""WITH {_WORLD_SQL} SELECT resource_id, owner_id, 'edit' AS permission FROM records LEFT JOIN ranked k USING (resource_id)
    WHERE owner_id = 7 OR (k.user_id = 7 AND k.rank = 1) GROUP BY ALL""",
)
def visible_to_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _world(spark, sf_dir)
    return access.visible_to(7, False, w["records"], w["shares"], w["members"], "dataset", need="edit")


@query(
    "effective_permission",
    f"""WITH {_WORLD_SQL}, q AS (SELECT event_id AS request_id, user_id, (event_id * 7) % (SELECT max(o_orderkey) + 1 FROM orders) AS resource_id FROM events)
    SELECT request_id, q.user_id, q.resource_id, CASE WHEN q.user_id = 0 OR r.owner_id = q.user_id THEN 'edit'
      WHEN k.rank = 1 THEN 'edit' WHEN k.rank = 0 THEN 'view' END AS permission
    FROM q LEFT JOIN records r USING (resource_id) LEFT JOIN ranked k ON k.user_id = q.user_id AND k.resource_id = q.resource_id""",
)
def effective_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _world(spark, sf_dir)
    ids = table(spark, sf_dir, "orders").agg(F.max("o_orderkey") + 1).scalar()
    requests = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), "user_id", ((F.col("event_id") * 7) % ids).alias("resource_id")
    )
    return access.effective_permissions(requests, w["users"], w["records"], w["shares"], w["members"], "dataset")


@query(
    "owned_rows",
    "SELECT o_orderkey AS resource_id, o_custkey AS owner_id FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey",
)
def owned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return access.owned_rows(_world(spark, sf_dir)["records"], users).select("resource_id", "owner_id")


@query(
    "session_users",
    """WITH s AS (SELECT 's' || c_custkey AS token, c_custkey AS user_id, TIMESTAMP '2024-01-01' + INTERVAL 7 DAY + INTERVAL 1 DAY * (c_custkey % 20) AS expires_at, c_name FROM customer)
    SELECT event_id AS request_id, 's' || e.user_id AS token, s.user_id, s.c_name AS name FROM events e
    LEFT JOIN s ON s.token = 's' || e.user_id AND s.expires_at > e.ts""",
)
def session_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    token = F.concat(F.lit("s"), F.col("c_custkey").cast("string"))
    days = (F.col("c_custkey") % 20).cast("int") + 7
    sessions = customers.select(
        token.alias("token"), F.col("c_custkey").alias("user_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(days=days)).alias("expires_at"),
    )
    requests = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("token"), "ts"
    )
    users = customers.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return access.authenticate(requests, sessions, users)


_CHANGE_SQL = """
  changes AS (SELECT o_orderkey, o_custkey, o_orderstatus || '2' AS o_orderstatus, 2 AS version FROM orders WHERE o_orderkey % 5 < 2
    UNION ALL SELECT o_orderkey, o_custkey, 'X', 3 FROM orders WHERE o_orderkey % 5 = 0),
  base AS (SELECT o_orderkey, o_custkey, o_orderstatus, 1 AS version FROM orders WHERE o_orderkey % 3 <> 0)"""


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    base = orders.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(1).alias("version"))
    first = orders.where("o_orderkey % 5 < 2").select(
        "o_orderkey", "o_custkey", F.concat("o_orderstatus", F.lit("2")).alias("o_orderstatus"), F.lit(2).alias("version")
    )
    second = orders.where("o_orderkey % 5 = 0").select(
        "o_orderkey", "o_custkey", F.lit("X").alias("o_orderstatus"), F.lit(3).alias("version")
    )
    return base, first.unionByName(second)


@query(
    "upsert_latest",
    f"WITH {_CHANGE_SQL} SELECT o_orderkey, arg_max(o_custkey, version) AS o_custkey, arg_max(o_orderstatus, version) AS o_orderstatus, "
    "max(version) AS version FROM (SELECT * FROM base UNION ALL SELECT * FROM changes) GROUP BY 1",
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, changes = _changes(spark, sf_dir)
    return tables.upsert(base, changes, ["o_orderkey"], "version")


@query(
    "upsert_columns",
    f"""WITH {_CHANGE_SQL}, n AS (SELECT o_orderkey, arg_max(o_orderstatus, version) AS o_orderstatus, 100 + max(version) AS created_at FROM changes GROUP BY 1)
    SELECT coalesce(b.o_orderkey, n.o_orderkey) AS o_orderkey, b.o_custkey, coalesce(n.o_orderstatus, b.o_orderstatus) AS o_orderstatus,
      least(b.version, n.created_at) AS created_at FROM base b FULL JOIN n ON n.o_orderkey = b.o_orderkey""",
)
def upsert_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, changes = _changes(spark, sf_dir)
    stamped = changes.withColumn("created_at", F.col("version") + 100)
    return tables.upsert_columns(
        base.withColumnRenamed("version", "created_at"), stamped, ["o_orderkey"], ["o_orderstatus"], "version", "created_at"
    )


@query(
    "cascade_delete",
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    SELECT 'customer' AS kept_table, count(*) AS row_count FROM customer WHERE c_custkey NOT IN (SELECT * FROM gone)
    UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT * FROM gone)""",
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    kept, children = tables.delete_cascade(
        customers, {"orders": (table(spark, sf_dir, "orders"), "o_custkey")}, "c_custkey", customers.where("c_acctbal < 0")
    )
    frames = {"customer": kept, **children}
    counts = [df.agg(F.lit(name).alias("kept_table"), F.count(F.lit(1)).alias("row_count")) for name, df in frames.items()]
    return counts[0].unionByName(counts[1])


@query(
    "schema_evolution",
    "SELECT s_suppkey, s_name, NULL AS added_note, CAST(NULL AS BIGINT) AS added_count FROM supplier",
)
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    newer = T.StructType(
        [
            T.StructField("s_suppkey", T.LongType()),
            T.StructField("s_name", T.StringType()),
            T.StructField("added_note", T.StringType()),
            T.StructField("added_count", T.LongType()),
        ]
    )
    return tables.evolve(table(spark, sf_dir, "supplier"), newer)


@query(
    "nested_round_trip",
    "SELECT doc_id, lang AS tag, CAST(n_chars AS BIGINT) AS size, source AS origin FROM documents",
)
def nested_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested fields through JSON text and back."""
    nested = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.array("lang", "source").alias("tags"),
        F.create_map(F.lit("size"), F.col("n_chars")).alias("stats"),
        F.struct(F.col("source").alias("origin")).alias("meta"),
    )
    back = tables.decode_nested(tables.encode_nested(nested), nested.schema)
    return back.select("doc_id", F.col("tags")[0].alias("tag"), F.col("stats")["size"].alias("size"), F.col("meta.origin").alias("origin"))


@query(
    "paginate",
    """WITH t AS (SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages FROM orders),
    o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders)
    SELECT o_orderkey, position, total, total_pages, CAST(17 AS BIGINT) AS page, 50 AS page_size, total_pages > 17 AS has_next, TRUE AS has_prev
    FROM o, t WHERE position BETWEEN 800 AND 849""",
)
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return paging.paginate(rows, ["o_orderdate", "o_orderkey"], page=17, page_size=50).drop("o_orderdate")


@query(
    "latest_run",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
      ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return paging.latest_per(runs, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "project_runs",
    """SELECT c_custkey, c_name, o_orderkey, o_orderstatus, coalesce(n, 0) AS n_children FROM customer LEFT JOIN orders ON o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = c_custkey""",
)
def project_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return paging.with_children(projects, runs, "c_custkey")
