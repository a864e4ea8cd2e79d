"""Who may see what: team membership, shares and ownership as equi-joins.

Permissions are compared by rank, never by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles that count, and the permissions from weakest to strongest.
ROLES = ("viewer", "member", "admin", "owner")
PERMISSIONS = ("view", "edit")


def permission_rank(permission: Column) -> Column:
    rank = F.lit(-1)
    for i, name in enumerate(PERMISSIONS):
        rank = F.when(permission == name, i).otherwise(rank)
    return rank


def permission_name(rank: Column) -> Column:
    name = F.lit(None).cast("string")
    for i, label in enumerate(PERMISSIONS):
        name = F.when(rank == i, label).otherwise(name)
    return name


def capped_rank(permission: Column, role: Column) -> Column:
    """Rank of a share for a member: viewers are held at view, unknown roles get nothing."""
    return (
        F.when(~role.isin(*ROLES) | role.isNull(), F.lit(None).cast("int"))
        .when(role == "viewer", permission_rank(F.lit("view")))
        .otherwise(permission_rank(permission))
    )


def teams_of_users(teams: DataFrame, members: DataFrame) -> DataFrame:
    """Teams each user belongs to, oldest team first."""
    return members.select("user_id", "team_id", "team_role").join(teams, "team_id").orderBy("user_id", "created_at", "team_id")


def shared_permissions(shares: DataFrame, members: DataFrame, resource_type: str) -> DataFrame:
    """Best permission per (user, resource) over all the user's teams.

    Pass only the members asking: the answer has a row per member and shared resource.
    """
    rank = capped_rank(F.col("permission"), F.col("team_role"))
    return (
        shares.where(F.col("resource_type") == resource_type)
        .join(members.select("team_id", "user_id", "team_role"), "team_id")
        .select("user_id", "resource_id", rank.alias("rank"))
        .where("rank IS NOT NULL")
        .groupBy("user_id", "resource_id")
        .agg(F.max("rank").alias("rank"))
        .select("user_id", "resource_id", permission_name(F.col("rank")).alias("permission"))
    )


def visible_records(
    users: DataFrame, records: DataFrame, shares: DataFrame, members: DataFrame, resource_type: str, need: str = "view"
) -> DataFrame:
    """(user, record, permission) for every ordinary user in ``users`` (``user_id, is_admin``).

    Owners see their rows, members what is shared with enough rights. An admin's answer is
    the records table itself (see ``visible_to``) and is not multiplied out here.
    ``records`` has ``resource_id`` and ``owner_id``.
    """
    plain = users.where(~F.col("is_admin"))
    own = records.join(plain, F.col("owner_id") == F.col("user_id")).select(
        "user_id", "resource_id", F.lit("edit").alias("permission")
    )
    shared = shared_permissions(shares, members.join(plain.select("user_id"), "user_id", "left_semi"), resource_type)
    enough = permission_rank(F.col("permission")) >= permission_rank(F.lit(need))
    foreign = shared.where(enough).join(records.select("resource_id"), "resource_id", "left_semi")
    return (
        own.unionByName(foreign)
        .groupBy("user_id", "resource_id")
        .agg(F.max(permission_rank(F.col("permission"))).alias("rank"))
        .select("user_id", "resource_id", permission_name(F.col("rank")).alias("permission"))
    )


def visible_to(
    user_id: int | str | None, is_admin: bool, records: DataFrame, shares: DataFrame, members: DataFrame,
    resource_type: str, need: str = "view",
) -> DataFrame:
    """Records one caller may see, with the permission; nobody in particular sees nothing."""
    if user_id is None:
        return records.limit(0).withColumn("permission", F.lit(None).cast("string"))
    if is_admin:
        return records.withColumn("permission", F.lit("edit"))
    mine = shared_permissions(shares, members.where(F.col("user_id") == user_id), resource_type).select(
        "resource_id", "permission"
    )
    joined = records.join(mine, "resource_id", "left")
    permission = F.when(F.col("owner_id") == user_id, "edit").otherwise(F.col("permission"))
    return joined.withColumn("permission", permission).where(
        permission_rank(F.col("permission")) >= permission_rank(F.lit(need))
    )


def effective_permissions(
    requests: DataFrame, users: DataFrame, records: DataFrame, shares: DataFrame, members: DataFrame, resource_type: str
) -> DataFrame:
    """Permission for each request row (``request_id, user_id, resource_id``), null without one.

    Every join is on the request's own keys, so the work follows the number of requests.
    """
    asked = requests.join(users.select("user_id", "is_admin"), "user_id", "left").join(
        records.select("resource_id", "owner_id"), "resource_id", "left"
    )
    by_team = (
        requests.select("user_id", "resource_id").distinct()
        .join(shares.where(F.col("resource_type") == resource_type), "resource_id")
        .join(members.select("team_id", "user_id", "team_role"), ["team_id", "user_id"])
        .groupBy("user_id", "resource_id")
        .agg(F.max(capped_rank(F.col("permission"), F.col("team_role"))).alias("team_rank"))
    )
    full = F.coalesce(F.col("is_admin") | (F.col("owner_id") == F.col("user_id")), F.lit(False))
    return asked.join(by_team, ["user_id", "resource_id"], "left").select(
        "request_id",
        "user_id",
        "resource_id",
        F.when(full, "edit").otherwise(permission_name(F.col("team_rank"))).alias("permission"),
    )


def owned_rows(records: DataFrame, users: DataFrame) -> DataFrame:
    """Rows each user may handle as owner (``owner_id``)."""
    return records.join(users.select(F.col("user_id").alias("owner_id")), "owner_id", "left_semi")


def authenticate(requests: DataFrame, sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (``request_id, token, ts``) with the user of a session still valid at that time."""
    valid = (
        requests.join(sessions.select("token", F.col("user_id"), "expires_at"), "token")
        .where(F.col("expires_at") > F.col("ts"))
        .join(users.select("user_id", "name"), "user_id")
        .select("request_id", "user_id", "name")
    )
    return requests.select("request_id", "token").join(valid, "request_id", "left")
