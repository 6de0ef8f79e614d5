"""Users, roles, workspaces: permissions and membership as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def permitted(requests: DataFrame, users: DataFrame, permissions: DataFrame) -> DataFrame:
    """requests(request_id, user_id, permission, by_key) with allowed and reason: a key may search only; unknown or inactive users may nothing."""
    known = requests.join(users.select("user_id", "role", "active"), "user_id", "left")
    granted = permissions.select("role", "permission").distinct().withColumn("granted", F.lit(True))
    out = known.join(granted, ["role", "permission"], "left")
    reason = (
        F.when(F.col("by_key"), F.when(F.col("permission") == "search", "ok").otherwise("keys may search only")).when(F.col("active").isNull(), "unknown user").when(~F.col("active"), "inactive user")
        .when(F.col("granted"), "ok").otherwise("no such permission")
    )
    return out.select("request_id", "user_id", "permission", (reason == "ok").alias("allowed"), reason.alias("reason"))


def workspaces_of(members: DataFrame, user_id: str, active_only: bool = True) -> DataFrame:
    rows = members.where(F.col("user_id") == user_id)
    return (rows.where("active") if active_only else rows).select("workspace_id").distinct()


def workspace_counters(actions: DataFrame) -> DataFrame:
    """(workspace_id, searches, documents, exports, last_activity) of actions(workspace_id, action, ts)."""
    of = lambda a: F.count_if(F.col("action") == a)
    return actions.groupBy("workspace_id").agg(of("search").alias("searches"), of("document").alias("documents"), of("export").alias("exports"), F.max("ts").alias("last_activity"))


def free_names(wanted: DataFrame, users: DataFrame) -> DataFrame:
    """New users whose name and email nobody has, the first of each by user_id."""
    taken = users.select(F.lower("username").alias("u"), F.lower("email").alias("e"))
    out = wanted.join(taken.select("u"), F.lower("username") == F.col("u"), "left_anti").join(taken.select("e"), F.lower("email") == F.col("e"), "left_anti")
    return out.dropDuplicates(["username"]).dropDuplicates(["email"])
