"""Ownership, plans, thresholds and notification routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import severity_rank
from .latest import latest_row
from .ordered import trailing_count

# Plan limits and default thresholds.
DEFAULT_PLAN = "free"
NODE_CAP = {"free": 3}
METRIC_HOURS = {"free": 720, "pro": 8760, "business": 8760}
LOG_HOURS = {"free": 24, "pro": 168, "business": 720}
THRESHOLDS = {
    "cpu_warning": 90, "memory_warning": 85, "memory_critical": 95, "disk_warning": 80, "disk_critical": 90,
    "gpu_util_warning": 90, "gpu_mem_warning": 90, "gpu_temp_warning": 85, "gpu_temp_critical": 95,
}
SEVERITIES = ("info", "warning", "critical")

# Rows with the same admin severity are spread over this many join keys (see route_notifications).
ROUTE_SALTS = 32


def with_hostname(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Inner join with the registry: adds the host name and drops rows of unregistered nodes."""
    return facts.join(nodes.select("node_id", "hostname"), "node_id")


def nodes_of_account(nodes: DataFrame, ownership: DataFrame) -> DataFrame:
    """Every account's nodes; sort or filter by account as needed (newest registration first)."""
    return nodes.join(ownership.select("account", "node_id"), "node_id")


def owner_of_node(ownership: DataFrame) -> DataFrame:
    """One registration per node, the newest: a node can be registered again, and facts must not be multiplied by that."""
    order = [c for c in ("created_at", "account") if c in ownership.columns]
    return latest_row(ownership, ["node_id"], order)


def node_plan(nodes: DataFrame, ownership: DataFrame) -> DataFrame:
    """Plan stored with the node's newest registration, the default when there is none."""
    own = owner_of_node(ownership).select("node_id", "plan")
    return nodes.select("node_id").join(own, "node_id", "left").withColumn(
        "plan", F.coalesce("plan", F.lit(DEFAULT_PLAN)))


def plan_of_account(ownership: DataFrame) -> DataFrame:
    """Plan of each account's most recent registration."""
    newest = latest_row(ownership.select("account", "plan", "created_at", "node_id"), ["account"],
                        ["created_at", "node_id"])
    return newest.select("account", F.coalesce("plan", F.lit(DEFAULT_PLAN)).alias("plan"))


def plan_hours(plan, limits: dict[str, int]) -> Column:
    """Retention of a plan in hours; an unknown plan counts as the default one."""
    plan = F.col(plan) if isinstance(plan, str) else plan
    out = F.lit(limits[DEFAULT_PLAN])
    for name, hours in limits.items():
        out = F.when(plan == name, hours).otherwise(out)
    return out


def threshold_cascade(nodes: DataFrame, ownership: DataFrame, preferences: DataFrame) -> DataFrame:
    """One column per threshold and node: node setting, else account setting, else default."""
    glob = preferences.filter("node_id is null").select("account", F.col("data").alias("g"))
    local = preferences.filter("node_id is not null").select("account", "node_id", F.col("data").alias("l"))
    owned = (
        nodes.select("node_id").join(owner_of_node(ownership).select("account", "node_id"), "node_id", "left")
        .join(glob, "account", "left").join(local, ["account", "node_id"], "left"))
    return owned.select("node_id", *[
        F.coalesce(F.col("l")[k], F.col("g")[k], F.lit(float(v))).alias(k) for k, v in THRESHOLDS.items()])


def orphans(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Fact rows of nodes that are not registered."""
    return facts.join(nodes.select("node_id"), "node_id", "left_anti")


def route_notifications(alerts: DataFrame, channels: DataFrame, ownership: DataFrame) -> DataFrame:
    """Outbox rows (alert, channel, scope) for every enabled channel whose minimum severity is reached.

    Comparing severities is turned into equality: a channel is listed once under each severity it
    accepts. Three severities alone would be three hot keys, so admin channels are repeated under a
    salt that alert ids are spread over; owner channels match on (account, severity) and the same salt.
    """
    accepted = F.expr("filter(array('info','warning','critical'), s -> "
                      "case s when 'critical' then 2 when 'warning' then 1 else 0 end >= "
                      "case min_severity when 'critical' then 2 when 'warning' then 1 else 0 end)")
    offers = (
        channels.filter("enabled")
        .select("channel_id", "channel_type", "owner", F.explode(accepted).alias("severity"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(ROUTE_SALTS - 1)))))
    salted = alerts.select("alert_id", "node_id", "alert_type", "severity").withColumn(
        "salt", F.pmod(F.hash("alert_id"), F.lit(ROUTE_SALTS)))
    admin = salted.join(offers.filter("owner is null").drop("owner"), ["severity", "salt"]).withColumn(
        "scope", F.lit("admin"))
    owned = salted.join(ownership.select("node_id", F.col("account").alias("owner")), "node_id")
    user = owned.join(offers.filter("owner is not null"), ["owner", "severity", "salt"]).withColumn(
        "scope", F.lit("user"))
    cols = ["alert_id", "node_id", "alert_type", "severity", "channel_id", "channel_type", "scope"]
    return admin.select(*cols).unionByName(user.select(*cols))


def pinned_first(rows: DataFrame, pins: DataFrame, *order: Column) -> DataFrame:
    """Adds the pinned flag of a node and sorts pinned rows first."""
    flag = pins.select("node_id").distinct().withColumn("pinned", F.lit(True))
    out = rows.join(flag, "node_id", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    return out.orderBy(F.desc("pinned"), *order)


def account_node_usage(ownership: DataFrame) -> DataFrame:
    """Nodes per account against its plan's cap (null means unlimited)."""
    cap = F.lit(None).cast("int")
    for plan, n in NODE_CAP.items():
        cap = F.when(F.col("plan") == plan, n).otherwise(cap)
    used = ownership.groupBy("account").agg(F.count(F.lit(1)).alias("node_count"))
    return used.join(plan_of_account(ownership), "account").withColumn("node_cap", cap).withColumns({
        "remaining": F.when(F.col("node_cap").isNotNull(), F.greatest(F.col("node_cap") - F.col("node_count"), F.lit(0))),
        "at_limit": F.coalesce(F.col("node_count") >= F.col("node_cap"), F.lit(False))})


def rate_limit_audit(attempts: DataFrame, keys: list[str], ts: str, seconds: int, allowed: int) -> DataFrame:
    """Attempts of the key in the trailing period before each attempt, and whether it was let through."""
    counted = trailing_count(attempts, keys, ts, seconds, "in_window")
    return counted.withColumn("earlier", F.col("in_window") - 1).withColumn(
        "allowed", F.col("earlier") < allowed).drop("in_window")


def apply_plan_changes(ownership: DataFrame, events: DataFrame) -> DataFrame:
    """Registrations with the plan of the account's latest valid plan event.

    A checkout sets a known paid plan, a deleted subscription goes back to the default; events without
    an account or with an unknown plan are ignored.
    """
    account = F.lower(F.trim("email"))
    plan = F.lower(F.trim("plan"))
    paid = [p for p in METRIC_HOURS if p != DEFAULT_PLAN]
    valid = events.select(
        F.nullif(account, F.lit("")).alias("account"), "occurred_at", "event_id",
        F.when((F.col("kind") == "checkout") & plan.isin(*paid), plan)
        .when(F.col("kind") == "subscription_deleted", DEFAULT_PLAN).alias("new_plan"),
    ).filter("account is not null and new_plan is not null")
    newest = latest_row(valid, ["account"], ["occurred_at", "event_id"]).select("account", "new_plan")
    return ownership.join(newest, "account", "left").withColumn(
        "plan", F.coalesce("new_plan", "plan")).drop("new_plan")


def should_notify(severity, min_severity) -> Column:
    return severity_rank(severity) >= severity_rank(min_severity)
