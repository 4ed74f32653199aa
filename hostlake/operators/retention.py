"""Retention by plan, erasure, and staged rewrites of partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import micros
from .accounts import DEFAULT_PLAN, LOG_HOURS, METRIC_HOURS, owner_of_node, plan_hours, plan_of_account


def _expired(ts: str, hours: Column, as_of: Column) -> Column:
    return micros(ts) < micros(as_of) - hours.cast("bigint") * F.lit(3_600_000_000)


def _split(facts: DataFrame, hours_by_node: DataFrame, as_of: Column, ts: str, default: Column) -> DataFrame:
    """Facts with `expired`. Only nodes that differ from the default window are joined."""
    return facts.join(hours_by_node, "node_id", "left").withColumn(
        "expired", _expired(ts, F.coalesce("hours", default), as_of)).drop("hours")


def metric_windows(nodes: DataFrame, ownership: DataFrame, limits: dict[str, int] = METRIC_HOURS) -> DataFrame:
    """Hours kept per node, the fewest of its registrations' plans; defaults are left out."""
    plan = F.coalesce("plan", F.lit(DEFAULT_PLAN))
    hours = ownership.groupBy("node_id").agg(F.min(plan_hours(plan, limits)).alias("hours"))
    return nodes.select("node_id").distinct().join(hours, "node_id").filter(F.col("hours") != limits[DEFAULT_PLAN])


def log_windows(nodes: DataFrame, ownership: DataFrame, limits: dict[str, int] = LOG_HOURS) -> DataFrame:
    """Hours kept per registered node, from the latest plan of the account that owns it (by its newest registration)."""
    owned = nodes.select("node_id").distinct().join(owner_of_node(ownership).select("node_id", "account"), "node_id", "left")
    plans = owned.join(plan_of_account(ownership), "account", "left").select(
        "node_id", F.coalesce("plan", F.lit(DEFAULT_PLAN)).alias("plan"))
    return plans.select("node_id", plan_hours("plan", limits).alias("hours"))


def expire_metrics(metrics: DataFrame, nodes: DataFrame, ownership: DataFrame, as_of: Column, ts: str = "ts",
                   limits: dict[str, int] = METRIC_HOURS) -> DataFrame:
    """Metrics with `expired` by the plan window; orphans and unknown plans use the default window."""
    return _split(metrics, metric_windows(nodes, ownership, limits), as_of, ts, F.lit(limits[DEFAULT_PLAN]))


def expire_logs(logs: DataFrame, nodes: DataFrame, ownership: DataFrame, as_of: Column, ts: str = "ts",
                limits: dict[str, int] = LOG_HOURS) -> DataFrame:
    """Logs with `expired` by the account's plan; logs of unregistered nodes are never expired."""
    rows = logs.join(log_windows(nodes, ownership, limits), "node_id", "left")
    return rows.withColumn("expired", F.coalesce(_expired(ts, F.col("hours"), as_of), F.lit(False))).drop("hours")


def expire_flat(df: DataFrame, hours: int, as_of: Column, ts: str) -> DataFrame:
    """One window for all rows, e.g. alerts (active ones too) after 720 hours."""
    return df.withColumn("expired", _expired(ts, F.lit(hours), as_of))


def kept(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("expired")).drop("expired")


def removed_per_node(df: DataFrame) -> DataFrame:
    return df.groupBy("node_id").agg(F.count_if("expired").alias("removed"), F.count_if(~F.col("expired")).alias("kept"))


def without_nodes(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of all nodes but the deleted ones."""
    return df.join(gone.select("node_id").distinct(), "node_id", "left_anti")


def delete_nodes(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every node table without the deleted nodes."""
    return {name: without_nodes(df, gone) for name, df in tables.items()}


def erase_account(account: str, ownership: DataFrame, node_tables: dict[str, DataFrame],
                  account_tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables without the account: its nodes' rows, its settings and channels, its registrations."""
    gone = ownership.filter(F.col("account") == account)
    out = delete_nodes(node_tables, gone)
    for name, df in account_tables.items():
        owner = "owner" if "owner" in df.columns else "account"
        out[name] = df.filter(F.col(owner).isNull() | (F.col(owner) != account))
    out["ownership"] = ownership.filter(F.col("account") != account)
    return out
