"""Filters over the fact tables. Time bounds stay plain comparisons, so they reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import shift


def from_time(df: DataFrame, ts: str, bound: Column, strict: bool = False) -> DataFrame:
    """Rows at or after the bound. Tables with a `date` partition get the same bound in days, which prunes their folders."""
    if "date" in df.columns:
        df = df.filter(F.col("date") >= F.to_date(bound))
    return df.filter(F.col(ts) > bound if strict else F.col(ts) >= bound)


def until_time(df: DataFrame, ts: str, bound: Column) -> DataFrame:
    """Rows at or before the bound, pruned likewise."""
    if "date" in df.columns:
        df = df.filter(F.col("date") <= F.to_date(bound))
    return df.filter(F.col(ts) <= bound)


def window_since(df: DataFrame, hours: int, as_of: Column, ts: str = "ts") -> DataFrame:
    """Rows strictly younger than `hours` before as_of."""
    return from_time(df, ts, shift(as_of, hours=-hours), strict=True)


def alerts_in_range(alerts: DataFrame, node: str | None = None, start: Column | None = None,
                    end: Column | None = None, limit: int | None = None) -> DataFrame:
    """Both ends inclusive, every part optional, newest first; unlimited unless asked."""
    if node is not None:
        alerts = alerts.filter(F.col("node_id") == node)
    if start is not None:
        alerts = from_time(alerts, "created_at", start)
    if end is not None:
        alerts = until_time(alerts, "created_at", end)
    alerts = alerts.orderBy(F.desc("created_at"), F.desc("alert_id"))
    return alerts if limit is None else alerts.limit(limit)


def active_alerts(alerts: DataFrame, node: str | None = None) -> DataFrame:
    alerts = alerts.filter(F.col("resolved_at").isNull())
    if node is not None:
        alerts = alerts.filter(F.col("node_id") == node)
    return alerts


def get_logs(logs: DataFrame, node: str | None = None, level: str | None = None, source: str | None = None,
             since: Column | None = None, until: Column | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of entries, newest first; limit is held within 1..1000 and offset at 0 or more."""
    if node is not None:
        logs = logs.filter(F.col("node_id") == node)
    if level:
        logs = logs.filter(F.col("level") == level.lower())
    if source:
        logs = logs.filter(F.col("source") == source)
    if since is not None:
        logs = from_time(logs, "ts", since)
    if until is not None:
        logs = until_time(logs, "ts", until)
    page = logs.orderBy(F.desc("ts"), F.desc("log_id")).offset(max(0, offset))
    return page.limit(max(1, min(limit, 1000)))


def search_logs(logs: DataFrame, text: str, node: str | None = None, limit: int = 50) -> DataFrame:
    """Case-insensitive substring; % and _ in the text act as wildcards. Limit within 1..500."""
    if node is not None:
        logs = logs.filter(F.col("node_id") == node)
    hits = logs.filter(F.col("message").ilike(f"%{text}%"))
    return hits.orderBy(F.desc("ts"), F.desc("log_id")).limit(max(1, min(limit, 500)))


def recent_error_logs(logs: DataFrame, nodes: DataFrame, limit: int = 10) -> DataFrame:
    """Newest error entries of registered nodes with their host name."""
    errors = logs.filter(F.col("level") == "error")
    known = errors.join(nodes.select("node_id", "hostname"), "node_id")
    return known.orderBy(F.desc("ts"), F.desc("log_id")).limit(limit)


def active_maintenance(windows: DataFrame, as_of: Column, nodes: DataFrame | None = None) -> DataFrame:
    rows = windows.filter(F.col("enabled") & (F.col("ends_at").isNull() | (F.col("ends_at") > as_of)))
    return rows if nodes is None else rows.join(nodes.select("node_id"), "node_id", "left_semi")


def scope(df: DataFrame, ownership: DataFrame, account: str | None) -> DataFrame:
    """Rows of the account's own nodes; everything for the administrator (no account)."""
    if account is None:
        return df
    mine = ownership.filter(F.col("account") == account).select("node_id")
    return df.join(mine, "node_id", "left_semi")
