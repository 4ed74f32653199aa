"""Grouped summaries. Every one is a partial + final aggregate; joins come after the reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import online, round_to
from .selection import active_alerts, window_since

METRICS = {"cpu": "cpu_percent", "memory": "memory_percent", "disk": "disk_percent", "load": "load1"}


def metrics_summary(samples: DataFrame, alerts: DataFrame, as_of: Column, hours: int = 168) -> DataFrame:
    """Per node: sample count, min / max / avg / current of four metrics, alerts fired and resolved.

    Missing readings are skipped, a metric without readings is 0. (node, ts) is unique after landing,
    so `current` may order by ts alone, which keeps the aggregate hash based.
    """
    s = window_since(samples, hours, as_of)
    aggs = [F.count(F.lit(1)).alias("sample_count")]
    for name, c in METRICS.items():
        v = F.col(c)
        seen = F.when(v.isNotNull(), F.col("ts"))
        for stat, value in (("min", F.min(v)), ("max", F.max(v)), ("avg", F.avg(v)), ("current", F.max_by(v, seen))):
            aggs.append(F.coalesce(round_to(value, 2), F.lit(0.0)).alias(f"{name}_{stat}"))
    a = window_since(alerts, hours, as_of, "created_at").groupBy("node_id").agg(
        F.count(F.lit(1)).alias("alerts_total"), F.count("resolved_at").alias("alerts_resolved"))
    return s.groupBy("node_id").agg(*aggs).join(a, "node_id", "left").na.fill(0, ["alerts_total", "alerts_resolved"])


def node_stats(nodes: DataFrame, metrics: DataFrame, alerts: DataFrame) -> DataFrame:
    m = metrics.groupBy("node_id").agg(F.count(F.lit(1)).alias("metric_count"))
    a = active_alerts(alerts).groupBy("node_id").agg(F.count(F.lit(1)).alias("active_alerts"))
    return (nodes.select("node_id").join(m, "node_id", "left").join(a, "node_id", "left")
            .na.fill(0, ["metric_count", "active_alerts"]))


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Active alerts per node: total and critical."""
    return active_alerts(alerts).groupBy("node_id").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"))


def severity_breakdown(alerts: DataFrame, *by: str) -> DataFrame:
    return alerts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")],
        F.count_if(F.col("resolved_at").isNull()).alias("active"),
        F.count("resolved_at").alias("resolved"))


def alert_type_breakdown(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type").agg(F.count(F.lit(1)).alias("alerts"))


def log_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("node_id", "level", "source").agg(F.count(F.lit(1)).alias("entries"))


def log_sources(logs: DataFrame) -> DataFrame:
    return logs.select("node_id", "source").distinct()


def range_anomalies(samples: DataFrame, start: Column, end: Column) -> DataFrame:
    """Nodes whose CPU went over 80 or memory over 85 in the range, with peak and mean."""
    s = samples.filter((F.col("ts") >= start) & (F.col("ts") <= end))
    g = s.groupBy("node_id").agg(
        F.max("cpu_percent").alias("cm"), F.avg("cpu_percent").alias("ca"),
        F.max("memory_percent").alias("mm"), F.avg("memory_percent").alias("ma"))
    cpu, mem = F.col("cm") > 80, F.col("mm") > 85
    return g.filter(cpu | mem).select(
        "node_id", F.when(cpu, round_to("cm", 1)).alias("cpu_peak"), F.when(cpu, round_to("ca", 1)).alias("cpu_avg"),
        F.when(mem, round_to("mm", 1)).alias("memory_peak"), F.when(mem, round_to("ma", 1)).alias("memory_avg"))


def fleet_totals(nodes: DataFrame, alerts: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """One row: nodes, online, offline, active and critical alerts, and the health class."""
    per_node = nodes.select("node_id", online("last_seen", as_of, minutes).alias("up")).join(
        alert_counts(alerts), "node_id", "left")
    g = per_node.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if("up").alias("online"), F.count_if(~F.col("up")).alias("offline"),
        F.coalesce(F.sum("alert_count"), F.lit(0)).alias("alerts_total"),
        F.coalesce(F.sum("critical_count"), F.lit(0)).alias("alerts_critical"))
    return g.withColumn(
        "health",
        F.when((F.col("alerts_total") == 0) & (F.col("offline") == 0), "healthy")
        .when(F.col("alerts_critical") > 0, "critical").when(F.col("offline") > 0, "degraded")
        .when(F.col("alerts_total") > 0, "mostly_healthy").otherwise("normal"))


def offline_nodes(nodes: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    return nodes.filter(~online("last_seen", as_of, minutes)).select("node_id", "hostname", "last_seen")


def container_totals(containers: DataFrame) -> DataFrame:
    return containers.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "running").alias("running"),
        F.count_if(~F.coalesce(F.col("state") == "running", F.lit(False))).alias("stopped"))


def node_max_temp(temps: DataFrame) -> DataFrame:
    return temps.groupBy("node_id").agg(F.max("value").alias("max_temp"), F.count(F.lit(1)).alias("sensors"))


def smart_health_counts(drives: DataFrame) -> DataFrame:
    """Drives by tri-state health and the hosts they are in. Hosts are counted from one row per host."""
    per_host = drives.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("d"), F.count_if("healthy").alias("h"), F.count_if(~F.col("healthy")).alias("u"))
    return per_host.agg(
        F.sum("d").alias("drives"), F.sum("h").alias("healthy"), F.sum("u").alias("unhealthy"),
        (F.sum("d") - F.sum("h") - F.sum("u")).alias("unknown"), F.count(F.lit(1)).alias("hosts"))


def inventory(nodes: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    return nodes.withColumn("up", online("last_seen", as_of, minutes)).groupBy("os", "arch", "agent_version").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if("up").alias("online"), F.count_if(~F.col("up")).alias("offline"))


def question_stats(routed: DataFrame) -> DataFrame:
    """Questions per type with the share that found a handler and the mean confidence."""
    matched = F.when(F.col("query_type").isin("fallback", "error"), 0).otherwise(1)
    return routed.groupBy("query_type").agg(
        F.count(F.lit(1)).alias("questions"), F.sum(matched).alias("matched"),
        round_to(F.avg(matched), 4).alias("match_rate"), round_to(F.avg("confidence"), 4).alias("mean_confidence"))
