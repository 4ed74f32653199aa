"""Exports: CSV rows, JSON documents, gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import escape_label, online, round_to
from ..operators.aggregates import alert_counts
from ..operators.selection import window_since
from ..operators.silver import container_counts, explode_items, system_summary, zfs_pools

CSV_COLUMNS = ("timestamp", "hostname", "cpu_percent", "memory_percent", "memory_used_bytes", "disk_percent",
               "load_1m", "load_5m", "load_15m", "uptime_seconds")


def system_csv(samples: DataFrame, nodes: DataFrame, as_of: Column, hours: int = 168, node: str | None = None) -> DataFrame:
    """Rows of the system export, newest first; the payload's host name wins over the registry's."""
    s = window_since(samples, hours, as_of)
    if node is not None:
        s = s.filter(F.col("node_id") == node)
    s = s.join(nodes.select("node_id", F.col("hostname").alias("_registered")), "node_id")
    return s.select(
        F.col("ts").alias("timestamp"), F.coalesce("hostname", "_registered").alias("hostname"),
        round_to(F.coalesce("cpu_percent", F.lit(0.0)), 2).alias("cpu_percent"),
        round_to(F.coalesce("memory_percent", F.lit(0.0)), 2).alias("memory_percent"),
        "memory_used_bytes", round_to("disk_percent", 2).alias("disk_percent"),
        F.col("load1").alias("load_1m"), F.col("load5").alias("load_5m"), F.col("load15").alias("load_15m"),
        "uptime_seconds").orderBy(F.desc("timestamp"), "hostname")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.select(*CSV_COLUMNS).write.mode("errorifexists").option("header", True).csv(path)


def export_documents(nodes: DataFrame, metrics: DataFrame, alerts: DataFrame, as_of: Column, hours: int = 168) -> DataFrame:
    """JSON lines per node for `write.text`: a header line with the counts, then a line per metric and alert.

    One document per node would gather a node's whole history in one row, so the parts stay separate lines
    that share the node id; counts come from partial aggregates.
    """
    m, a = window_since(metrics, hours, as_of), alerts
    mc = m.groupBy("node_id").agg(F.count(F.lit(1)).alias("metrics_count"))
    ac = a.groupBy("node_id").agg(F.count(F.lit(1)).alias("alerts_count"))
    heads = nodes.join(mc, "node_id", "left").join(ac, "node_id", "left").na.fill(0, ["metrics_count", "alerts_count"])
    head = F.to_json(F.struct("node_id", "hostname", "os", "arch", "registered_at", as_of.alias("exported_at"),
                              "metrics_count", "alerts_count"))
    known = nodes.select("node_id")
    line = lambda df, kind: df.join(known, "node_id", "left_semi").select(
        "node_id", F.lit(kind).alias("part"), F.to_json(F.struct("*")).alias("value"))
    return (heads.select("node_id", F.lit("node").alias("part"), head.alias("value"))
            .unionByName(line(m, "metric")).unionByName(line(a, "alert")))


def _gauge(df: DataFrame, values: dict[str, Column], *labels: str) -> DataFrame:
    """Long rows (metric, labels, value) of a wide row, one pass."""
    pairs = F.map_from_arrays(F.array(*[F.lit(x) for x in ("node_id", "hostname", *labels)]),
                              F.array(*[F.col(c).cast("string") for c in ("node_id", "hostname", *labels)]))
    items = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])
    return df.select(pairs.alias("labels"), F.explode(items).alias("g")).select("g.metric", "labels", "g.value").filter(
        "value is not null")


def gauges(nodes: DataFrame, system: DataFrame, docker: DataFrame, gpu: DataFrame, smart: DataFrame, zfs: DataFrame,
           alerts: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """All gauges of the latest samples: (metric, labels MAP, value)."""
    named = nodes.select("node_id", "hostname", "last_seen")
    base = (
        named.join(system_summary(system).drop("ts", "sample_id"), "node_id", "left")
        .join(container_counts(docker).select("node_id", "containers_total", "containers_running"), "node_id", "left")
        .join(alert_counts(alerts), "node_id", "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    host = _gauge(base, {
        "node_online": online("last_seen", as_of, minutes).cast("int"),
        "cpu_percent": zero("cpu_percent"), "memory_percent": zero("memory_percent"),
        "disk_percent": zero("disk_percent"), "uptime_seconds": zero("uptime_seconds"),
        "containers_total": zero("containers_total"), "containers_running": zero("containers_running"),
        "alerts_active": zero("alert_count")})
    g = explode_items(gpu, "devices").join(named, "node_id").withColumn("gpu", F.col("index"))
    d = explode_items(smart, "devices").join(named, "node_id").withColumn("device", F.replace("device", F.lit('"'), F.lit("")))
    p = zfs_pools(zfs).join(named, "node_id").withColumn("pool", F.replace("name", F.lit('"'), F.lit("")))
    return (
        host.unionByName(_gauge(g, {"gpu_utilization_percent": F.col("utilization_percent"),
                                    "gpu_temperature_celsius": F.col("temperature_celsius")}, "gpu"))
        .unionByName(_gauge(d, {
            "smart_healthy": F.coalesce("healthy", F.lit(True)).cast("int"),
            "smart_temperature_celsius": F.nullif("temperature_c", F.lit(0.0))}, "device"))
        .unionByName(_gauge(p, {"zfs_pool_used_percent": round_to(F.coalesce("used_percent", F.lit(0.0)), 1),
                                "zfs_pool_healthy": F.col("pool_healthy").cast("int")}, "pool")))


def gauge_lines(rows: DataFrame, prefix: str = "fleet_") -> DataFrame:
    """Text exposition lines of the gauges, for `write.text`."""
    labels = F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat(
        e["key"], F.lit('="'), escape_label(e["value"]), F.lit('"'))), ",")
    return rows.select(F.concat(F.lit(prefix), "metric", F.lit("{"), labels, F.lit("} "), F.col("value").cast("string")).alias("value"))
