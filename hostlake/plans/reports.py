"""Fleet reports. Each is one join plan over the newest sample per node, computed for all nodes at once.

Facts are reduced to one row per node before any join, so the joins are between tables of fleet size.
`state` below is the registry with those rows attached (see fleet_state).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.questions import parse_time_range
from ..functions.scalars import (
    bytes_to_gb, format_uptime, last_seen_ago, metric_band, online, round_to, severity_rank, shift, temp_band,
    until_relative,
)
from ..operators.accounts import pinned_first
from ..operators.aggregates import alert_counts, node_max_temp, severity_breakdown
from ..operators.latest import latest_row
from ..operators.ordered import competition_rank
from ..operators.selection import active_alerts, active_maintenance, alerts_in_range
from ..operators.series import latest_network_rates
from ..operators.silver import container_counts, explode_items, gpu_devices, system_summary, temperatures


def fleet_state(nodes: DataFrame, system: DataFrame, docker: DataFrame | None, gpu: DataFrame | None,
                alerts: DataFrame | None, as_of: Column, minutes: int = 5) -> DataFrame:
    """Registry + newest readings (0 when missing) + container, GPU and alert counts + online."""
    out = nodes.join(system_summary(system).drop("ts", "sample_id"), "node_id", "left")
    zeros = ["cpu_percent", "memory_percent", "disk_percent", "uptime_seconds", "load_1m", "cpu_count",
             "memory_total_bytes", "memory_total_gb", "disk_total_gb", "net_rx_bytes", "net_tx_bytes"]
    if docker is not None:
        counts = container_counts(docker).select("node_id", "containers_total", "containers_running")
        restarts = F.size(F.filter("containers", lambda c: c["restart_count"] > 3))
        out = out.join(counts, "node_id", "left").join(
            docker.select("node_id", restarts.alias("restarting")), "node_id", "left")
        zeros += ["containers_total", "containers_running", "restarting"]
    if gpu is not None:
        first = F.get("devices", F.lit(0))
        out = out.join(gpu.select(
            "node_id", F.size("devices").alias("gpu_count"), "devices",
            F.coalesce(first["utilization_percent"], F.lit(0.0)).alias("gpu_utilization"),
            F.coalesce(first["memory_used_percent"], F.lit(0.0)).alias("gpu_memory"),
            F.coalesce(first["temperature_celsius"], F.lit(0.0)).alias("gpu_temperature")), "node_id", "left")
        zeros += ["gpu_count"]
    if alerts is not None:
        out = out.join(alert_counts(alerts), "node_id", "left")
        zeros += ["alert_count", "critical_count"]
    return out.na.fill(0, zeros).withColumn("online", online("last_seen", as_of, minutes))


def _pressure() -> Column:
    return F.col("load_1m") > F.when(F.col("cpu_count") > 0, F.col("cpu_count") * 2).otherwise(4)


def node_status(state: DataFrame, alerts: DataFrame, as_of: Column) -> DataFrame:
    """Status line of every node, or of those a caller filters for, with its newest active alert."""
    newest = latest_row(active_alerts(alerts).select("node_id", "message", "created_at", "alert_id"), ["node_id"],
                        ["created_at", "alert_id"]).select("node_id", F.col("message").alias("latest_alert"))
    return state.join(newest, "node_id", "left").select(
        "node_id", "hostname", "online", "cpu_percent", "memory_percent", "disk_percent", "load_1m",
        format_uptime("uptime_seconds").alias("uptime"), "containers_running", "containers_total", "gpu_count",
        "gpu_utilization", "gpu_temperature", "alert_count", "critical_count", "latest_alert",
        last_seen_ago("last_seen", as_of).alias("seen"))


# Words of a ranking question and the column they rank.
RANK_METRICS = {
    "cpu": "cpu_percent", "memory": "memory_percent", "mem": "memory_percent", "ram": "memory_percent",
    "disk": "disk_percent", "storage": "disk_percent", "load": "load_1m", "gpu": "gpu_utilization", "vram": "gpu_memory",
}


def rank_nodes(state: DataFrame, metric: str = "cpu", ascending: bool = False) -> DataFrame:
    """All nodes by a metric; equal values share a rank. GPU metrics leave out nodes without one."""
    c = RANK_METRICS[metric]
    if metric in ("gpu", "vram"):
        state = state.filter("gpu_count > 0")
    rows = state.select("node_id", "hostname", F.col(c).cast("double").alias("value"), "online", "last_seen")
    ranked = competition_rank(rows, "value", ascending)
    top = F.col("rank") == 1
    note = F.when(top & (F.col("value") < 10), "idle") if ascending else F.when(top & (F.col("value") > 80), "hot")
    order = F.asc("value") if ascending else F.desc("value")
    return ranked.select("rank", "node_id", "hostname", "value", "online", note.alias("note"), "last_seen").orderBy(
        order, F.desc("last_seen"), "node_id").drop("last_seen")


def rank_containers(containers: DataFrame, metric: str = "cpu", ascending: bool = False, limit: int = 10) -> DataFrame:
    """The heaviest (or lightest) containers by memory or CPU; containers without the reading are left out."""
    c = "memory_usage_bytes" if metric in ("memory", "mem", "ram") else "cpu_percent"
    order = F.asc(c) if ascending else F.desc(c)
    return containers.filter(F.col(c).isNotNull()).orderBy(order, "node_id", "name").select(
        "node_id", "name", F.col(c).cast("double").alias("value")).limit(limit)


def time_range_report(alerts: DataFrame, text: str, as_of: Column) -> DataFrame:
    """Alert counts per type fired in the range that the text speaks of."""
    span = parse_time_range(F.lit(text), as_of)
    return alerts.filter((F.col("created_at") >= span["start"]) & (F.col("created_at") <= span["end"])).groupBy(
        "alert_type").agg(
        F.count(F.lit(1)).alias("fired"), F.count("resolved_at").alias("resolved"),
        F.count_if(F.col("resolved_at").isNull()).alias("active"),
        F.count_if(F.col("severity") == "critical").alias("critical"))


def critical_in_range(alerts: DataFrame, start: Column, end: Column, limit: int = 3) -> DataFrame:
    """The newest critical messages of a range."""
    return alerts_in_range(alerts.filter("severity = 'critical'"), start=start, end=end, limit=limit)


def current_concerns(state: DataFrame) -> DataFrame:
    cpu, mem, disk = F.col("cpu_percent") > 80, F.col("memory_percent") > 85, F.col("disk_percent") > 85
    return state.filter(cpu | mem | disk).select("node_id", "hostname", F.array_join(F.array_compact(F.array(
        F.when(cpu, "CPU"), F.when(mem, "MEM"), F.when(disk, "DISK"))), ",").alias("concerns"))


def diagnose_nodes(state: DataFrame) -> DataFrame:
    """Findings per online node, in fixed order, GPU findings per device."""
    gpus = F.coalesce("devices", F.expr("array()").cast(state.schema["devices"].dataType))

    def each(field, limit, finding):
        return F.transform(F.filter(gpus, lambda g: g[field] > limit), lambda g: F.lit(finding))

    findings = F.array_compact(F.concat(
        F.array(F.when(_pressure() & (F.col("cpu_percent") < 30), "I/O pressure"),
                F.when(F.col("cpu_percent") > 80, "high CPU"), F.when(F.col("memory_percent") > 85, "memory pressure"),
                F.when(F.col("disk_percent") > 85, "disk space")),
        each("utilization_percent", 90, "GPU compute pressure"), each("memory_used_percent", 90, "GPU memory pressure"),
        each("temperature_celsius", 85, "GPU overheating"),
        F.array(F.when(F.col("restarting") > 0, "container restarts"), F.when(F.col("alert_count") > 0, "active alerts"))))
    return state.select(
        "node_id", "hostname", "online", F.when(F.col("online"), F.array_join(findings, ",")).otherwise("OFFLINE").alias("findings"),
        "alert_count")


def diagnose_fleet(state: DataFrame) -> DataFrame:
    """Nodes with a concern: offline, or pressure on a resource."""
    issues = F.array_compact(F.array(
        F.when(F.col("cpu_percent") > 80, "CPU"), F.when(F.col("memory_percent") > 85, "MEM"),
        F.when(F.col("disk_percent") > 85, "DISK"), F.when(_pressure(), "LOAD")))
    rows = state.withColumn("issues", F.when(~F.col("online"), F.array(F.lit("OFFLINE"))).otherwise(issues))
    return rows.filter(F.size("issues") > 0).select("node_id", "hostname", F.array_join("issues", ",").alias("issues"))


def gpu_report(nodes: DataFrame, gpu: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    return gpu_devices(gpu).join(nodes, "node_id").select(
        "node_id", "hostname", "name", F.coalesce("utilization_percent", F.lit(0.0)).alias("util"),
        F.col("memory_used_percent").alias("vram_used_pct"), round_to("vram_total_gb", 2).alias("vram_total_gb"),
        round_to("vram_used_gb", 2).alias("vram_used_gb"), round_to("vram_free_gb", 2).alias("vram_free_gb"),
        "temperature_celsius", "power_watts", "power_limit_watts", "fan_speed_percent",
        online("last_seen", as_of, minutes).alias("online"))


def smart_report(nodes: DataFrame, smart: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    state = F.when(F.col("healthy"), "OK").when(~F.col("healthy"), "FAIL").otherwise("?")
    return explode_items(smart, "devices").join(nodes, "node_id").select(
        "node_id", "hostname", "device", "model", state.alias("status"), "temperature_c", "power_on_hours",
        online("last_seen", as_of, minutes).alias("online"))


def disk_capacity(state: DataFrame, system: DataFrame) -> DataFrame:
    """Nodes by fill of the first disk, with band, warning and the first three mounts that report a size."""
    shown = F.transform(
        F.filter(F.slice("disks", 1, 3), lambda d: (d["used_percent"] > 0) & (d["total_bytes"] > 0)),
        lambda d: F.concat(d["mountpoint"], F.lit(":"), round_to(d["used_percent"], 1).cast("string"), F.lit(":"),
                           round_to(bytes_to_gb(F.coalesce(d["free_bytes"], F.lit(0))), 1).cast("string"), F.lit("/"),
                           round_to(bytes_to_gb(d["total_bytes"]), 1).cast("string")))
    pct = F.col("disk_percent")
    return state.join(system.select("node_id", "disks"), "node_id", "left").select(
        "node_id", "hostname", pct, metric_band(pct).alias("band"), "online",
        F.when(pct > 90, "critical").when(pct > 80, "approaching").alias("warning"),
        F.coalesce(F.array_join(shown, ","), F.lit("")).alias("mounts")).orderBy(F.desc("disk_percent"), "node_id")


def memory_capacity(state: DataFrame) -> DataFrame:
    pct = F.col("memory_percent")
    return state.select("node_id", "hostname", pct, (F.lit(100.0) - pct).alias("free_percent"), "memory_total_gb",
                        metric_band(pct).alias("band"), "online").orderBy(F.desc("memory_percent"), "node_id")


def uptime_report(state: DataFrame) -> DataFrame:
    return state.select("node_id", "hostname", format_uptime("uptime_seconds").alias("uptime"), "online")


def fleet_overview(state: DataFrame) -> DataFrame:
    """Node lines of the overview; the totals are fleet_totals."""
    return state.select(
        "node_id", "hostname",
        F.when(F.col("online") & (F.col("alert_count") == 0), "ok").when(F.col("alert_count") > 0, "alert")
        .otherwise("offline").alias("status"),
        "cpu_percent", "memory_percent", "disk_percent", "containers_total", "alert_count")


def alerts_report(alerts: DataFrame, as_of: Column, recent: bool = False) -> DataFrame:
    """Severity counts of active alerts, or of all alerts of the last 24 hours."""
    rows = alerts.filter((F.col("created_at") >= shift(as_of, hours=-24)) & (F.col("created_at") <= as_of)) if recent \
        else active_alerts(alerts)
    return severity_breakdown(rows)


def newest_alerts(alerts: DataFrame, nodes: DataFrame, as_of: Column, recent: bool = False) -> DataFrame:
    """The rows that the alerts report shows: the 8 newest active alerts, or the 5 newest of the last 24 hours."""
    rows = alerts_in_range(alerts, start=shift(as_of, hours=-24), end=as_of) if recent else alerts
    return alert_feed(rows, nodes, 5 if recent else 8, active_only=not recent)


def alert_feed(alerts: DataFrame, nodes: DataFrame, limit: int = 20, active_only: bool = False) -> DataFrame:
    """Newest alerts of registered nodes; limit within 1..100, applied after the filters."""
    rows = active_alerts(alerts) if active_only else alerts
    rows = rows.join(nodes.select("node_id", "hostname"), "node_id")
    return rows.orderBy(F.desc("created_at"), F.desc("alert_id")).limit(max(1, min(limit, 100)))


def containers_report(nodes: DataFrame, docker: DataFrame) -> DataFrame:
    rows = explode_items(docker, "containers").join(nodes.select("node_id", "hostname"), "node_id")
    return rows.select("node_id", "hostname", "name", "state", "status", "restart_count").orderBy("hostname", "name")


def temperature_report(nodes: DataFrame, system: DataFrame, gpu: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """Hottest reading and its band per node, hottest first; nodes without sensors have 0."""
    hot = node_max_temp(temperatures(system, gpu))
    rows = nodes.join(hot, "node_id", "left").na.fill(0, ["max_temp", "sensors"])
    return rows.select("node_id", "hostname", "max_temp", "sensors", temp_band("max_temp").alias("band"),
                       online("last_seen", as_of, minutes).alias("online")).orderBy(F.desc("max_temp"), "node_id")


def temperature_readings(nodes: DataFrame, system: DataFrame, gpu: DataFrame) -> DataFrame:
    return temperatures(system, gpu).join(nodes.select("node_id", "hostname"), "node_id").withColumn(
        "band", temp_band("value"))


def attention_issues(state: DataFrame, alerts: DataFrame) -> DataFrame:
    """(node_id, hostname, severity, issue): a row per issue of any kind."""
    up = F.col("online")

    def two(v, kind, high, low):
        return F.when(up & (v > high), _issue("critical", kind)).when(up & (v > low), _issue("warning", kind))

    def _issue(severity, kind):
        return F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("issue"))

    gpus = F.coalesce("devices", F.expr("array()").cast(state.schema["devices"].dataType))
    hot = F.transform(F.filter(gpus, lambda g: up & (g["temperature_celsius"] >= 80)), lambda g: F.struct(
        F.when(g["temperature_celsius"] >= 90, "critical").otherwise("warning").alias("severity"), F.lit("gpu_temp").alias("issue")))
    issues = F.array_compact(F.concat(F.array(
        F.when(~up, _issue("critical", "offline")), two(F.col("cpu_percent"), "cpu", 90, 80),
        two(F.col("memory_percent"), "memory", 90, 85), two(F.col("disk_percent"), "disk", 90, 85),
        F.when(up & _pressure(), _issue("warning", "load"))), hot))
    own = state.select("node_id", "hostname", F.explode(issues).alias("i")).select("node_id", "hostname", "i.*")
    fired = active_alerts(alerts).join(state.select("node_id", "hostname"), "node_id").select(
        "node_id", "hostname", "severity", F.concat(F.lit("alert: "), "message").alias("issue"))
    return own.unionByName(fired)


def attention(state: DataFrame, alerts: DataFrame) -> DataFrame:
    """Nodes with issues, worst severity first."""
    rank = severity_rank("severity")
    g = attention_issues(state, alerts).groupBy("node_id", "hostname").agg(
        F.count(F.lit(1)).alias("issues"), F.max(rank).alias("_worst"))
    worst = F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("critical")), F.col("_worst") + 1)
    return g.withColumn("worst_severity", worst).orderBy(F.desc("_worst"), "node_id").drop("_worst")


def network_report(nodes: DataFrame, samples: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """Current rates per node; offline nodes and nodes with a single sample show none."""
    rows = nodes.withColumn("online", online("last_seen", as_of, minutes)).join(
        latest_network_rates(samples).select("node_id", "rx_mbps", "tx_mbps"), "node_id", "left")
    up = F.col("online")
    return rows.select("node_id", "hostname", "online", F.when(up, F.col("rx_mbps")).alias("rx_mbps"),
                       F.when(up, F.col("tx_mbps")).alias("tx_mbps"))


def inventory_list(nodes: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    return nodes.select("node_id", "hostname", "os", "arch", "agent_version", "last_seen",
                        online("last_seen", as_of, minutes).alias("online")).orderBy(F.desc_nulls_last("last_seen"), "node_id")


def logs_report(logs: DataFrame, nodes: DataFrame, errors: bool = False, per_node: int = 5) -> DataFrame:
    """Newest entries per node with the message cut to 120 characters."""
    if errors:
        logs = logs.filter(F.col("level") == "error")
    w = Window.partitionBy("node_id").orderBy(F.desc("ts"), F.desc("log_id"))
    top = logs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_node)
    return top.join(nodes.select("node_id", "hostname"), "node_id").select(
        "node_id", "hostname", "rn", "ts", "level", "source", F.left("message", F.lit(120)).alias("message"))


def maintenance_report(windows: DataFrame, nodes: DataFrame, as_of: Column) -> DataFrame:
    return active_maintenance(windows, as_of).join(nodes.select("node_id", "hostname"), "node_id").select(
        "node_id", "hostname", F.coalesce("reason", F.lit("(no reason)")).alias("reason"), "started_at", "ends_at",
        until_relative("ends_at", as_of).alias("until"))


def cluster_counts(nodes: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    up = online("last_seen", as_of, minutes)
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(up).alias("online"), F.count_if(~up).alias("offline"))


def dashboard(state: DataFrame, samples: DataFrame, pins: DataFrame) -> DataFrame:
    """One row per node for the dashboard, pinned nodes first, then oldest contact."""
    rates = latest_network_rates(samples, clamp=1000.0).select("node_id", "rx_mbps", "tx_mbps")
    rows = state.join(rates, "node_id", "left").select(
        "node_id", "hostname", "online", "last_seen", "cpu_percent", "memory_percent", "disk_percent", "uptime_seconds",
        "load_1m", "memory_total_gb", "disk_total_gb", "containers_total", "containers_running", "gpu_count",
        F.col("rx_mbps").alias("net_rx_mbps"), F.col("tx_mbps").alias("net_tx_mbps"), "alert_count", "critical_count")
    return pinned_first(rows, pins, F.col("last_seen").asc_nulls_first(), F.col("node_id"))
