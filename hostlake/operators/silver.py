"""Typed tables from the semi-structured payload column, and small derived measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_col, bytes_to_gb, round_to
from .ordered import with_neighbours

# Payload arrays; alternative names of the same field stand side by side and are coalesced below.
DISKS = ("ARRAY<STRUCT<mountpoint STRING, mount_point STRING, path STRING, mount STRING, device STRING, "
         "used_percent DOUBLE, total_bytes BIGINT, free_bytes BIGINT>>")
NETWORK = "ARRAY<STRUCT<interface STRING, bytes_recv BIGINT, bytes_sent BIGINT>>"
TEMPERATURES = ("ARRAY<STRUCT<label STRING, name STRING, sensor_key STRING, "
                "current DOUBLE, temperature_celsius DOUBLE>>")
CONTAINERS = ("ARRAY<STRUCT<id STRING, name STRING, image STRING, state STRING, status STRING, restart_count INT, "
              "cpu_percent DOUBLE, cpu_usage DOUBLE, memory_usage_bytes BIGINT, memory_usage BIGINT, "
              "memory_limit_bytes BIGINT>>")
SERVICES = "ARRAY<STRUCT<name STRING, type STRING, endpoint STRING, healthy BOOLEAN, status_code INT, error STRING>>"
GPUS = ("ARRAY<STRUCT<index INT, name STRING, utilization_percent DOUBLE, "
        "memory STRUCT<total_bytes BIGINT, used_bytes BIGINT, free_bytes BIGINT, used_percent DOUBLE>, "
        "temperature_celsius DOUBLE, power_watts DOUBLE, power_limit_watts DOUBLE, fan_speed_percent DOUBLE>>")
SMART = ("ARRAY<STRUCT<device STRING, model STRING, type STRING, healthy BOOLEAN, temperature_c DOUBLE, "
         "power_on_hours BIGINT, reallocated_sector_ct BIGINT, error STRING>>")
POOLS = "ARRAY<STRUCT<name STRING, health STRING, used_percent DOUBLE>>"

KEYS = ("node_id", "ts", "sample_id")


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("data", path, kind)


def _of(metrics: DataFrame, kind: str) -> tuple[DataFrame, list[str]]:
    """Rows of a collector and the columns to keep. Rows without a metric_type are of that collector and keep all their columns."""
    if "metric_type" not in metrics.columns:
        return metrics, [c for c in metrics.columns if c != "data"]
    return metrics.filter(F.col("metric_type") == kind), [c for c in KEYS if c in metrics.columns]


def load_1m() -> Column:
    """The one-minute load, whether sent as an object, as an array or as a bare number."""
    return F.coalesce(
        _get("$.load_average.load1", "double"), _get("$.load_average[0]", "double"), _get("$.load_average", "double"))


def system_samples(metrics: DataFrame) -> DataFrame:
    rows, keys = _of(metrics, "system")
    rows = rows.select(
        *keys,
        _get("$.hostname", "string").alias("hostname"),
        _get("$.cpu.total_percent", "double").alias("cpu_percent"),
        _get("$.cpu.count", "int").alias("cpu_count"),
        _get("$.memory.used_percent", "double").alias("memory_percent"),
        _get("$.memory.total_bytes", "bigint").alias("memory_total_bytes"),
        _get("$.memory.used_bytes", "bigint").alias("memory_used_bytes"),
        F.coalesce(_get("$.disk", DISKS), _get("$.disks", DISKS)).alias("d"),
        load_1m().alias("load1"),
        F.coalesce(_get("$.load_average.load5", "double"), _get("$.load_average[1]", "double")).alias("load5"),
        F.coalesce(_get("$.load_average.load15", "double"), _get("$.load_average[2]", "double")).alias("load15"),
        _get("$.uptime_seconds", "bigint").alias("uptime_seconds"),
        _get("$.network", NETWORK).alias("network"),
        _get("$.temperatures", TEMPERATURES).alias("t"),
    )
    disks = F.transform("d", lambda d: F.struct(
        F.coalesce(d["mountpoint"], d["mount_point"], d["path"], d["mount"]).alias("mountpoint"),
        d["device"].alias("device"), d["used_percent"].alias("used_percent"),
        d["total_bytes"].alias("total_bytes"), d["free_bytes"].alias("free_bytes")))
    temps = F.transform("t", lambda t: F.struct(
        F.coalesce(t["label"], t["name"], t["sensor_key"], F.lit("CPU")).alias("label"),
        F.coalesce(t["current"], t["temperature_celsius"]).alias("value")))
    return rows.withColumns({
        "disks": disks, "disk_percent": F.get("d", F.lit(0))["used_percent"], "temperatures": temps}).drop("d", "t")


def docker_samples(metrics: DataFrame) -> DataFrame:
    rows, keys = _of(metrics, "docker")
    arr = F.transform(_get("$.containers", CONTAINERS), lambda c: F.struct(
        c["id"].alias("id"), F.coalesce(c["name"], F.lit("unknown")).alias("name"), c["image"].alias("image"),
        c["state"].alias("state"), c["status"].alias("status"),
        F.coalesce(c["restart_count"], F.lit(0)).alias("restart_count"),
        F.coalesce(c["cpu_percent"], c["cpu_usage"]).alias("cpu_percent"),
        F.coalesce(c["memory_usage_bytes"], c["memory_usage"]).alias("memory_usage_bytes"),
        c["memory_limit_bytes"].alias("memory_limit_bytes")))
    return rows.select(*keys, F.coalesce(arr, F.expr("array()")).alias("containers"))


def service_samples(metrics: DataFrame) -> DataFrame:
    """The list of checks may be wrapped in an object or bare."""
    rows, keys = _of(metrics, "services")
    checks = F.coalesce(_get("$.services", SERVICES), _get("$", SERVICES))
    arr = F.transform(checks, lambda s: F.struct(
        F.coalesce(s["name"], F.lit("unknown")).alias("name"),
        F.coalesce(s["healthy"], F.lit(True)).alias("healthy")))
    return rows.select(*keys, arr.alias("services"))


def gpu_samples(metrics: DataFrame) -> DataFrame:
    rows, keys = _of(metrics, "gpu")
    arr = F.transform(_get("$.devices", GPUS), lambda g: F.struct(
        g["index"].alias("index"), F.coalesce(g["name"], F.lit("GPU")).alias("name"),
        g["utilization_percent"].alias("utilization_percent"),
        g["memory"]["total_bytes"].alias("memory_total_bytes"), g["memory"]["used_bytes"].alias("memory_used_bytes"),
        g["memory"]["free_bytes"].alias("memory_free_bytes"), g["memory"]["used_percent"].alias("memory_used_percent"),
        g["temperature_celsius"].alias("temperature_celsius"), g["power_watts"].alias("power_watts"),
        g["power_limit_watts"].alias("power_limit_watts"), g["fan_speed_percent"].alias("fan_speed_percent")))
    return rows.select(*keys, _get("$.count", "int").alias("declared_count"), arr.alias("devices"))


def smart_samples(metrics: DataFrame) -> DataFrame:
    rows, keys = _of(metrics, "smart")
    arr = F.transform(_get("$.devices", SMART), lambda d: F.struct(
        F.coalesce(d["device"], F.lit("unknown")).alias("device"),
        F.coalesce(d["model"], d["type"], F.lit("")).alias("model"), d["healthy"].alias("healthy"),
        d["temperature_c"].alias("temperature_c"), d["power_on_hours"].alias("power_on_hours"),
        d["reallocated_sector_ct"].alias("reallocated_sector_ct"), d["error"].alias("error")))
    return rows.select(*keys, arr.alias("devices"))


def zfs_samples(metrics: DataFrame) -> DataFrame:
    rows, keys = _of(metrics, "zfs")
    return rows.select(*keys, _get("$.pools", POOLS).alias("pools"))


# ---- measures of one row -------------------------------------------------------------------------

def system_summary(samples: DataFrame) -> DataFrame:
    """Headline numbers of each sample, missing ones as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = lambda f: F.aggregate(
        F.coalesce("network", F.expr("array()").cast("array<struct<interface:string,bytes_recv:bigint,bytes_sent:bigint>>")),
        F.lit(0).cast("bigint"), lambda a, n: a + F.coalesce(n[f], F.lit(0).cast("bigint")))
    first_size = F.coalesce(F.get("disks", F.lit(0))["total_bytes"], F.lit(0))
    return samples.select(
        *[c for c in KEYS if c in samples.columns],
        zero("cpu_percent").alias("cpu_percent"), zero("memory_percent").alias("memory_percent"),
        zero("disk_percent").alias("disk_percent"), zero("uptime_seconds").alias("uptime_seconds"),
        zero("load1").alias("load_1m"), zero("cpu_count").alias("cpu_count"),
        zero("memory_total_bytes").alias("memory_total_bytes"),
        round_to(bytes_to_gb(zero("memory_total_bytes")), 1).alias("memory_total_gb"),
        round_to(bytes_to_gb(first_size), 1).alias("disk_total_gb"),
        total("bytes_recv").alias("net_rx_bytes"), total("bytes_sent").alias("net_tx_bytes"))


def worst_disk(disks="disks") -> Column:
    """STRUCT(label, used_percent) of the fullest mount above 0; the first one wins a tie."""
    full = F.filter(as_col(disks), lambda d: d["used_percent"] > 0)
    keyed = F.transform(full, lambda d, i: F.struct(
        d["used_percent"].alias("used_percent"), (-i).alias("pos"),
        F.coalesce(d["mountpoint"], d["device"], F.lit("")).alias("label")))
    top = F.array_max(keyed)
    return F.struct(top["label"].alias("label"), F.coalesce(top["used_percent"], F.lit(0.0)).alias("used_percent"))


def explode_items(samples: DataFrame, column: str) -> DataFrame:
    """One row per element of an array of structs, with its position `pos`."""
    keep = [c for c in samples.columns if c != column]
    return samples.select(*keep, F.posexplode(column).alias("pos", "_item")).select(*keep, "pos", "_item.*")


def container_counts(docker: DataFrame) -> DataFrame:
    keep = [c for c in docker.columns if c != "containers"]
    return docker.select(
        *keep, F.size("containers").alias("containers_total"),
        F.size(F.filter("containers", lambda c: c["state"] == "running")).alias("containers_running"))


def gpu_devices(gpu: DataFrame) -> DataFrame:
    """A row per device with video memory in GB and the node's device count."""
    count = F.size("devices")
    if "declared_count" in gpu.columns:
        count = F.coalesce("declared_count", count)
    rows = explode_items(gpu.withColumn("gpu_count", count), "devices")
    return rows.withColumns({
        "vram_total_gb": bytes_to_gb("memory_total_bytes"), "vram_used_gb": bytes_to_gb("memory_used_bytes"),
        "vram_free_gb": bytes_to_gb("memory_free_bytes")})


def temperatures(system: DataFrame, gpu: DataFrame) -> DataFrame:
    """Sensor and GPU readings above 0, tagged with where they come from."""
    a = explode_items(system.select("node_id", "temperatures"), "temperatures").select(
        "node_id", F.col("label"), "value", F.lit("system").alias("source"))
    b = explode_items(gpu.select("node_id", "devices"), "devices").select(
        "node_id", F.coalesce("name", F.lit("GPU")).alias("label"), F.col("temperature_celsius").alias("value"),
        F.lit("gpu").alias("source"))
    return a.unionByName(b).filter("value > 0")


def zfs_pools(zfs: DataFrame) -> DataFrame:
    return explode_items(zfs, "pools").withColumn(
        "pool_healthy", F.coalesce(F.upper("health") == "ONLINE", F.lit(False)))


def cpu_total(per_core) -> Column:
    """Mean of the per-core percentages; 0 without cores."""
    arr = as_col(per_core)
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(arr) > 0, total / F.size(arr)).otherwise(F.lit(0.0))


def top_processes(processes: DataFrame, n: int = 10) -> DataFrame:
    """The n busiest processes of each sample. The rank filter is also applied before the shuffle."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("node_id", "ts").orderBy(F.desc("cpu_percent"), "pid")
    return processes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def container_cpu_percent(counters: DataFrame, slot_seconds: int = 86_400 * 30) -> DataFrame:
    """CPU share since the container's previous reading; 0 when a counter went backwards or for the first."""
    rows = with_neighbours(counters, ["node_id", "container"], "ts", ["total_usage", "system_usage"],
                           tie="sample_id", slot_seconds=slot_seconds)

    def delta(c):
        return F.when(F.col(c) >= F.col(f"prev_{c}"), (F.col(c) - F.col(f"prev_{c}")).cast("double")).otherwise(0.0)

    cpus = F.coalesce(F.nullif(F.col("online_cpus"), F.lit(0)), F.nullif(F.col("percpu_count"), F.lit(0)),
                      F.col("host_cpus"))
    rows = rows.withColumns({"cpu_delta": delta("total_usage"), "system_delta": delta("system_usage")})
    share = F.col("cpu_delta") / F.nullif(F.col("system_delta"), F.lit(0.0)) * cpus * 100.0
    return rows.withColumn(
        "cpu_percent",
        F.when((F.col("system_delta") > 0) & (F.col("cpu_delta") > 0) & (cpus > 0), share).otherwise(0.0)
    ).drop("prev_total_usage", "prev_system_usage", "cpu_delta", "system_delta")


def container_memory(counters: DataFrame) -> DataFrame:
    """Usage without page cache (when the cache is not larger than the usage) and its share of the limit."""
    cache = F.coalesce("cache", "inactive_file", F.lit(0))
    used = F.when(cache <= F.col("memory_usage"), F.col("memory_usage") - cache).otherwise(F.col("memory_usage"))
    return counters.withColumn("memory_used", used).withColumn(
        "memory_percent",
        F.when(F.col("memory_limit") > 0, F.col("memory_used") / F.col("memory_limit") * 100.0).otherwise(0.0))


def probe_health(probes: DataFrame) -> DataFrame:
    """Outcome of probe results: type, status_code, error -> healthy, error."""
    kind, code, err = F.col("type"), F.col("status_code"), F.col("error")
    http_ok = err.isNull() & (code >= 200) & (code < 400)
    return probes.withColumns({
        "healthy": F.coalesce(F.when(kind == "http", http_ok).when(kind == "tcp", err.isNull()).otherwise(False), F.lit(False)),
        "error": F.when(kind.isin("http", "tcp"), err).otherwise(F.concat(F.lit("unknown check type: "), kind)),
    })
