"""Samples, snapshots, series and summaries."""

from pyspark.sql import functions as F

from ..functions.scalars import bytes_to_gb, format_uptime, metric_band, round_to
from ..operators import aggregates as A
from ..operators import latest, series, silver
from ..operators.selection import window_since
from ..plans.digest import build_node_digests, fleet_digest, fleet_concerns
from ..plans.exports import gauges, gauge_lines, system_csv, export_documents
from ..sources import landing
from ..sources import testbed as T
from .base import AS_OF, query


def metrics_rows(spark, d):
    return T._base(spark, d).select("node_id", "ts", "sample_id", F.col("event_type").alias("metric_type"),
                                    F.least("value", F.lit(100.0)).alias("pct"))


@query("latest_per_type", """SELECT node_id, event_type AS metric_type, ts, sample_id, least(value, 100) AS pct FROM e
    QUALIFY row_number() OVER (PARTITION BY node_id, event_type ORDER BY ts DESC, sample_id DESC) = 1""")
def _(spark, d):
    return latest.latest_per_type(metrics_rows(spark, d))


@query("recent_samples", """SELECT node_id, ts, sample_id, cpu_percent,
    row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, sample_id DESC) AS rn FROM s QUALIFY rn <= 2""")
def _(spark, d):
    return latest.recent_samples(T.system_samples(spark, d).select("node_id", "ts", "sample_id", "cpu_percent"), 2)


@query("metrics_summary", "SELECT * FROM ms")
def _(spark, d):
    return A.metrics_summary(T.system_samples(spark, d), T.alerts(spark, d), T.as_of(), 168)


@query("node_stats", """SELECT reg.node_id, coalesce(m, 0) AS metric_count, coalesce(alert_count, 0) AS active_alerts FROM reg
    LEFT JOIN (SELECT node_id, count(*) AS m FROM e GROUP BY 1) USING (node_id) LEFT JOIN ac USING (node_id)""")
def _(spark, d):
    return A.node_stats(T.registrations(spark, d), metrics_rows(spark, d), T.alerts(spark, d))


@query("metrics_history", f"""SELECT node_id, ts, sample_id, event_type AS metric_type, least(value, 100) AS pct FROM e
    WHERE ts > {AS_OF} - INTERVAL 168 HOUR""")
def _(spark, d):
    return series.metrics_history(metrics_rows(spark, d), 168, T.as_of())


GAP = 43_200  # half a day: the test events are that far apart
_US = f"epoch_us({AS_OF})"


@query("uptime_segments", f"""
    WITH w AS (SELECT s.node_id, ts, lag(ts) OVER (PARTITION BY s.node_id ORDER BY ts) AS p FROM s JOIN reg USING (node_id)
        WHERE ts > {AS_OF} - INTERVAL 336 HOUR AND ts <= {AS_OF}),
    f AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > {GAP}000000 THEN 1 ELSE 0 END)
        OVER (PARTITION BY node_id ORDER BY ts) AS g FROM w),
    g AS (SELECT node_id, g, min(ts) AS lo, max(ts) AS hi FROM f GROUP BY 1, 2),
    h AS (SELECT *, lag(hi) OVER (PARTITION BY node_id ORDER BY g) AS b, lead(lo) OVER (PARTITION BY node_id ORDER BY g) AS a FROM g)
    SELECT node_id, b AS start, lo AS "end", 'offline' AS status FROM h WHERE b IS NOT NULL UNION ALL
    SELECT node_id, {AS_OF} - INTERVAL 336 HOUR, lo, 'offline' FROM h
        WHERE b IS NULL AND epoch_us(lo) - epoch_us({AS_OF} - INTERVAL 336 HOUR) > {GAP}000000 UNION ALL
    SELECT node_id, lo, CASE WHEN a IS NULL AND {_US} - epoch_us(hi) <= {GAP}000000 THEN {AS_OF} ELSE hi END, 'online' FROM h UNION ALL
    SELECT node_id, hi, {AS_OF}, 'offline' FROM h WHERE a IS NULL AND {_US} - epoch_us(hi) > {GAP}000000 UNION ALL
    SELECT node_id, {AS_OF} - INTERVAL 336 HOUR, {AS_OF}, 'offline' FROM reg WHERE node_id NOT IN (SELECT node_id FROM w)""")
def _(spark, d):
    return series.uptime_segments(T.system_samples(spark, d), T.registrations(spark, d), T.as_of(), 336, GAP)


@query("sparkline", f"""
    WITH v AS (SELECT node_id, ts, floor(cpu_percent * 10 + 0.5) / 10 AS value,
        row_number() OVER (PARTITION BY node_id ORDER BY ts, sample_id) - 1 AS pos, count(*) OVER (PARTITION BY node_id) AS n
        FROM s WHERE ts > {AS_OF} - INTERVAL 720 HOUR),
    p AS (SELECT DISTINCT node_id, CAST(floor(i * (n / 30)) AS BIGINT) AS pos FROM v, (SELECT unnest(range(30)) AS i) WHERE n > 30)
    SELECT node_id, ts, value FROM v WHERE n <= 30 UNION ALL SELECT node_id, ts, value FROM v JOIN p USING (node_id, pos)""")
def _(spark, d):
    return series.sparkline(T.system_samples(spark, d), "cpu_percent", T.as_of(), 720, 30)


RATES = """r1 AS (SELECT *, lag(ts) OVER w AS pts, lag(r0) OVER w AS pr0, lag(t0) OVER w AS pt0, lag(r1) OVER w AS pr1, lag(t1) OVER w AS pt1
        FROM s WINDOW w AS (PARTITION BY node_id ORDER BY ts, sample_id)),
    r2 AS (SELECT *, (epoch_us(ts) - epoch_us(pts)) / 1000000.0::DOUBLE AS dt,
        CASE WHEN pts IS NULL THEN 0 ELSE greatest(0, r0 - pr0) + CASE WHEN r1 IS NULL THEN 0 ELSE greatest(0, r1 - coalesce(pr1, 0)) END END AS rb,
        CASE WHEN pts IS NULL THEN 0 ELSE greatest(0, t0 - pt0) + CASE WHEN t1 IS NULL THEN 0 ELSE greatest(0, t1 - coalesce(pt1, 0)) END END AS tb FROM r1),
    r3 AS (SELECT node_id, ts, sample_id, CASE WHEN dt > 0 THEN floor(rb * 8 / dt / 1000000.0::DOUBLE * 100 + 0.5) / 100 ELSE 0.0 END AS rx_mbps,
        CASE WHEN dt > 0 THEN floor(tb * 8 / dt / 1000000.0::DOUBLE * 100 + 0.5) / 100 ELSE 0.0 END AS tx_mbps FROM r2)"""


@query("network_rates", f"WITH {RATES} SELECT node_id, ts, sample_id, least(rx_mbps, 1000) AS rx_mbps, least(tx_mbps, 1000) AS tx_mbps FROM r3")
def _(spark, d):
    return series.network_rates(T.system_samples(spark, d))


SPIKES = """c AS (SELECT *, count(*) FILTER ({c} > 0) OVER (PARTITION BY node_id) AS n,
        row_number() OVER (PARTITION BY node_id ORDER BY CASE WHEN {c} > 0 THEN 0 ELSE 1 END, {c}) AS rk FROM x),
    m AS (SELECT node_id, {c} AS med FROM c WHERE n >= 3 AND rk = n // 2 + 1)"""


@query("spike_filter", f"""WITH x AS (SELECT node_id, ts, sample_id, value AS v FROM e), {SPIKES.format(c='v')}
    SELECT x.node_id, ts, sample_id, CASE WHEN v > greatest(med * 10, 100) THEN 0.0 ELSE v END AS v FROM x LEFT JOIN m USING (node_id)""")
def _(spark, d):
    rows = T._base(spark, d).select("node_id", "ts", "sample_id", F.col("value").alias("v"))
    return series.spike_filter(rows, ("v",))


@query("history_series", f"""
    WITH {RATES.replace('FROM s WINDOW', f"FROM (SELECT * FROM s WHERE ts > {AS_OF} - INTERVAL 336 HOUR) WINDOW")},
    x AS (SELECT node_id, ts, sample_id, least(rx_mbps, 1000) AS rx, least(tx_mbps, 1000) AS tx FROM r3),
    {SPIKES.format(c='rx')}, {SPIKES.format(c='tx').replace('c AS', 'c2 AS').replace('m AS', 'm2 AS').replace('FROM c WHERE', 'FROM c2 WHERE').replace('med', 'med2')}
    SELECT s.node_id, s.ts, cpu_percent AS cpu, memory_percent AS memory, disk_percent AS disk, load1 AS load,
        CASE WHEN rx > greatest(med * 10, 100) THEN 0.0 ELSE rx END AS net_rx, CASE WHEN tx > greatest(med2 * 10, 100) THEN 0.0 ELSE tx END AS net_tx
    FROM s JOIN x USING (node_id, ts, sample_id) LEFT JOIN m ON m.node_id = s.node_id LEFT JOIN m2 ON m2.node_id = s.node_id""")
def _(spark, d):
    return series.history_series(T.system_samples(spark, d), T.as_of(), 336)


@query("gpu_history", f"""SELECT node_id, ts, utilization_percent AS gpu_utilization, memory_used_percent AS gpu_memory,
    temperature_celsius AS gpu_temperature FROM gp WHERE pos = 0 AND ts > {AS_OF} - INTERVAL 168 HOUR""")
def _(spark, d):
    return series.gpu_history(T.gpu_samples(spark, d), T.as_of(), 168)


@query("disk_growth", """SELECT node_id, floor((disk_max - disk_min) * 100 + 0.5) / 100 AS growth,
    floor((100 - disk_current) / ((disk_max - disk_min) / 7.0::DOUBLE) + 0.5) AS days_to_full FROM ms WHERE disk_avg > 0 AND disk_max - disk_min > 5""")
def _(spark, d):
    return series.disk_growth(A.metrics_summary(T.system_samples(spark, d), T.alerts(spark, d), T.as_of(), 168))


@query("range_anomalies", f"""
    SELECT node_id, CASE WHEN cm > 80 THEN floor(cm * 10 + 0.5) / 10 END AS cpu_peak, CASE WHEN cm > 80 THEN floor(ca * 10 + 0.5) / 10 END AS cpu_avg,
        CASE WHEN mm > 85 THEN floor(mm * 10 + 0.5) / 10 END AS memory_peak, CASE WHEN mm > 85 THEN floor(ma * 10 + 0.5) / 10 END AS memory_avg
    FROM (SELECT node_id, max(cpu_percent) AS cm, avg(cpu_percent) AS ca, max(memory_percent) AS mm, avg(memory_percent) AS ma FROM s
        WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' GROUP BY 1) WHERE cm > 80 OR mm > 85""")
def _(spark, d):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return A.range_anomalies(T.system_samples(spark, d), t("2024-01-10"), t("2024-01-20"))


# ---- nested payloads -----------------------------------------------------------------------------

def landed(spark, d):
    """Bronze rows landed from raw JSON lines; the event id is not part of a payload, time is unique."""
    return landing.land_payloads(T.payload_lines(spark, d), T.as_of().cast("timestamp"))


@query("land_payloads", """SELECT node_id, ts, unnest(['system'] || CASE event_type WHEN 'click' THEN ['docker'] WHEN 'signup' THEN ['services'] WHEN 'view' THEN ['gpu']
    WHEN 'purchase' THEN ['smart', 'zfs'] ELSE [] END) AS metric_type FROM e""")
def _(spark, d):
    return landed(spark, d).select("node_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "metric_type")


@query("silver_system", """SELECT node_id, ts, cpu_percent, cpu_count, memory_percent, memory_total_bytes, disk_percent,
    CASE WHEN sample_id % 4 < 3 THEN load1 END AS load1, CASE WHEN sample_id % 4 < 2 THEN load15 END AS load15,
    uptime_seconds, CASE WHEN k % 3 = 0 THEN 3 ELSE 2 END AS interfaces, '/data' AS second_mount, 'package' AS sensor FROM s""")
def _(spark, d):
    s = silver.system_samples(landed(spark, d))
    return s.select("node_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "cpu_percent", "cpu_count", "memory_percent",
                    "memory_total_bytes", "disk_percent", "load1", "load15", "uptime_seconds",
                    F.size("network").alias("interfaces"), F.col("disks")[1]["mountpoint"].alias("second_mount"),
                    F.col("temperatures")[0]["label"].alias("sensor"))


@query("silver_containers", """SELECT node_id, ts, pos, name, state, restart_count, cpu_percent, memory_usage_bytes FROM ct""")
def _(spark, d):
    rows = silver.explode_items(silver.docker_samples(landed(spark, d)), "containers")
    return rows.select("node_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "pos", "name", "state", "restart_count",
                       "cpu_percent", "memory_usage_bytes")


@query("silver_services", "SELECT node_id, ts, name, healthy FROM sv")
def _(spark, d):
    rows = silver.explode_items(silver.service_samples(landed(spark, d)), "services")
    return rows.select("node_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "name", "healthy")


@query("silver_smart", "SELECT node_id, ts, device, model, healthy, temperature_c, power_on_hours, reallocated_sector_ct, error FROM sm")
def _(spark, d):
    rows = silver.explode_items(silver.smart_samples(landed(spark, d)), "devices")
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).drop("pos")


@query("system_summary", """SELECT node_id, ts, sample_id, cpu_percent, memory_percent, disk_percent, uptime_seconds, load1 AS load_1m, cpu_count,
    memory_total_bytes, floor(memory_total_bytes / 1073741824.0::DOUBLE * 10 + 0.5) / 10 AS memory_total_gb, CAST(u + 100 AS DOUBLE) AS disk_total_gb,
    r0 + coalesce(r1, 0) + lo AS net_rx_bytes, t0 + coalesce(t1, 0) + lo AS net_tx_bytes FROM s""")
def _(spark, d):
    return silver.system_summary(T.system_samples(spark, d))


@query("worst_disk", """SELECT node_id, ts, CASE WHEN disk_percent = 0 AND d1 = 0 THEN '' WHEN disk_percent >= d1 THEN '/' ELSE '/data' END AS mount,
    greatest(disk_percent, d1) AS used_percent FROM s""")
def _(spark, d):
    w = silver.worst_disk("disks")
    return T.system_samples(spark, d).select("node_id", "ts", F.coalesce(w["label"], F.lit("")).alias("mount"), w["used_percent"].alias("used_percent"))


@query("network_interfaces", """SELECT node_id, interface, count(*) AS samples, CAST(sum(bytes_recv) AS BIGINT) AS bytes_recv FROM (
    SELECT node_id, 'eth0' AS interface, r0 AS bytes_recv FROM s UNION ALL SELECT node_id, 'eth1', r1 FROM s WHERE r1 IS NOT NULL
    UNION ALL SELECT node_id, 'lo', lo FROM s) GROUP BY 1, 2""")
def _(spark, d):
    rows = silver.explode_items(T.system_samples(spark, d).select("node_id", "network"), "network")
    return rows.groupBy("node_id", "interface").agg(F.count("*").alias("samples"), F.sum("bytes_recv").alias("bytes_recv"))


@query("container_counts", """SELECT node_id, ts, count(*) AS containers_total, count(*) FILTER (state = 'running') AS containers_running
    FROM ct GROUP BY 1, 2, sample_id""")
def _(spark, d):
    return silver.container_counts(T.docker_samples(spark, d)).drop("sample_id")


@query("gpu_devices", """SELECT node_id, ts, name, CAST(count(*) OVER (PARTITION BY node_id, ts, sample_id) AS INT) AS gpu_count,
    memory_total_bytes / 1073741824.0::DOUBLE AS vram_total_gb, memory_used_bytes / 1073741824.0::DOUBLE AS vram_used_gb,
    memory_free_bytes / 1073741824.0::DOUBLE AS vram_free_gb, temperature_celsius, power_watts FROM gp""")
def _(spark, d):
    return silver.gpu_devices(silver.gpu_samples(landed(spark, d))).select(
        "node_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "name", "gpu_count", "vram_total_gb", "vram_used_gb", "vram_free_gb", "temperature_celsius", "power_watts")


@query("zfs_pools", "SELECT node_id, ts, name, used_percent, pool_healthy FROM zf")
def _(spark, d):
    return silver.zfs_pools(silver.zfs_samples(landed(spark, d))).select("node_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "name", "used_percent", "pool_healthy")


@query("temperatures", """SELECT node_id, 'package' AS label, temp AS value, 'system' AS source FROM sl UNION ALL
    SELECT node_id, name, temperature_celsius, 'gpu' FROM gpl WHERE temperature_celsius > 0""")
def _(spark, d):
    return silver.temperatures(T.newest(spark, d, "system"), T.newest(spark, d, "gpu"))


@query("cpu_total", "SELECT node_id, ts, (cpu_percent + memory_percent + disk_percent) / 3 AS cpu_total FROM s")
def _(spark, d):
    return T.system_samples(spark, d).select(
        "node_id", "ts", silver.cpu_total(F.array("cpu_percent", "memory_percent", "disk_percent")).alias("cpu_total"))


@query("top_processes", """SELECT 's' || l_suppkey AS node_id, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS pid,
    row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS rank
    FROM lineitem QUALIFY rank <= 2""")
def _(spark, d):
    return silver.top_processes(T.processes(spark, d), 2).select("node_id", "ts", "pid", "rank")


CONTAINER = """c AS (SELECT 's' || l_suppkey AS node_id, 'p' || l_partkey AS container, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS sample_id,
    CAST(floor(l_extendedprice * 100) AS BIGINT) AS tu, l_orderkey * 1000 + l_linenumber AS su,
    coalesce(nullif(l_linenumber % 3, 0), nullif(l_linenumber % 2, 0), 4) AS cpus FROM lineitem)"""


@query("container_cpu", f"""WITH {CONTAINER}, p AS (SELECT *, lag(tu) OVER w AS ptu, lag(su) OVER w AS psu FROM c
        WINDOW w AS (PARTITION BY node_id, container ORDER BY ts, sample_id)),
    q AS (SELECT *, CASE WHEN tu >= ptu THEN CAST(tu - ptu AS DOUBLE) ELSE 0.0::DOUBLE END AS du, CASE WHEN su >= psu THEN CAST(su - psu AS DOUBLE) ELSE 0.0::DOUBLE END AS ds FROM p)
    SELECT node_id, container, ts, sample_id, CASE WHEN ds > 0 AND du > 0 THEN du / ds * cpus * 100 ELSE 0.0::DOUBLE END AS cpu_percent FROM q""")
def _(spark, d):
    return silver.container_cpu_percent(T.container_counters(spark, d)).select("node_id", "container", "ts", "sample_id", "cpu_percent")


@query("container_memory", """WITH c AS (SELECT 's' || l_suppkey AS node_id, 'p' || l_partkey AS container, l_orderkey * 10 + l_linenumber AS sample_id,
    CAST(floor(l_extendedprice) AS BIGINT) AS mu, CAST(CASE WHEN l_returnflag = 'A' THEN floor(l_extendedprice / 2) ELSE floor(l_extendedprice * l_quantity / 20) END AS BIGINT) AS ca FROM lineitem)
    SELECT node_id, container, sample_id, CASE WHEN ca <= mu THEN mu - ca ELSE mu END AS memory_used,
    CASE WHEN ca <= mu THEN mu - ca ELSE mu END / 1000000 * 100 AS memory_percent FROM c""")
def _(spark, d):
    return silver.container_memory(T.container_counters(spark, d)).select("node_id", "container", "sample_id", "memory_used", "memory_percent")


@query("probe_health", """SELECT event_id, CASE event_type WHEN 'click' THEN coalesce(value <= 100 AND code BETWEEN 200 AND 399, false)
    WHEN 'view' THEN value <= 100 ELSE false END AS healthy, CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN value > 100 THEN 'refused' END
    ELSE 'unknown check type: ' || event_type END AS error FROM (SELECT *, 150 + CAST(regexp_extract(props, '[0-9]+') AS INT) * 4 AS code FROM events)""")
def _(spark, d):
    b = T._base(spark, d)
    kind = F.when(F.col("event_type") == "click", "http").when(F.col("event_type") == "view", "tcp").otherwise(F.col("event_type"))
    probes = b.select(F.col("sample_id").alias("event_id"), kind.alias("type"), (F.col("k") * 4 + 150).alias("status_code"),
                      F.when(F.col("value") > 100, "refused").alias("error"))
    return silver.probe_health(probes).select("event_id", "healthy", "error")


# ---- registry, digests, exports ------------------------------------------------------------------

@query("node_registry", """SELECT reg.node_id, hostname, os, registered_at, last_seen FROM reg LEFT JOIN (
    SELECT node_id, max(t) AS last_seen FROM (SELECT node_id, ts AS t FROM e UNION ALL SELECT node_id, ts FROM l) GROUP BY 1) USING (node_id)""")
def _(spark, d):
    logs = landing.normalise_logs(T.raw_logs(spark, d))
    reg = landing.node_registry(T.registrations(spark, d), T.system_samples(spark, d), logs)
    return reg.select("node_id", "hostname", "os", "registered_at", "last_seen")


DIGEST = """
    dg AS (SELECT reg.node_id, hostname, ms.* EXCLUDE (node_id), greatest(alerts_total - alerts_resolved, 0) AS active, disk_max - disk_min AS growth FROM reg LEFT JOIN ms USING (node_id)),
    dc AS (SELECT *, list_filter([CASE WHEN cpu_avg > 0 AND cpu_max > 90 THEN 'cpu_peak' END,
        CASE WHEN memory_avg > 85 THEN 'memory_high' WHEN memory_avg > 70 THEN 'memory_warm' END,
        CASE WHEN disk_avg > 0 AND growth > 5 THEN 'disk_growth' END,
        CASE WHEN disk_avg > 0 AND disk_current > 90 THEN 'disk_critical' WHEN disk_avg > 0 AND disk_current > 80 THEN 'disk_warning' END,
        CASE WHEN load_avg > 10 THEN 'load_high' END], lambda x: x IS NOT NULL) AS cs,
        list_filter([CASE WHEN cpu_avg > 0 AND cpu_avg < 5 THEN 'cpu_idle' END, CASE WHEN alerts_total = 0 THEN 'no_alerts' END], lambda x: x IS NOT NULL) AS hs FROM dg),
    dd AS (SELECT node_id, hostname, coalesce(sample_count, 0) AS sample_count,
        CASE WHEN sample_count IS NULL THEN '?' WHEN len(cs) >= 3 THEN 'C' WHEN len(cs) = 2 THEN 'B-' WHEN len(cs) = 1 THEN 'B+' ELSE 'A' END AS grade,
        CASE WHEN sample_count IS NULL THEN NULL WHEN cpu_avg < 5 AND memory_avg < 40 AND load_avg < 5 AND active = 0 THEN 'quiet'
            WHEN load_avg > 20 AND cpu_avg < 20 THEN 'io_pressure' WHEN cpu_avg > 70 THEN 'hard_working' WHEN active > 2 THEN 'needs_attention'
            WHEN disk_current > 80 THEN 'tight_storage' ELSE 'steady' END AS opener,
        CASE WHEN cpu_avg > 0 THEN CASE WHEN cpu_avg < 10 THEN 'idle' WHEN cpu_avg < 50 THEN 'moderate' WHEN cpu_avg < 80 THEN 'heavy' ELSE 'critical' END END AS cpu_band,
        CASE WHEN memory_avg > 0 THEN CASE WHEN abs(memory_max - memory_min) < 5 THEN 'stable' WHEN abs(memory_max - memory_min) < 20 THEN 'fluctuating' ELSE 'volatile' END END AS memory_band,
        CASE WHEN disk_avg > 0 AND growth > 5 THEN floor((100 - disk_current) / (growth / 7.0::DOUBLE) + 0.5) END AS days_to_full,
        CASE WHEN sample_count IS NULL THEN 0 ELSE len(cs) END AS concern_count,
        CASE WHEN sample_count IS NULL THEN '' ELSE array_to_string(cs, ',') END AS concerns,
        CASE WHEN sample_count IS NULL THEN '' ELSE array_to_string(hs, ',') END AS highlights FROM dc)"""


def digests(spark, d):
    return build_node_digests(T.system_samples(spark, d), T.alerts(spark, d), T.registrations(spark, d), T.as_of(), 168)


@query("node_digest", f"WITH {DIGEST} SELECT * FROM dd")
def _(spark, d):
    return digests(spark, d)


@query("fleet_digest", f"""WITH {DIGEST} SELECT count(*) AS nodes, count(*) FILTER (grade IN ('A', 'B+')) AS healthy, count(*) FILTER (grade = 'B-') AS fair,
    count(*) FILTER (grade IN ('C', 'D', 'F')) AS poor, CAST(sum(concern_count) AS BIGINT) AS concerns FROM dd""")
def _(spark, d):
    return fleet_digest(digests(spark, d))


@query("fleet_concerns", f"WITH {DIGEST} SELECT node_id, hostname, unnest(string_split(concerns, ',')) AS concern FROM dd WHERE concern_count > 0")
def _(spark, d):
    return fleet_concerns(digests(spark, d))


@query("latest_digest", """SELECT DISTINCT node_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS created_at, floor(avg(cpu_percent) OVER (PARTITION BY node_id, date_trunc('day', ts)) * 100 + 0.5) / 100 AS cpu_avg
    FROM s QUALIFY rank() OVER (PARTITION BY node_id ORDER BY date_trunc('day', ts) DESC) = 1""")
def _(spark, d):
    daily = T.system_samples(spark, d).groupBy("node_id", F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("created_at")).agg(
        round_to(F.avg("cpu_percent"), 2).alias("cpu_avg"))
    return latest.latest_digest(daily)


@query("export_csv", f"""SELECT ts AS timestamp, hostname, floor(cpu_percent * 100 + 0.5) / 100 AS cpu_percent, floor(memory_percent * 100 + 0.5) / 100 AS memory_percent,
    memory_used_bytes, floor(disk_percent * 100 + 0.5) / 100 AS disk_percent, load1 AS load_1m, load5 AS load_5m, load15 AS load_15m, uptime_seconds
    FROM s JOIN reg USING (node_id) WHERE ts > {AS_OF} - INTERVAL 168 HOUR""")
def _(spark, d):
    return system_csv(T.system_samples(spark, d), T.registrations(spark, d), T.as_of(), 168)


@query("export_json", f"""SELECT node_id, 'node' AS part, 1 AS lines FROM reg UNION ALL
    SELECT node_id, 'metric', count(*) FROM e JOIN reg USING (node_id) WHERE ts > {AS_OF} - INTERVAL 168 HOUR GROUP BY 1 UNION ALL
    SELECT node_id, 'alert', count(*) FROM al JOIN reg USING (node_id) GROUP BY 1""")
def _(spark, d):
    docs = export_documents(T.registrations(spark, d), metrics_rows(spark, d), T.alerts(spark, d), T.as_of(), 168)
    return docs.groupBy("node_id", "part").agg(F.count("value").alias("lines"))


def _gauges(spark, d):
    return gauges(T.nodes(spark, d), T.newest(spark, d, "system"), T.newest(spark, d, "docker"), T.newest(spark, d, "gpu"),
                  T.newest(spark, d, "smart"), T.newest(spark, d, "zfs"), T.alerts(spark, d), T.as_of(), T.ONLINE_MINUTES)


GAUGES = """g AS (
    SELECT node_id, hostname, '' AS item, unnest(['node_online', 'cpu_percent', 'memory_percent', 'disk_percent', 'uptime_seconds', 'containers_total', 'containers_running', 'alerts_active']) AS metric,
        unnest([CAST(online AS INT)::DOUBLE, cpu_percent, memory_percent, disk_percent, uptime_seconds::DOUBLE, containers_total::DOUBLE, containers_running::DOUBLE, alert_count::DOUBLE]) AS value FROM st UNION ALL
    SELECT node_id, hostname, index::VARCHAR, unnest(['gpu_utilization_percent', 'gpu_temperature_celsius']), unnest([utilization_percent, temperature_celsius]) FROM gpl JOIN reg USING (node_id) UNION ALL
    SELECT node_id, hostname, device, unnest(['smart_healthy', 'smart_temperature_celsius']), unnest([CAST(coalesce(healthy, true) AS INT)::DOUBLE, temperature_c]) FROM sml JOIN reg USING (node_id) UNION ALL
    SELECT node_id, hostname, name, unnest(['zfs_pool_used_percent', 'zfs_pool_healthy']), unnest([floor(used_percent * 10 + 0.5) / 10, CAST(pool_healthy AS INT)::DOUBLE]) FROM zfl JOIN reg USING (node_id))"""


@query("gauge_export", f"WITH {GAUGES} SELECT * FROM g")
def _(spark, d):
    lab = F.col("labels")
    item = F.coalesce(lab["gpu"], lab["device"], lab["pool"], F.lit(""))
    return _gauges(spark, d).select(lab["node_id"].alias("node_id"), lab["hostname"].alias("hostname"), item.alias("item"), "metric", "value")


@query("gauge_lines", f"""WITH {GAUGES} SELECT 'fleet_' || metric || '{{node_id="' || node_id || '",hostname="' || hostname || '"' ||
    CASE WHEN metric LIKE 'gpu%' THEN ',gpu="' || item || '"' WHEN metric LIKE 'smart%' THEN ',device="' || item || '"' WHEN metric LIKE 'zfs%' THEN ',pool="' || item || '"' ELSE '' END
    || '}} ' || value AS value FROM g""")
def _(spark, d):
    return gauge_lines(_gauges(spark, d))


@query("scalar_formats", """SELECT sample_id, CASE WHEN uptime_seconds <= 0 THEN 'unknown' WHEN uptime_seconds >= 86400 THEN (uptime_seconds // 86400) || 'd ' || (uptime_seconds % 86400 // 3600) || 'h'
    WHEN uptime_seconds >= 3600 THEN (uptime_seconds // 3600) || 'h ' || (uptime_seconds % 3600 // 60) || 'm' ELSE (uptime_seconds // 60) || 'm' END AS uptime,
    CASE WHEN cpu_percent >= 90 THEN 'critical' WHEN cpu_percent >= 80 THEN 'high' WHEN cpu_percent >= 60 THEN 'moderate' ELSE 'healthy' END AS band,
    CASE WHEN temp >= 90 THEN 'critical' WHEN temp >= 80 THEN 'concerning' ELSE 'normal' END AS temp_band, memory_used_bytes / 1073741824.0::DOUBLE AS used_gb FROM s""")
def _(spark, d):
    from ..functions.scalars import temp_band
    return T.system_samples(spark, d).select(
        "sample_id", format_uptime("uptime_seconds").alias("uptime"), metric_band("cpu_percent").alias("band"),
        temp_band(F.col("temperatures")[0]["value"]).alias("temp_band"), bytes_to_gb("memory_used_bytes").alias("used_gb"))


@query("window_since", f"SELECT count(*) AS rows, count(DISTINCT node_id) AS nodes FROM e WHERE ts > {AS_OF} - INTERVAL 48 HOUR")
def _(spark, d):
    per_node = window_since(metrics_rows(spark, d), 48, T.as_of()).groupBy("node_id").agg(F.count("*").alias("c"))
    return per_node.agg(F.sum("c").alias("rows"), F.count("*").alias("nodes"))
