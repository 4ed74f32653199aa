"""Fleet reports over the newest sample per node."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import latest, names, series, silver
from ..plans import reports as R
from ..sources import testbed as T
from .base import AS_OF, query
from .metrics import RATES

def state(spark, d, docker=True, gpu=True, alerts=True):
    return R.fleet_state(
        T.nodes(spark, d), T.newest(spark, d, "system"), T.newest(spark, d, "docker") if docker else None,
        T.newest(spark, d, "gpu") if gpu else None, T.alerts(spark, d) if alerts else None, T.as_of(), T.ONLINE_MINUTES)


UPTIME = """CASE WHEN uptime_seconds <= 0 THEN 'unknown' WHEN uptime_seconds >= 86400 THEN (uptime_seconds // 86400) || 'd ' || (uptime_seconds % 86400 // 3600) || 'h'
    WHEN uptime_seconds >= 3600 THEN (uptime_seconds // 3600) || 'h ' || (uptime_seconds % 3600 // 60) || 'm' ELSE (uptime_seconds // 60) || 'm' END"""
BAND = "CASE WHEN {0} >= 90 THEN 'critical' WHEN {0} >= 80 THEN 'high' WHEN {0} >= 60 THEN 'moderate' ELSE 'healthy' END"


@query("node_status", f"""SELECT st.node_id, hostname, online, cpu_percent, memory_percent, disk_percent, load_1m, {UPTIME} AS uptime, containers_running, containers_total, gpu_count,
    gpu_utilization, gpu_temperature, alert_count, critical_count, latest_alert, CASE WHEN last_seen IS NULL THEN 'never'
    WHEN epoch_us({AS_OF}) - epoch_us(last_seen) < 3600000000 THEN ((epoch_us({AS_OF}) - epoch_us(last_seen)) // 60000000) || ' min ago'
    WHEN epoch_us({AS_OF}) - epoch_us(last_seen) < 86400000000 THEN ((epoch_us({AS_OF}) - epoch_us(last_seen)) // 3600000000) || ' h ago'
    ELSE ((epoch_us({AS_OF}) - epoch_us(last_seen)) // 86400000000) || ' d ago' END AS seen
    FROM st LEFT JOIN (SELECT node_id, arg_max(message, (created_at, alert_id)) AS latest_alert FROM act GROUP BY 1) USING (node_id)""")
def _(spark, d):
    return R.node_status(state(spark, d), T.alerts(spark, d), T.as_of())


for _metric, _col in (("cpu", "cpu_percent"), ("memory", "memory_percent"), ("disk", "disk_percent"), ("load", "load_1m")):
    @query(f"rank_nodes_{_metric}", f"""SELECT rank() OVER (ORDER BY {_col} DESC) AS rank, node_id, hostname, {_col} AS value, online,
        CASE WHEN rank() OVER (ORDER BY {_col} DESC) = 1 AND {_col} > 80 THEN 'hot' END AS note FROM st""")
    def _(spark, d, m=_metric):
        return R.rank_nodes(state(spark, d, docker=False, gpu=False, alerts=False), m)


@query("rank_nodes_idle", """SELECT rank() OVER (ORDER BY cpu_percent) AS rank, node_id, hostname, cpu_percent AS value, online,
    CASE WHEN rank() OVER (ORDER BY cpu_percent) = 1 AND cpu_percent < 10 THEN 'idle' END AS note FROM st""")
def _(spark, d):
    return R.rank_nodes(state(spark, d, docker=False, gpu=False, alerts=False), "cpu", ascending=True)


@query("rank_nodes_gpu", """SELECT rank() OVER (ORDER BY gpu_utilization DESC) AS rank, node_id, hostname, gpu_utilization AS value, online,
    CASE WHEN rank() OVER (ORDER BY gpu_utilization DESC) = 1 AND gpu_utilization > 80 THEN 'hot' END AS note FROM st WHERE gpu_count > 0""")
def _(spark, d):
    return R.rank_nodes(state(spark, d, docker=False, alerts=False), "gpu")


@query("rank_containers", """SELECT node_id, name, CAST(memory_usage_bytes AS DOUBLE) AS value FROM cr ORDER BY memory_usage_bytes DESC, node_id, name LIMIT 10""")
def _(spark, d):
    return R.rank_containers(T.container_rows(spark, d), "memory")


CRL = "crl AS (SELECT cr.* FROM cr JOIN (SELECT node_id, max(ts) AS ts FROM cr GROUP BY 1) USING (node_id, ts))"


@query("restart_leaders", f"WITH {CRL} SELECT node_id, name, restart_count FROM crl WHERE restart_count > 0 ORDER BY restart_count DESC, node_id, name LIMIT 10")
def _(spark, d):
    rows = latest.latest_snapshot(T.container_rows(spark, d))
    return series.restart_leaders(rows).select("node_id", "name", "restart_count")


@query("containers_by_host", """SELECT node_id, count(*) AS total, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state <> 'running') AS stopped FROM cr GROUP BY 1""")
def _(spark, d):
    return A.container_totals(T.container_rows(spark, d))


@query("latest_containers", f"WITH {CRL} SELECT node_id, ts, name, state FROM crl")
def _(spark, d):
    return latest.latest_snapshot(T.container_rows(spark, d)).select("node_id", "ts", "name", "state")


@query("containers_report", "SELECT node_id, hostname, name, state, status, restart_count FROM ctl JOIN reg USING (node_id)")
def _(spark, d):
    return R.containers_report(T.registrations(spark, d), T.newest(spark, d, "docker"))


@query("current_concerns", """SELECT node_id, hostname, array_to_string(list_filter([CASE WHEN cpu_percent > 80 THEN 'CPU' END, CASE WHEN memory_percent > 85 THEN 'MEM' END,
    CASE WHEN disk_percent > 85 THEN 'DISK' END], lambda x: x IS NOT NULL), ',') AS concerns FROM st WHERE cpu_percent > 80 OR memory_percent > 85 OR disk_percent > 85""")
def _(spark, d):
    return R.current_concerns(state(spark, d, docker=False, gpu=False, alerts=False))


@query("diagnose_nodes", """WITH gf AS (SELECT node_id, list('GPU compute pressure' ORDER BY pos) FILTER (utilization_percent > 90) AS a, list('GPU memory pressure' ORDER BY pos) FILTER (memory_used_percent > 90) AS b,
        list('GPU overheating' ORDER BY pos) FILTER (temperature_celsius > 85) AS c FROM gpl GROUP BY 1)
    SELECT st.node_id, hostname, online, alert_count, CASE WHEN NOT online THEN 'OFFLINE' ELSE array_to_string(list_filter(
        [CASE WHEN pressure AND cpu_percent < 30 THEN 'I/O pressure' END, CASE WHEN cpu_percent > 80 THEN 'high CPU' END, CASE WHEN memory_percent > 85 THEN 'memory pressure' END, CASE WHEN disk_percent > 85 THEN 'disk space' END]
        || coalesce(a, []) || coalesce(b, []) || coalesce(c, []) || [CASE WHEN restarting > 0 THEN 'container restarts' END, CASE WHEN alert_count > 0 THEN 'active alerts' END], lambda x: x IS NOT NULL), ',') END AS findings
    FROM st LEFT JOIN gf USING (node_id)""")
def _(spark, d):
    return R.diagnose_nodes(state(spark, d))


@query("diagnose_fleet", """SELECT node_id, hostname, issues FROM (SELECT node_id, hostname, CASE WHEN NOT online THEN 'OFFLINE' ELSE array_to_string(list_filter([CASE WHEN cpu_percent > 80 THEN 'CPU' END,
    CASE WHEN memory_percent > 85 THEN 'MEM' END, CASE WHEN disk_percent > 85 THEN 'DISK' END, CASE WHEN pressure THEN 'LOAD' END], lambda x: x IS NOT NULL), ',') END AS issues FROM st) WHERE issues <> ''""")
def _(spark, d):
    return R.diagnose_fleet(state(spark, d, docker=False, gpu=False, alerts=False))


@query("gpu_report", """SELECT node_id, hostname, name, utilization_percent AS util, memory_used_percent AS vram_used_pct, floor(memory_total_bytes / 1073741824.0::DOUBLE * 100 + 0.5) / 100 AS vram_total_gb,
    floor(memory_used_bytes / 1073741824.0::DOUBLE * 100 + 0.5) / 100 AS vram_used_gb, floor(memory_free_bytes / 1073741824.0::DOUBLE * 100 + 0.5) / 100 AS vram_free_gb, temperature_celsius, power_watts,
    power_limit_watts, fan_speed_percent, online FROM gpl JOIN nu USING (node_id)""")
def _(spark, d):
    return R.gpu_report(T.nodes(spark, d), T.newest(spark, d, "gpu"), T.as_of(), T.ONLINE_MINUTES)


@query("smart_report", """SELECT node_id, hostname, device, model, CASE WHEN healthy THEN 'OK' WHEN NOT healthy THEN 'FAIL' ELSE '?' END AS status, temperature_c, power_on_hours, online FROM sml JOIN nu USING (node_id)""")
def _(spark, d):
    return R.smart_report(T.nodes(spark, d), T.newest(spark, d, "smart"), T.as_of(), T.ONLINE_MINUTES)


@query("smart_health_counts", """SELECT count(*) AS drives, count(*) FILTER (healthy) AS healthy, count(*) FILTER (NOT healthy) AS unhealthy, count(*) FILTER (healthy IS NULL) AS unknown, count(DISTINCT node_id) AS hosts FROM sml""")
def _(spark, d):
    return A.smart_health_counts(silver.explode_items(T.newest(spark, d, "smart"), "devices"))


@query("disk_capacity", f"""SELECT st.node_id, hostname, st.disk_percent, {BAND.format('st.disk_percent')} AS band, online, CASE WHEN st.disk_percent > 90 THEN 'critical' WHEN st.disk_percent > 80 THEN 'approaching' END AS warning,
    coalesce(array_to_string(list_filter([CASE WHEN sl.disk_percent > 0 THEN '/:' || sl.disk_percent || ':' || (floor(((sl.u + 100) * 1073741824 // 101) * (101 - sl.disk_percent) / 1073741824.0::DOUBLE * 10 + 0.5) / 10) || '/' || (sl.u + 100)::DOUBLE END,
        CASE WHEN d1 > 0 THEN '/data:' || d1 || ':' || (floor(((sl.u + 200) * 1073741824 // 101) * (101 - d1) / 1073741824.0::DOUBLE * 10 + 0.5) / 10) || '/' || (sl.u + 200)::DOUBLE END], lambda x: x IS NOT NULL), ','), '') AS mounts
    FROM st LEFT JOIN sl USING (node_id)""")
def _(spark, d):
    system = T.newest(spark, d, "system")
    return R.disk_capacity(state(spark, d, docker=False, gpu=False, alerts=False), system)


@query("memory_capacity", f"SELECT node_id, hostname, memory_percent, 100 - memory_percent AS free_percent, memory_total_gb, {BAND.format('memory_percent')} AS band, online FROM st")
def _(spark, d):
    return R.memory_capacity(state(spark, d, docker=False, gpu=False, alerts=False))


@query("uptime_report", f"SELECT node_id, hostname, {UPTIME} AS uptime, online FROM st")
def _(spark, d):
    return R.uptime_report(state(spark, d, docker=False, gpu=False, alerts=False))


@query("fleet_overview", """SELECT node_id, hostname, CASE WHEN online AND alert_count = 0 THEN 'ok' WHEN alert_count > 0 THEN 'alert' ELSE 'offline' END AS status, cpu_percent, memory_percent, disk_percent,
    containers_total, alert_count FROM st""")
def _(spark, d):
    return R.fleet_overview(state(spark, d, gpu=False))


@query("fleet_totals", """SELECT *, CASE WHEN alerts_total = 0 AND offline = 0 THEN 'healthy' WHEN alerts_critical > 0 THEN 'critical' WHEN offline > 0 THEN 'degraded' WHEN alerts_total > 0 THEN 'mostly_healthy' ELSE 'normal' END AS health
    FROM (SELECT count(*) AS nodes, count(*) FILTER (online) AS online, count(*) FILTER (NOT online) AS offline, CAST(sum(alert_count) AS BIGINT) AS alerts_total, CAST(sum(critical_count) AS BIGINT) AS alerts_critical FROM st)""")
def _(spark, d):
    return A.fleet_totals(T.nodes(spark, d), T.alerts(spark, d), T.as_of(), T.ONLINE_MINUTES)


@query("offline_nodes", "SELECT node_id, hostname, last_seen FROM nu WHERE NOT online")
def _(spark, d):
    return A.offline_nodes(T.nodes(spark, d), T.as_of(), T.ONLINE_MINUTES)


@query("temperature_report", """WITH t AS (SELECT node_id, temp AS v FROM sl UNION ALL SELECT node_id, temperature_celsius FROM gpl), m AS (SELECT node_id, max(v) AS mt, count(*) AS c FROM t WHERE v > 0 GROUP BY 1)
    SELECT nu.node_id, hostname, coalesce(mt, 0) AS max_temp, coalesce(c, 0) AS sensors, CASE WHEN mt >= 90 THEN 'critical' WHEN mt >= 80 THEN 'concerning' ELSE 'normal' END AS band, online FROM nu LEFT JOIN m USING (node_id)""")
def _(spark, d):
    return R.temperature_report(T.nodes(spark, d), T.newest(spark, d, "system"), T.newest(spark, d, "gpu"), T.as_of(), T.ONLINE_MINUTES)


@query("temperature_readings", """WITH t AS (SELECT node_id, 'package' AS label, temp AS value, 'system' AS source FROM sl UNION ALL SELECT node_id, name, temperature_celsius, 'gpu' FROM gpl)
    SELECT t.*, hostname, CASE WHEN value >= 90 THEN 'critical' WHEN value >= 80 THEN 'concerning' ELSE 'normal' END AS band FROM t JOIN reg USING (node_id) WHERE value > 0""")
def _(spark, d):
    return R.temperature_readings(T.registrations(spark, d), T.newest(spark, d, "system"), T.newest(spark, d, "gpu"))


ISSUES = """iss AS (
    SELECT node_id, hostname, 'critical' AS severity, 'offline' AS issue FROM st WHERE NOT online UNION ALL
    SELECT node_id, hostname, CASE WHEN cpu_percent > 90 THEN 'critical' ELSE 'warning' END, 'cpu' FROM st WHERE online AND cpu_percent > 80 UNION ALL
    SELECT node_id, hostname, CASE WHEN memory_percent > 90 THEN 'critical' ELSE 'warning' END, 'memory' FROM st WHERE online AND memory_percent > 85 UNION ALL
    SELECT node_id, hostname, CASE WHEN disk_percent > 90 THEN 'critical' ELSE 'warning' END, 'disk' FROM st WHERE online AND disk_percent > 85 UNION ALL
    SELECT node_id, hostname, 'warning', 'load' FROM st WHERE online AND pressure UNION ALL
    SELECT node_id, hostname, CASE WHEN temperature_celsius >= 90 THEN 'critical' ELSE 'warning' END, 'gpu_temp' FROM gpl JOIN nu USING (node_id) WHERE online AND temperature_celsius >= 80 UNION ALL
    SELECT node_id, hostname, severity, 'alert: ' || message FROM act JOIN reg USING (node_id))"""


@query("attention_issues", f"WITH {ISSUES} SELECT * FROM iss")
def _(spark, d):
    return R.attention_issues(state(spark, d, docker=False), T.alerts(spark, d))


@query("attention", f"""WITH {ISSUES} SELECT node_id, hostname, count(*) AS issues, ['info', 'warning', 'critical'][max(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END)] AS worst_severity
    FROM iss GROUP BY 1, 2""")
def _(spark, d):
    return R.attention(state(spark, d, docker=False), T.alerts(spark, d))


LASTRATE = f"{RATES}, lr AS (SELECT * FROM r3 JOIN (SELECT node_id, max(ts) AS ts, count(*) AS c FROM s GROUP BY 1) USING (node_id, ts) WHERE c > 1)"


@query("network_report", f"""WITH {LASTRATE} SELECT nu.node_id, hostname, online, CASE WHEN online THEN rx_mbps END AS rx_mbps, CASE WHEN online THEN tx_mbps END AS tx_mbps FROM nu LEFT JOIN lr USING (node_id)""")
def _(spark, d):
    return R.network_report(T.nodes(spark, d), T.system_samples(spark, d), T.as_of(), T.ONLINE_MINUTES)


@query("inventory", "SELECT os, arch, agent_version, count(*) AS nodes, count(*) FILTER (online) AS online, count(*) FILTER (NOT online) AS offline FROM nu GROUP BY 1, 2, 3")
def _(spark, d):
    return A.inventory(T.nodes(spark, d), T.as_of(), T.ONLINE_MINUTES)


@query("inventory_list", "SELECT node_id, hostname, os, arch, agent_version, last_seen, online FROM nu")
def _(spark, d):
    return R.inventory_list(T.nodes(spark, d), T.as_of(), T.ONLINE_MINUTES)


@query("cluster_counts", "SELECT count(*) AS nodes, count(*) FILTER (online) AS online, count(*) FILTER (NOT online) AS offline FROM nu")
def _(spark, d):
    return R.cluster_counts(T.nodes(spark, d), T.as_of(), T.ONLINE_MINUTES)


@query("dashboard", f"""WITH {LASTRATE} SELECT st.node_id, hostname, online, last_seen, cpu_percent, memory_percent, disk_percent, uptime_seconds, load_1m, memory_total_gb, disk_total_gb, containers_total, containers_running,
    gpu_count, CASE WHEN rx_mbps IS NOT NULL THEN least(rx_mbps, 1000) END AS net_rx_mbps, CASE WHEN tx_mbps IS NOT NULL THEN least(tx_mbps, 1000) END AS net_tx_mbps, alert_count, critical_count, critical_count > 0 AS pinned FROM st LEFT JOIN lr USING (node_id)""")
def _(spark, d):
    pins = A.alert_counts(T.alerts(spark, d)).filter("critical_count > 0")
    return R.dashboard(state(spark, d), T.system_samples(spark, d), pins)


# ---- names ---------------------------------------------------------------------------------------

ORDER = "row_number() OVER (ORDER BY last_seen DESC NULLS LAST, node_id) AS ord"


def wanted(spark, d):
    """Names as a user might type them: a customer's number, a host of a segment, or a part of it."""
    c = T.table(spark, d, "customer")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    name = (F.when(seg == "BUILDING", F.concat(F.lit(" Building-"), k)).when(seg == "MACHINERY", F.concat(F.lit("node household-"), k))
            .when(seg == "FURNITURE", k.cast("string")).when(seg == "HOUSEHOLD", F.concat(F.lit("hold-"), k)).otherwise(F.concat(F.lit("zz"), k)))
    return c.select(name.alias("name")).distinct()


WANTED = """wn AS (SELECT DISTINCT CASE c_mktsegment WHEN 'BUILDING' THEN ' Building-' || c_custkey WHEN 'MACHINERY' THEN 'node household-' || c_custkey WHEN 'FURNITURE' THEN c_custkey::VARCHAR
    WHEN 'HOUSEHOLD' THEN 'hold-' || c_custkey ELSE 'zz' || c_custkey END AS name FROM customer)"""


@query("match_node", f"""WITH {WANTED}, o AS (SELECT node_id, hostname, lower(hostname) AS h, {ORDER} FROM n)
    SELECT name, node_id, hostname, CASE WHEN h = trim(lower(name)) THEN 1 ELSE 2 END AS match_rank FROM wn JOIN o ON contains(h, trim(lower(name))) OR contains(trim(lower(name)), h)
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY match_rank, ord) = 1""")
def _(spark, d):
    return names.match_node(wanted(spark, d), T.nodes(spark, d))


@query("find_container", """WITH c0 AS (SELECT lower(name) AS cn, name AS container, state, status, restart_count, ctl.node_id, hostname, pos, last_seen FROM ctl JOIN n USING (node_id)),
    w AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'My SVC' || (event_id % 9) || ' thing' ELSE 'vc' || (event_id % 9) END AS name FROM events)
    SELECT name, node_id, hostname, container, state, status, restart_count FROM w JOIN c0 ON contains(cn, lower(name)) OR contains(lower(name), cn)
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY last_seen DESC NULLS LAST, node_id, pos) = 1""")
def _(spark, d):
    b = T._base(spark, d)
    w = b.select(F.when(F.col("u") % 2 == 0, F.concat(F.lit("My SVC"), F.col("sample_id") % 9, F.lit(" thing"))).otherwise(
        F.concat(F.lit("vc"), F.col("sample_id") % 9)).alias("name")).distinct()
    rows = silver.explode_items(T.newest(spark, d, "docker"), "containers")
    return names.find_container(w, rows, T.nodes(spark, d))
