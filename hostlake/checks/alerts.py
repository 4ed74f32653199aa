"""Rules, episodes, thresholds, routing and alert reports."""

from pyspark.sql import functions as F

from ..operators import accounts as acc
from ..operators import aggregates as A
from ..operators import rules
from ..operators import selection as sel
from ..operators.episodes import alert_episodes, with_cooldown
from ..plans import reports as R
from ..sources import testbed as T
from .base import AS_OF, query


def collectors(spark, d):
    return {"system": T.system_samples(spark, d), "docker": T.docker_samples(spark, d), "services": T.service_samples(spark, d),
            "gpu": T.gpu_samples(spark, d), "smart": T.smart_samples(spark, d)}


def thresholds(spark, d):
    return acc.threshold_cascade(T.registrations(spark, d), T.ownership(spark, d), T.preferences(spark, d))


def firings(spark, d, custom: bool = False):
    return rules.firings(collectors(spark, d), thresholds(spark, d) if custom else None)


def cycles(spark, d):
    return T.system_samples(spark, d).select("node_id", "ts")


THRESH = """th AS (SELECT reg.node_id,
    coalesce(CASE WHEN c_acctbal > 5000 THEN c_nationkey + 40 END, c_nationkey + 60)::DOUBLE AS cpu_warning,
    coalesce(CASE WHEN c_acctbal > 5000 THEN 50 END, 85)::DOUBLE AS memory_warning, 95.0::DOUBLE AS memory_critical, 80.0::DOUBLE AS disk_warning,
    (c_nationkey + 75)::DOUBLE AS disk_critical, 90.0::DOUBLE AS gpu_util_warning, 90.0::DOUBLE AS gpu_mem_warning,
    85.0::DOUBLE AS gpu_temp_warning, 95.0::DOUBLE AS gpu_temp_critical FROM reg JOIN customer ON reg.node_id = 'n' || c_custkey)"""

FIRE = """
    sx AS (SELECT s.*, {cpu} AS cw, {memw} AS mw, {diskc} AS dc, greatest(disk_percent, d1) AS dp,
        CASE WHEN disk_percent >= d1 THEN '/' ELSE '/data' END AS mnt FROM s {join}),
    f0 AS (
    SELECT node_id, ts, 'cpu_high' AS alert_type, 'warning' AS severity, 'CPU usage at ' || (floor(cpu_percent * 10 + 0.5) / 10) || '% (threshold: ' || cw::INT || '%)' AS message,
        cpu_percent AS value, 1 AS hits, 'system' AS collector FROM sx WHERE cpu_percent > cw UNION ALL
    SELECT node_id, ts, CASE WHEN memory_percent > 95 THEN 'memory_critical' ELSE 'memory_high' END, CASE WHEN memory_percent > 95 THEN 'critical' ELSE 'warning' END,
        'Memory usage at ' || memory_percent || '% (threshold: ' || CASE WHEN memory_percent > 95 THEN 95 ELSE mw::INT END || '%)', memory_percent, 1, 'system' FROM sx
        WHERE memory_percent > 95 OR memory_percent > mw UNION ALL
    SELECT node_id, ts, CASE WHEN dp > dc THEN 'disk_critical' ELSE 'disk_high' END, CASE WHEN dp > dc THEN 'critical' ELSE 'warning' END,
        'Disk usage at ' || dp || '% (' || mnt || ') (threshold: ' || CASE WHEN dp > dc THEN dc::INT ELSE 80 END || '%)', dp, 1, 'system' FROM sx WHERE dp > dc OR dp > 80 UNION ALL
    SELECT node_id, ts, 'load_high', 'warning', 'Load average ' || (floor(load1 * 100 + 0.5) / 100) || ' exceeds threshold (' || (cpu_count * 2) || ') for ' || cpu_count || ' CPUs',
        load1, 1, 'system' FROM sx WHERE load1 > cpu_count * 2 UNION ALL
    SELECT node_id, ts, 'container_restarts', 'warning', 'Container ''' || arg_max(name, pos) || ''' has restarted ' || arg_max(restart_count, pos) || ' times',
        arg_max(restart_count, pos)::DOUBLE, count(*)::INT, 'docker' FROM ct WHERE restart_count > 3 GROUP BY node_id, ts UNION ALL
    SELECT node_id, ts, 'service_failed', 'critical', 'Service ''' || arg_max(name, pos) || ''' health check failed', NULL, count(*)::INT, 'services'
        FROM sv WHERE NOT healthy GROUP BY node_id, ts UNION ALL
    SELECT node_id, ts, 'gpu_high', 'warning', arg_max(name, pos) || ' (GPU ' || max(pos) || ') utilization at ' || arg_max(utilization_percent, pos) || '% (threshold: 90%)',
        arg_max(utilization_percent, pos), count(*)::INT, 'gpu' FROM gp WHERE utilization_percent > 90 GROUP BY node_id, ts UNION ALL
    SELECT node_id, ts, 'gpu_memory_high', 'warning', arg_max(name, pos) || ' (GPU ' || max(pos) || ') memory at ' || arg_max(memory_used_percent, pos) || '% (threshold: 90%)',
        arg_max(memory_used_percent, pos), count(*)::INT, 'gpu' FROM gp WHERE memory_used_percent > 90 GROUP BY node_id, ts UNION ALL
    SELECT node_id, ts, 'gpu_temp_high', CASE WHEN arg_min(temperature_celsius, pos) > 95 THEN 'critical' ELSE 'warning' END,
        arg_max(name, pos) || ' (GPU ' || max(pos) || ') temperature at ' || arg_max(temperature_celsius, pos)::INT || '°C (threshold: 85°C)',
        arg_max(temperature_celsius, pos), count(*)::INT, 'gpu' FROM gp WHERE temperature_celsius > 85 GROUP BY node_id, ts UNION ALL
    SELECT node_id, ts, 'smart_unhealthy', 'critical', 'Disk sda (DISK) SMART health: FAILED', NULL, 1, 'smart' FROM sm WHERE error IS NULL AND NOT healthy UNION ALL
    SELECT node_id, ts, 'smart_temp_high', CASE WHEN temperature_c > 65 THEN 'critical' ELSE 'warning' END, 'Disk sda (DISK) temperature at ' || temperature_c::INT || '°C (threshold: 55°C)',
        temperature_c, 1, 'smart' FROM sm WHERE error IS NULL AND temperature_c > 55 UNION ALL
    SELECT node_id, ts, 'smart_reallocated', 'warning', 'Disk sda (DISK) has ' || reallocated_sector_ct || ' reallocated sector(s)', reallocated_sector_ct::DOUBLE, 1, 'smart'
        FROM sm WHERE error IS NULL AND reallocated_sector_ct > 0)"""
FIRE_DEFAULT = FIRE.format(cpu="90", memw="85", diskc="90", join="")
FIRE_CUSTOM = THRESH + "," + FIRE.format(
    cpu="coalesce(cpu_warning, 90)", memw="coalesce(memory_warning, 85)", diskc="coalesce(disk_critical, 90)",
    join="LEFT JOIN th USING (node_id)")

EPISODES = """
    cy AS (SELECT node_id, {col} ts, row_number() OVER (PARTITION BY node_id{colk} ORDER BY ts) AS no FROM {cycles}),
    fi AS (SELECT f0.*, no, no - row_number() OVER (PARTITION BY f0.node_id, alert_type ORDER BY no) AS island FROM f0 JOIN cy USING (node_id, {colu} ts)),
    ep0 AS (SELECT node_id, {col} alert_type, arg_min(severity, no) AS severity, min(ts) AS created_at, arg_max(message, no) AS message,
        arg_max(CASE WHEN value IS NULL THEN -1 ELSE value END, no) AS v0, max(ts) AS last_fired_at, max(no) AS last_no FROM fi GROUP BY node_id, {col} alert_type, island),
    ep1 AS (SELECT ep0.* EXCLUDE (last_no, v0), nullif(v0, -1) AS value, cy.ts AS resolved_at FROM ep0 LEFT JOIN cy ON cy.node_id = ep0.node_id {colj} AND cy.no = last_no + 1),
    ep AS (SELECT *, coalesce(epoch_us(lag(resolved_at) OVER (PARTITION BY node_id, alert_type ORDER BY created_at)) <= epoch_us(created_at) - {cool}, true) AS notify FROM ep1)"""


@query("alert_firings", f"WITH {FIRE_DEFAULT} SELECT * FROM f0")
def _(spark, d):
    return firings(spark, d)


@query("alert_firings_custom", f"WITH {FIRE_CUSTOM} SELECT * FROM f0")
def _(spark, d):
    return firings(spark, d, custom=True)


@query("firings_per_type", f"WITH {FIRE_DEFAULT} SELECT alert_type, severity, count(*) AS firings, CAST(sum(hits) AS BIGINT) AS hits FROM f0 GROUP BY 1, 2")
def _(spark, d):
    return firings(spark, d).groupBy("alert_type", "severity").agg(F.count("*").alias("firings"), F.sum("hits").alias("hits"))


@query("types_not_fired", f"""WITH {FIRE_DEFAULT} SELECT cy.node_id, cy.ts, 14 - count(alert_type) AS resolved_types
    FROM s AS cy LEFT JOIN f0 ON f0.node_id = cy.node_id AND f0.ts = cy.ts GROUP BY 1, 2""")
def _(spark, d):
    fired = firings(spark, d).groupBy("node_id", "ts").agg(F.collect_set("alert_type").alias("fired"))
    rows = cycles(spark, d).join(fired, ["node_id", "ts"], "left")
    none = F.expr("array()").cast("array<string>")
    return rows.select("node_id", "ts", F.size(rules.types_not_fired(F.coalesce("fired", none))).alias("resolved_types"))


ALL = {"col": "", "colk": "", "colu": "", "colj": "", "cycles": "s"}


@query("alert_episodes", f"WITH {FIRE_DEFAULT}, {EPISODES.format(cool='900000000', **ALL)} SELECT * FROM ep")
def _(spark, d):
    return alert_episodes(firings(spark, d), cycles(spark, d))


@query("alert_episodes_custom", f"WITH {FIRE_CUSTOM}, {EPISODES.format(cool='86400000000', **ALL)} SELECT * FROM ep")
def _(spark, d):
    """Own thresholds and a cooldown of a day, so that some episodes are not announced."""
    return alert_episodes(firings(spark, d, custom=True), cycles(spark, d), cooldown_minutes=1440)


BY_COLLECTOR = {"col": "collector,", "colk": ", collector", "colu": "collector,", "colj": "AND cy.collector = ep0.collector",
                "cycles": """(SELECT DISTINCT node_id, ts, unnest(CASE event_type WHEN 'click' THEN ['system', 'docker'] WHEN 'signup' THEN ['system', 'services']
                WHEN 'view' THEN ['system', 'gpu'] WHEN 'purchase' THEN ['system', 'smart'] ELSE ['system'] END) AS collector FROM e)"""}


@query("alert_episodes_by_collector", f"WITH {FIRE_DEFAULT}, {EPISODES.format(cool='900000000', **BY_COLLECTOR)} SELECT * FROM ep")
def _(spark, d):
    """Only payloads that carry the collector resolve its alerts."""
    seen = None
    for name, df in collectors(spark, d).items():
        rows = df.select("node_id", F.lit(name).alias("collector"), "ts")
        seen = rows if seen is None else seen.unionByName(rows)
    return alert_episodes(firings(spark, d), seen, keys=("node_id", "collector"))


@query("open_episodes", f"""WITH {FIRE_DEFAULT}, {EPISODES.format(cool='900000000', **ALL)} SELECT node_id, alert_type, severity, created_at,
    (epoch_us({AS_OF}) - epoch_us(created_at)) // 3600000000 AS open_hours FROM ep WHERE resolved_at IS NULL""")
def _(spark, d):
    from ..functions.scalars import micros
    ep = alert_episodes(firings(spark, d), cycles(spark, d)).filter("resolved_at is null")
    hours = F.floor((micros(T.as_of()) - micros("created_at")) / 3_600_000_000)
    return ep.select("node_id", "alert_type", "severity", "created_at", hours.alias("open_hours"))


OFFLINE = f"""
    o1 AS (SELECT DISTINCT node_id, ts FROM s), o2 AS (SELECT *, lead(ts) OVER (PARTITION BY node_id ORDER BY ts) AS nx FROM o1),
    o3 AS (SELECT *, CAST(ceil((epoch_us(ts) + 300000000) / 120000000.0::DOUBLE) AS BIGINT) * 120000000 AS op, CAST(ceil(epoch_us(nx) / 120000000.0::DOUBLE) AS BIGINT) * 120000000 AS cl FROM o2),
    o4 AS (SELECT node_id, 'node_offline' AS alert_type, 'critical' AS severity, make_timestamp(op) AS created_at, ts AS last_seen,
        CASE WHEN cl <= epoch_us({AS_OF}) THEN make_timestamp(cl) END AS resolved_at FROM o3 WHERE coalesce(op < epoch_us(nx), op <= epoch_us({AS_OF})))"""


@query("offline_episodes", f"""WITH {OFFLINE} SELECT *, coalesce(epoch_us(lag(resolved_at) OVER (PARTITION BY node_id ORDER BY created_at)) <= epoch_us(created_at) - 900000000, true) AS notify FROM o4""")
def _(spark, d):
    return with_cooldown(rules.offline_episodes(T.system_samples(spark, d), T.as_of()))


@query("offline_now", """SELECT node_id, 'node_offline' AS alert_type, 'critical' AS severity, 'No heartbeat from ' || hostname || ' for >720 minutes' AS message FROM nu WHERE NOT online""")
def _(spark, d):
    return rules.offline_now(T.nodes(spark, d), T.as_of(), T.ONLINE_MINUTES).drop("ts")


@query("threshold_cascade", f"WITH {THRESH} SELECT * FROM th")
def _(spark, d):
    return thresholds(spark, d)


@query("active_alerts", "SELECT act.*, hostname FROM act JOIN reg USING (node_id)")
def _(spark, d):
    return acc.with_hostname(sel.active_alerts(T.alerts(spark, d)), T.registrations(spark, d))


@query("alerts_in_range", "SELECT * FROM al WHERE created_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
def _(spark, d):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return sel.alerts_in_range(T.alerts(spark, d), start=t("2024-01-10"), end=t("2024-01-20"))


SEV = """count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning,
    count(*) FILTER (severity = 'info') AS info, count(*) FILTER (resolved_at IS NULL) AS active, count(resolved_at) AS resolved"""


@query("severity_breakdown", f"SELECT node_id, {SEV} FROM al GROUP BY 1")
def _(spark, d):
    return A.severity_breakdown(T.alerts(spark, d), "node_id")


@query("alert_type_breakdown", "SELECT alert_type, count(*) AS alerts FROM al WHERE created_at >= TIMESTAMP '2024-01-15' GROUP BY 1")
def _(spark, d):
    return A.alert_type_breakdown(sel.alerts_in_range(T.alerts(spark, d), start=F.lit("2024-01-15").cast("timestamp_ntz")))


@query("route_notifications", """WITH x AS (SELECT alert_id, node_id, alert_type, severity, CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END AS r FROM al)
    SELECT alert_id, node_id, alert_type, severity, channel_id, channel_type, 'admin' AS scope FROM x JOIN ch ON r >= min_rank WHERE enabled AND owner IS NULL UNION ALL
    SELECT alert_id, x.node_id, alert_type, severity, channel_id, channel_type, 'user' FROM x JOIN own USING (node_id) JOIN ch ON owner = account AND r >= min_rank WHERE enabled""")
def _(spark, d):
    return acc.route_notifications(T.alerts(spark, d), T.channels(spark, d), T.ownership(spark, d))


@query("episode_outbox", f"""WITH {FIRE_DEFAULT}, {EPISODES.format(cool='86400000000', **ALL)}, x AS (SELECT *, CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END AS r FROM ep WHERE notify)
    SELECT channel_id, alert_type, count(*) AS notifications FROM x JOIN ch ON r >= min_rank WHERE enabled AND owner IS NULL GROUP BY 1, 2 UNION ALL
    SELECT channel_id, alert_type, count(*) FROM x JOIN own USING (node_id) JOIN ch ON owner = account AND r >= min_rank WHERE enabled GROUP BY 1, 2""")
def _(spark, d):
    ep = alert_episodes(firings(spark, d), cycles(spark, d), cooldown_minutes=1440).filter("notify")
    ep = ep.withColumn("alert_id", F.concat_ws("|", "node_id", "alert_type", "created_at"))
    out = acc.route_notifications(ep, T.channels(spark, d), T.ownership(spark, d))
    return out.groupBy("channel_id", "alert_type").agg(F.count("*").alias("notifications"))


@query("alert_feed", "SELECT al.*, hostname FROM al JOIN reg USING (node_id) ORDER BY created_at DESC, alert_id DESC LIMIT 20")
def _(spark, d):
    return R.alert_feed(T.alerts(spark, d), T.registrations(spark, d), 20)


@query("alerts_report_active", f"SELECT {SEV} FROM act")
def _(spark, d):
    return R.alerts_report(T.alerts(spark, d), T.as_of())


@query("alerts_report_recent", f"SELECT {SEV} FROM al WHERE created_at BETWEEN {AS_OF} - INTERVAL 24 HOUR AND {AS_OF}")
def _(spark, d):
    return R.alerts_report(T.alerts(spark, d), T.as_of(), recent=True)


@query("alerts_report_active_rows", "SELECT al.*, hostname FROM al JOIN reg USING (node_id) WHERE resolved_at IS NULL ORDER BY created_at DESC, alert_id DESC LIMIT 8")
def _(spark, d):
    return R.newest_alerts(T.alerts(spark, d), T.registrations(spark, d), T.as_of())


@query("alerts_report_recent_rows", f"SELECT al.*, hostname FROM al JOIN reg USING (node_id) WHERE created_at BETWEEN {AS_OF} - INTERVAL 24 HOUR AND {AS_OF} ORDER BY created_at DESC, alert_id DESC LIMIT 5")
def _(spark, d):
    return R.newest_alerts(T.alerts(spark, d), T.registrations(spark, d), T.as_of(), recent=True)


@query("active_feed", "SELECT al.*, hostname FROM al JOIN reg USING (node_id) WHERE resolved_at IS NULL ORDER BY created_at DESC, alert_id DESC LIMIT 15")
def _(spark, d):
    return R.alert_feed(T.alerts(spark, d), T.registrations(spark, d), 15, active_only=True)


@query("time_range_report", f"""SELECT alert_type, count(*) AS fired, count(resolved_at) AS resolved, count(*) - count(resolved_at) AS active,
    count(*) FILTER (severity = 'critical') AS critical FROM al WHERE created_at BETWEEN {AS_OF} - INTERVAL 200 HOUR AND {AS_OF} GROUP BY 1""")
def _(spark, d):
    return R.time_range_report(T.alerts(spark, d), "what happened in the last 200 hours", T.as_of())


@query("critical_in_range", f"SELECT * FROM al WHERE severity = 'critical' AND created_at BETWEEN {AS_OF} - INTERVAL 7 DAY AND {AS_OF} ORDER BY created_at DESC, alert_id DESC LIMIT 3")
def _(spark, d):
    from ..functions.scalars import shift
    return R.critical_in_range(T.alerts(spark, d), shift(T.as_of(), days=-7), T.as_of())
