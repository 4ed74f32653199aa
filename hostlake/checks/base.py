"""Query registry and the SQL views that mirror sources/testbed.py."""

from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

VIEWS = {
    "e": """SELECT 'n' || user_id AS node_id, ts, event_id AS sample_id, event_type, value, user_id AS u,
        CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, props FROM events""",
    "s": """SELECT node_id, ts, sample_id, u, k, least(value, 100) AS cpu_percent, u % 8 + 1 AS cpu_count,
        CAST(k AS DOUBLE) AS memory_percent, (u % 5 + 4) * 1073741824 AS memory_total_bytes,
        ((u % 5 + 4) * 1073741824 // 100) * k AS memory_used_bytes,
        CAST((k * 37 + u) % 101 AS DOUBLE) AS disk_percent, CAST((k * 53 + u * 7) % 101 AS DOUBLE) AS d1,
        value / 10 AS load1, value / 20 AS load5, value / 40 AS load15, k * 3600 + sample_id % 5000 AS uptime_seconds,
        k * 7500000 + sample_id * 1000 AS r0, k * 1250000 + sample_id * 10 AS t0,
        CASE WHEN k % 3 = 0 THEN (99 - k) * 1000000 END AS r1, CASE WHEN k % 3 = 0 THEN (99 - k) * 500000 END AS t1,
        sample_id * 1000000 AS lo, CAST(k % 70 + 30 AS DOUBLE) AS temp FROM e""",
    "i3": "SELECT unnest([0, 1, 2]) AS i",
    "ct": """SELECT node_id, ts, sample_id, i AS pos, 'c' || i || '-' || u AS id, 'svc' || ((k + i) % 7) AS name,
        CASE WHEN (k + i) % 3 <> 0 THEN 'running' ELSE 'exited' END AS state, '' AS status,
        k * (i + 1) % 6 AS restart_count, CAST(k * (i + 2) % 101 AS DOUBLE) AS cpu_percent,
        (k + 1) * (i + 1) * 1048576 AS memory_usage_bytes FROM e, i3 WHERE event_type = 'click'""",
    "gp": """SELECT node_id, ts, sample_id, i AS pos, i AS index, 'GPU-' || i AS name,
        CAST(k * (3 + i) % 101 AS DOUBLE) AS utilization_percent, CAST((k * (5 + i)) % 101 AS DOUBLE) AS memory_used_percent,
        8589934592 AS memory_total_bytes, (8589934592 // 101) * ((k * (5 + i)) % 101) AS memory_used_bytes,
        (8589934592 // 101) * (101 - (k * (5 + i)) % 101) AS memory_free_bytes,
        CAST(k % 60 + 40 - i AS DOUBLE) AS temperature_celsius, CAST(k + 50 AS DOUBLE) AS power_watts,
        250.0::DOUBLE AS power_limit_watts, CAST(k % 100 AS DOUBLE) AS fan_speed_percent
        FROM e, i3 WHERE event_type = 'view' AND (i = 0 OR (i = 1 AND u % 2 = 0))""",
    "sv": """SELECT node_id, ts, sample_id, i AS pos, CASE WHEN i = 0 THEN 'web' ELSE 'db' END AS name,
        CASE WHEN i = 0 THEN k % 5 <> 0 ELSE k % 7 <> 0 END AS healthy FROM e, i3 WHERE event_type = 'signup' AND i < 2""",
    "sm": """SELECT node_id, ts, sample_id, 'sda' AS device, 'DISK' AS model,
        CASE WHEN k % 10 = 1 THEN NULL ELSE k % 10 <> 0 END AS healthy, CAST(k % 40 + 35 AS DOUBLE) AS temperature_c,
        k * 100 AS power_on_hours, greatest(k - 90, 0) AS reallocated_sector_ct,
        CASE WHEN k % 13 = 0 THEN 'timeout' END AS error FROM e WHERE event_type = 'purchase'""",
    "zf": """SELECT node_id, ts, sample_id, 'tank' AS name, CAST(k * 11 % 101 AS DOUBLE) AS used_percent,
        k % 6 <> 0 AS pool_healthy FROM e WHERE event_type = 'purchase'""",
    "seen": "SELECT node_id, max(ts) AS last_seen FROM e GROUP BY 1",
    "reg": """SELECT 'n' || c_custkey AS node_id, lower(c_mktsegment) || '-' || c_custkey AS hostname,
        ['linux', 'freebsd', 'darwin'][c_nationkey % 3 + 1] AS os, CASE WHEN c_nationkey % 2 = 0 THEN 'amd64' ELSE 'arm64' END AS arch,
        '0.' || (c_nationkey % 4) AS agent_version, TIMESTAMP '2023-01-01' + to_hours(c_custkey) AS registered_at
        FROM customer WHERE c_acctbal >= 0""",
    "n": "SELECT reg.*, last_seen FROM reg LEFT JOIN seen USING (node_id)",
    "nu": f"""SELECT *, coalesce(epoch_us({AS_OF}) - epoch_us(last_seen) < 43200000000, false) AS online FROM n""",
    "own": """SELECT 'acct' || c_nationkey AS account, 'n' || c_custkey AS node_id,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'pro' WHEN 'MACHINERY' THEN 'business' WHEN 'HOUSEHOLD' THEN 'gold'
        WHEN 'FURNITURE' THEN 'free' END AS plan, TIMESTAMP '2023-01-01' + to_hours(c_custkey) AS created_at,
        '10.0.0.' || c_nationkey AS ip_address FROM customer""",
    "al": """SELECT sample_id AS alert_id, node_id,
        ['cpu_high', 'memory_high', 'disk_critical', 'service_failed', 'gpu_temp_high'][k % 5 + 1] AS alert_type,
        CASE k % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'info' ELSE 'warning' END AS severity,
        'alert ' || sample_id AS message, ts AS created_at, CASE WHEN k >= 30 THEN ts + to_hours(k) END AS resolved_at
        FROM e WHERE event_type = 'error'""",
    "act": "SELECT * FROM al WHERE resolved_at IS NULL",
    "ac": """SELECT node_id, count(*) AS alert_count, count(*) FILTER (severity = 'critical') AS critical_count
        FROM act GROUP BY 1""",
    "rl": """SELECT sample_id AS log_id, node_id, CASE WHEN k <> 0 THEN ts END AS ts, ts AS arrived_at,
        CASE WHEN k % 10 <> 9 THEN 'svc' || (u % 7) END AS source,
        CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value > 100 THEN 'Warn' WHEN event_type = 'purchase' THEN 'debug'
        WHEN event_type = 'view' THEN 'notice' END AS level, event_type || ' ' || props AS message FROM e""",
    "l": """SELECT log_id, node_id, coalesce(ts, arrived_at) AS ts, coalesce(source, 'unknown') AS source,
        CASE WHEN lower(level) IN ('debug', 'info', 'warn', 'error') THEN lower(level) ELSE 'info' END AS level,
        left(message, 4096) AS message FROM rl""",
    "ch": """SELECT 'r' || r_regionkey AS channel_id, 'webhook' AS channel_type, r_regionkey <> 2 AS enabled,
        r_regionkey % 3 AS min_rank, NULL AS owner FROM region UNION ALL
        SELECT 'u' || n_nationkey, 'ntfy', n_regionkey <> 1, n_nationkey % 3, 'acct' || n_nationkey FROM nation""",
    "mt": """SELECT 'n' || o_custkey AS node_id, o_orderpriority AS reason,
        TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 720 AS INT)) AS started_at, CASE WHEN o_orderstatus <> 'P'
        THEN TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 720 + o_orderkey % 96 AS INT)) END AS ends_at,
        o_orderstatus <> 'F' AS enabled FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "cr": """SELECT 's' || l_suppkey AS node_id, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ts,
        'p-' || l_partkey || '-' || l_orderkey || '-' || l_linenumber AS name,
        CASE WHEN l_linestatus = 'O' THEN 'running' ELSE 'exited' END AS state, l_linenumber AS restart_count,
        l_discount * 1000 AS cpu_percent, l_extendedprice AS memory_usage_bytes FROM lineitem""",
    # newest sample of each collector per node
    "sl": "SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, sample_id DESC) = 1",
    "ctl": "SELECT * FROM ct QUALIFY rank() OVER (PARTITION BY node_id ORDER BY ts DESC, sample_id DESC) = 1",
    "gpl": "SELECT * FROM gp QUALIFY rank() OVER (PARTITION BY node_id ORDER BY ts DESC, sample_id DESC) = 1",
    "sml": "SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, sample_id DESC) = 1",
    "zfl": "SELECT * FROM zf QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, sample_id DESC) = 1",
    "ctc": """SELECT node_id, count(*) AS containers_total, count(*) FILTER (state = 'running') AS containers_running,
        count(*) FILTER (restart_count > 3) AS restarting FROM ctl GROUP BY 1""",
    "gpc": """SELECT node_id, count(*) AS gpu_count, max(utilization_percent) FILTER (pos = 0) AS gpu_utilization,
        max(memory_used_percent) FILTER (pos = 0) AS gpu_memory, max(temperature_celsius) FILTER (pos = 0) AS gpu_temperature
        FROM gpl GROUP BY 1""",
    # registry with newest readings and counts
    "st": """SELECT nu.*, coalesce(cpu_percent, 0.0::DOUBLE) AS cpu_percent, coalesce(memory_percent, 0.0::DOUBLE) AS memory_percent,
        coalesce(disk_percent, 0.0::DOUBLE) AS disk_percent, coalesce(uptime_seconds, 0) AS uptime_seconds,
        coalesce(load1, 0.0::DOUBLE) AS load_1m, coalesce(cpu_count, 0) AS cpu_count,
        coalesce(memory_total_bytes, 0) AS memory_total_bytes,
        floor(coalesce(memory_total_bytes, 0) / 1073741824.0::DOUBLE * 10 + 0.5) / 10 AS memory_total_gb,
        CASE WHEN u IS NULL THEN 0.0::DOUBLE ELSE CAST(u + 100 AS DOUBLE) END AS disk_total_gb,
        coalesce(containers_total, 0) AS containers_total, coalesce(containers_running, 0) AS containers_running,
        coalesce(restarting, 0) AS restarting, coalesce(gpu_count, 0) AS gpu_count, gpu_utilization, gpu_memory, gpu_temperature,
        coalesce(alert_count, 0) AS alert_count, coalesce(critical_count, 0) AS critical_count, u, k,
        load1 IS NOT NULL AS has_sample, coalesce(load1, 0) > CASE WHEN coalesce(cpu_count, 0) > 0 THEN cpu_count * 2 ELSE 4 END AS pressure
        FROM nu LEFT JOIN sl USING (node_id) LEFT JOIN ctc USING (node_id) LEFT JOIN gpc USING (node_id)
        LEFT JOIN ac USING (node_id)""",
    # summary of the last week
    "mx": f"""SELECT node_id, count(*) AS sample_count, {', '.join(
        f"floor({fn} * 100 + 0.5) / 100 AS {m}_{stat}"
        for m, c in (('cpu', 'cpu_percent'), ('memory', 'memory_percent'), ('disk', 'disk_percent'), ('load', 'load1'))
        for stat, fn in (('min', f'min({c})'), ('max', f'max({c})'), ('avg', f'avg({c})'), ('current', f'arg_max({c}, ts)')))}
        FROM s WHERE ts > {AS_OF} - INTERVAL 168 HOUR GROUP BY 1""",
    "ms": f"""SELECT mx.*, coalesce(t, 0) AS alerts_total, coalesce(r, 0) AS alerts_resolved FROM mx LEFT JOIN (
        SELECT node_id, count(*) AS t, count(resolved_at) AS r FROM al WHERE created_at > {AS_OF} - INTERVAL 168 HOUR GROUP BY 1)
        USING (node_id)""",
}


def sql(body: str) -> str:
    """body with the views it needs, directly or through other views, as leading WITH clauses."""
    needed: list[str] = []

    def visit(text: str, skip: str = "") -> None:
        for name in VIEWS:
            if name != skip and name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                visit(VIEWS[name], name)
                needed.append(name)

    visit(body)
    body = body.strip()
    if not needed:
        return body
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    if body.upper().startswith("WITH "):
        return f"WITH {views}, {body[5:]}"
    return f"WITH {views} {body}"


def query(name: str, oracle: str | None = None):
    """Registers a query under a name, with the SQL of its expected rows."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = sql(oracle)
        return fn

    return add
