"""Threshold rules over samples: which alert types a payload fires, with severity and message.

Rules of one collector are evaluated in one pass over its rows, device lists with higher-order functions,
so nothing is exploded or shuffled to decide that a row does not fire. Of several devices firing the
same type in one payload the first sets the severity and the last one the message, as the store does.
"""

from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import micros, online
from .accounts import THRESHOLDS
from .ordered import with_neighbours
from .silver import worst_disk

# Alert types that a payload resolves when it does not fire them.
PAYLOAD_TYPES = (
    "cpu_high", "memory_critical", "memory_high", "disk_critical", "disk_high", "load_high",
    "container_restarts", "service_failed", "gpu_high", "gpu_memory_high", "gpu_temp_high",
    "smart_unhealthy", "smart_temp_high", "smart_reallocated",
)
RESTART_LIMIT = 3
SMART_WARM, SMART_HOT = 55, 65
OFFLINE_MINUTES, CHECK_SECONDS = 5, 120


def _round(v: str, digits: int = 1) -> str:
    scale = 10**digits
    return f"cast(floor({v} * {scale}D + 0.5D) / {scale}D AS STRING)" if digits else f"cast(floor({v} + 0.5D) AS STRING)"


def _plain(c: str) -> str:
    """A threshold as written: without decimals when it is whole."""
    return f"IF({c} = floor({c}), cast(floor({c}) AS STRING), cast({c} AS STRING))"


def _firing(kind: str, severity: str, message: str, value: str, hits: str = "1") -> str:
    return (f"named_struct('alert_type', '{kind}', 'severity', {severity}, 'message', {message}, "
            f"'value', cast({value} AS DOUBLE), 'hits', {hits})")


def _system(t: Callable[[str], str]) -> list[str]:
    def rule(what, v, kind, severity, key, label="''"):
        text = f"concat('{what} usage at ', {_round(v)}, '%', {label}, ' (threshold: ', {_plain(t(key))}, '%)')"
        return f"WHEN {v} > {t(key)} THEN {_firing(kind, repr(severity), text, v)}"

    disk, mount = "_worst.used_percent", "IF(_worst.label <> '', concat(' (', _worst.label, ')'), '')"
    load = ("concat('Load average ', " + _round("load1", 2) + ", ' exceeds threshold (', cpu_count * 2, ') for ', "
            "cpu_count, ' CPUs')")
    return [
        f"CASE {rule('CPU', 'cpu_percent', 'cpu_high', 'warning', 'cpu_warning')} END",
        f"CASE {rule('Memory', 'memory_percent', 'memory_critical', 'critical', 'memory_critical')} "
        f"{rule('Memory', 'memory_percent', 'memory_high', 'warning', 'memory_warning')} END",
        f"CASE {rule('Disk', disk, 'disk_critical', 'critical', 'disk_critical', mount)} "
        f"{rule('Disk', disk, 'disk_high', 'warning', 'disk_warning', mount)} END",
        f"CASE WHEN load1 > cpu_count * 2 THEN {_firing('load_high', repr('warning'), load, 'load1')} END",
    ]


def _devices(kind: str, array: str, fires: str, severity: str, message: str, value: str) -> str:
    """Rule over the elements x of an array; severity of the first hit, message and value of the last."""
    hits = f"filter({array}, x -> {fires})"

    def of(position: str, text: str) -> str:
        return re.sub(r"\bx\.", f"get({hits}, {position}).", text)

    last = f"size({hits}) - 1"
    return (f"CASE WHEN exists({array}, x -> {fires}) THEN "
            f"{_firing(kind, of('0', severity), of(last, message), of(last, value), f'size({hits})')} END")


def _docker(_t) -> list[str]:
    return [_devices("container_restarts", "containers", f"x.restart_count > {RESTART_LIMIT}", "'warning'",
                     "concat('Container \\'', x.name, '\\' has restarted ', x.restart_count, ' times')", "x.restart_count")]


def _services(_t) -> list[str]:
    return [_devices("service_failed", "services", "NOT x.healthy", "'critical'",
                     "concat('Service \\'', x.name, '\\' health check failed')", "null")]


def _gpu(t) -> list[str]:
    def rule(kind, what, field, key, unit, digits, severity="'warning'"):
        text = (f"concat(x.name, ' (GPU ', x.index, ') {what} at ', {_round(f'x.{field}', digits)}, '{unit} (threshold: ', "
                f"{_plain(t(key))}, '{unit})')")
        return _devices(kind, "devices", f"x.{field} > {t(key)}", severity, text, f"x.{field}")

    hot = f"IF(x.temperature_celsius > {t('gpu_temp_critical')}, 'critical', 'warning')"
    return [
        rule("gpu_high", "utilization", "utilization_percent", "gpu_util_warning", "%", 1),
        rule("gpu_memory_high", "memory", "memory_used_percent", "gpu_mem_warning", "%", 1),
        rule("gpu_temp_high", "temperature", "temperature_celsius", "gpu_temp_warning", "°C", 0, hot),
    ]


def _smart(_t) -> list[str]:
    ok = "coalesce(x.error, '') = ''"
    name = "'Disk ', x.device, IF(x.model <> '', concat(' (', x.model, ')'), '')"
    return [
        _devices("smart_unhealthy", "devices", f"{ok} AND NOT x.healthy", "'critical'",
                 f"concat({name}, ' SMART health: FAILED')", "null"),
        _devices("smart_temp_high", "devices", f"{ok} AND x.temperature_c > {SMART_WARM}",
                 f"IF(x.temperature_c > {SMART_HOT}, 'critical', 'warning')",
                 f"concat({name}, ' temperature at ', {_round('x.temperature_c', 0)}, '°C (threshold: {SMART_WARM}°C)')",
                 "x.temperature_c"),
        _devices("smart_reallocated", "devices", f"{ok} AND x.reallocated_sector_ct > 0", "'warning'",
                 f"concat({name}, ' has ', x.reallocated_sector_ct, ' reallocated sector(s)')", "x.reallocated_sector_ct"),
    ]


# collector -> SQL expressions of one row, each null or a firing; a new rule is one more expression here.
# The argument gives the SQL of a threshold.
RULES: dict[str, Callable[[Callable[[str], str]], list[str]]] = {
    "system": _system, "docker": _docker, "services": _services, "gpu": _gpu, "smart": _smart}


def default_threshold(key: str) -> str:
    return f"{float(THRESHOLDS[key])}D"


def fired(collector: str, threshold: Callable[[str], str] = default_threshold) -> Column:
    """The firings of a row of one collector, as an array."""
    return F.expr(f"array_compact(array({', '.join(RULES[collector](threshold))}))")


def firings(collectors: dict[str, DataFrame], thresholds: DataFrame | None = None) -> DataFrame:
    """(node_id, ts, alert_type, severity, message, value, hits, collector): a row per fired type and payload.

    `thresholds` holds a row per node from threshold_cascade; nodes without a row use the defaults.
    """
    out = None
    for name, df in collectors.items():
        if thresholds is None:
            t = default_threshold
        else:
            used = {"system": ("cpu", "memory", "disk"), "gpu": ("gpu",)}.get(name, ())
            keys = [k for k in THRESHOLDS if k.startswith(tuple(f"{u}_" for u in used))]
            if keys:
                df = df.join(thresholds.select("node_id", *[F.col(k).alias(f"_t_{k}") for k in keys]), "node_id", "left")
            t = lambda key: f"coalesce(_t_{key}, {default_threshold(key)})"
        if name == "system":
            df = df.withColumn("_worst", worst_disk("disks"))
        rows = df.select("node_id", "ts", F.explode(fired(name, t)).alias("f")).select(
            "node_id", "ts", "f.*", F.lit(name).alias("collector"))
        out = rows if out is None else out.unionByName(rows)
    return out


def types_not_fired(fired: Column) -> Column:
    """The types a payload resolves: all payload types but the fired ones."""
    return F.array_except(F.array(*[F.lit(t) for t in PAYLOAD_TYPES]), fired)


def offline_now(nodes: DataFrame, as_of: Column, minutes: int = OFFLINE_MINUTES) -> DataFrame:
    """node_offline firings of the batch check."""
    rows = nodes.filter(~online("last_seen", as_of, minutes))
    return rows.select(
        "node_id", as_of.alias("ts"), F.lit("node_offline").alias("alert_type"), F.lit("critical").alias("severity"),
        F.concat(F.lit("No heartbeat from "), "hostname", F.lit(f" for >{minutes} minutes")).alias("message"))


def offline_episodes(samples: DataFrame, as_of: Column, minutes: int = OFFLINE_MINUTES,
                     check_seconds: int = CHECK_SECONDS, slot_seconds: int = 3600) -> DataFrame:
    """node_offline episodes of the whole history, as a check every `check_seconds` would have raised them.

    A silence opens an episode at the first check that is `minutes` or more after the last sample and
    still before the next one, and closes it at the first check after that next sample.
    """
    tick = check_seconds * 1_000_000
    seen = samples.groupBy("node_id", "ts").agg(F.lit(0).alias("z")).select("node_id", "ts")
    rows = with_neighbours(seen, ["node_id"], "ts", ["ts"], lag=False, lead=True, slot_seconds=slot_seconds)
    up = lambda us: F.ceil(us / F.lit(float(tick))) * F.lit(tick)
    opened = up(micros("ts") + F.lit(minutes * 60_000_000))
    closed = up(micros("next_ts"))
    stamp = lambda us: F.timestamp_micros(us.cast("bigint")).cast("timestamp_ntz")
    late = F.coalesce(opened < micros("next_ts"), opened <= micros(as_of))
    done = F.when(closed <= micros(as_of), stamp(closed))
    return rows.filter(late).select(
        "node_id", F.lit("node_offline").alias("alert_type"), F.lit("critical").alias("severity"),
        stamp(opened).alias("created_at"), F.col("ts").alias("last_seen"), done.alias("resolved_at"))
