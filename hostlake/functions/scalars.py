"""Column functions shared by the jobs. Everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("debug", "info", "warn", "error")


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column."""
    return F.unix_micros(as_col(c).cast("timestamp"))


def round_to(c, digits: int) -> Column:
    """Round half up with plain double arithmetic, so that every engine agrees on it."""
    scale = float(10**digits)
    return F.floor(as_col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ts_lit(value: str, like: str = "timestamp_ntz") -> Column:
    return F.lit(value).cast(like)


def shift(ts: Column, **units) -> Column:
    """ts moved by hours / minutes / seconds (negative moves back)."""
    return ts + F.make_dt_interval(
        F.lit(units.get("days", 0)), F.lit(units.get("hours", 0)), F.lit(units.get("minutes", 0)),
        F.lit(units.get("seconds", 0)).cast("decimal(18,6)"),
    )


def online(last_seen, as_of: Column, minutes: int = 5) -> Column:
    """Seen strictly less than `minutes` before as_of; never seen means offline."""
    return F.coalesce(micros(as_of) - micros(last_seen) < F.lit(minutes * 60_000_000), F.lit(False))


def format_uptime(seconds) -> Column:
    s = as_col(seconds).cast("bigint")
    days, hours, mins = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(s.isNull() | (s <= 0), F.lit("unknown"))
        .when(days > 0, F.concat(days, F.lit("d "), hours, F.lit("h")))
        .when(hours > 0, F.concat(hours, F.lit("h "), mins, F.lit("m")))
        .otherwise(F.concat(mins, F.lit("m")))
    )


def metric_band(v) -> Column:
    v = as_col(v)
    return (
        F.when(v >= 90, "critical").when(v >= 80, "high").when(v >= 60, "moderate").otherwise("healthy")
    )


def temp_band(v) -> Column:
    v = as_col(v)
    return F.when(v >= 90, "critical").when(v >= 80, "concerning").otherwise("normal")


def until_relative(ends_at, as_of: Column) -> Column:
    ends = as_col(ends_at)
    mins = ((micros(ends) - micros(as_of)) / 60_000_000).cast("bigint")
    return (
        F.when(ends.isNull(), "no end time")
        .when(mins <= 0, "expired")
        .when(mins < 60, F.concat(mins, F.lit("m left")))
        .when(mins < 1440, F.concat(F.floor(mins / 60), F.lit("h "), mins % 60, F.lit("m left")))
        .otherwise(F.concat(F.floor(mins / 1440), F.lit("d left")))
    )


def last_seen_ago(last_seen, as_of: Column) -> Column:
    """'N min ago' under an hour, 'N h ago' under a day, else 'N d ago' (whole units)."""
    secs = (micros(as_of) - micros(last_seen)) / 1_000_000
    return (
        F.when(as_col(last_seen).isNull(), "never")
        .when(secs < 3600, F.concat(F.floor(secs / 60), F.lit(" min ago")))
        .when(secs < 86400, F.concat(F.floor(secs / 3600), F.lit(" h ago")))
        .otherwise(F.concat(F.floor(secs / 86400), F.lit(" d ago")))
    )


def bytes_to_gb(c) -> Column:
    return as_col(c) / F.lit(1073741824.0)


def mib_to_bytes(c) -> Column:
    c = as_col(c)
    return F.when(c > 0, (c * 1048576).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


# Channel settings that hold credentials.
SECRET_KEYS = ("token", "bot_token", "api_token", "user_key", "webhook_url", "url", "secret")


def redact_config(config) -> Column:
    """MAP<STRING,STRING> with secret values longer than 4 cut to first 4 ... last 2."""
    return F.transform_values(
        as_col(config),
        lambda k, v: F.when(
            k.isin(*SECRET_KEYS) & (F.length(v) > 4),
            F.concat(F.left(v, F.lit(4)), F.lit("..."), F.right(v, F.lit(2))),
        ).otherwise(v),
    )


def sanitise_hostname(c, default: str = "my-server") -> Column:
    kept = F.left(F.regexp_replace(as_col(c), "[^a-zA-Z0-9._-]", ""), F.lit(64))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def clean_email(c) -> Column:
    return F.lower(F.trim(as_col(c)))


def valid_email(c) -> Column:
    return as_col(c).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def infer_level(message) -> Column:
    """Log level by the first group of words found anywhere in the whole message."""
    m = F.lower(as_col(message))

    def has(*words):
        return F.coalesce(m.rlike("|".join(words)), F.lit(False))

    return (
        F.when(has("error", "fatal", "panic", "crit"), "error")
        .when(has("warn"), "warn")
        .when(has("debug", "trace"), "debug")
        .otherwise("info")
    )


def priority_to_level(priority) -> Column:
    p = as_col(priority).cast("string")
    return F.when(p.isin("0", "1", "2", "3"), "error").when(p == "4", "warn").when(p == "7", "debug").otherwise("info")


def level_rank(level) -> Column:
    lv = F.lower(as_col(level))
    return (
        F.when(lv == "debug", 0)
        .when(lv.isin("warn", "warning"), 2)
        .when(lv.isin("error", "fatal", "critical"), 3)
        .otherwise(1)
    )


def severity_rank(severity) -> Column:
    s = as_col(severity)
    return F.when(s == "critical", 2).when(s == "warning", 1).otherwise(0)


def escape_label(c) -> Column:
    """Backslash, double quote and newline escaped as in text exposition labels."""
    c = F.replace(as_col(c), F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit('"'), F.lit('\\"'))
    return F.replace(c, F.lit("\n"), F.lit("\\n"))
