"""Raw JSON lines to bronze tables, for batch and streaming DataFrames alike.

`raw` has one JSON document per row in `value` (spark.read.text / readStream.text). Nothing is grouped
or shuffled on the way in, so a source that sends a third of all lines costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import LEVELS, sanitise_hostname

PAYLOAD = "lab_id STRING, node_id STRING, hostname STRING, timestamp STRING, collectors MAP<STRING, VARIANT>"
LOG_PUSH = (
    "lab_id STRING, node_id STRING, "
    "entries ARRAY<STRUCT<ts STRING, source STRING, level STRING, message STRING, unit STRING>>"
)
MESSAGE_LIMIT = 4096  # fixed value: stored log messages are at most this long


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    return raw.select(F.from_json("value", schema).alias("p"), *[c for c in raw.columns if c != "value"])


def whole_payloads(raw: DataFrame, arrived_at: Column | None = None) -> DataFrame:
    """(node_id, ts, hostname, collectors): a row per payload that names its sender, with event time as land_payloads has it."""
    arrived = F.current_timestamp() if arrived_at is None else arrived_at
    sent = F.coalesce(F.try_to_timestamp(F.col("p.timestamp")), arrived)
    sender = F.coalesce("p.node_id", "p.lab_id")
    # As in land_payloads: a filter would be pushed below the projection and parse every line again, once for each of its fields.
    whole = F.when(sender.isNotNull() & F.col("p.collectors").isNotNull(), F.array("p.collectors"))
    return _parsed(raw, PAYLOAD).select(sender.alias("node_id"), sent.cast("timestamp").alias("ts"), F.col("p.hostname").alias("hostname"),
                                        F.explode(whole).alias("collectors"))


def land_payloads(raw: DataFrame, arrived_at: Column | None = None) -> DataFrame:
    """metrics(node_id, ts, metric_type, data VARIANT, hostname, ingested_at): a row per payload and collector.

    Event time is kept and arrival time stored beside it; a payload without a time takes the arrival time.
    """
    arrived = F.current_timestamp() if arrived_at is None else arrived_at
    rest = [c for c in raw.columns if c != "value"]
    ts = F.coalesce(F.try_to_timestamp(F.col("p.timestamp")), arrived)
    sender = F.coalesce("p.node_id", "p.lab_id")
    # A filter on the sender would be pushed below the projection and parse every line a second time;
    # without a sender there is nothing to explode.
    return _parsed(raw, PAYLOAD).select(
        sender.alias("node_id"),
        ts.cast("timestamp").alias("ts"),
        F.col("p.hostname").alias("hostname"),
        arrived.cast("timestamp").alias("ingested_at"),
        *rest,
        F.explode(F.when(sender.isNotNull(), F.col("p.collectors"))).alias("metric_type", "data"),
    )


def normalise_level(level) -> Column:
    lv = F.lower(level)
    return F.when(lv.isin(*LEVELS), lv).otherwise("info")


def normalise_logs(df: DataFrame, arrived: str | Column = "arrived_at") -> DataFrame:
    """Defaults and limits applied to log rows that carry ts, source, level, message."""
    arrived = F.col(arrived) if isinstance(arrived, str) else arrived
    return df.withColumns({
        "ts": F.coalesce(F.col("ts"), arrived),
        "source": F.coalesce(F.col("source"), F.lit("unknown")),
        "level": normalise_level(F.col("level")),
        "message": F.left(F.coalesce(F.col("message"), F.lit("")), F.lit(MESSAGE_LIMIT)),
    })


def land_logs(raw: DataFrame, arrived_at: Column | None = None) -> DataFrame:
    """logs(node_id, ts, source, level, message, unit, arrived_at): a row per pushed entry."""
    arrived = (F.current_timestamp() if arrived_at is None else arrived_at).cast("timestamp")
    sender = F.coalesce("p.node_id", "p.lab_id")
    rows = (
        _parsed(raw, LOG_PUSH)
        .select(sender.alias("node_id"), arrived.alias("arrived_at"),
                F.explode(F.when(sender.isNotNull(), F.col("p.entries"))).alias("e"))
        .select("node_id", "arrived_at", F.try_to_timestamp(F.col("e.ts")).cast("timestamp").alias("ts"),
                "e.source", "e.level", "e.message", "e.unit")
    )
    return normalise_logs(rows)


def node_registry(registrations: DataFrame, samples: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """Registrations with cleaned host names and last_seen moved on by every metric or log batch.

    The facts are reduced to one row per node (partial aggregation) before they meet the registry.
    """
    seen = samples.groupBy("node_id").agg(F.max("ts").alias("seen_at"))
    if logs is not None:
        seen = (
            seen.unionByName(logs.groupBy("node_id").agg(F.max("ts").alias("seen_at")))
            .groupBy("node_id").agg(F.max("seen_at").alias("seen_at"))
        )
    old = [c for c in registrations.columns if c not in ("hostname", "last_seen")]
    last_seen = F.col("seen_at")
    if "last_seen" in registrations.columns:
        last_seen = F.greatest("seen_at", "last_seen")
    return registrations.join(seen, "node_id", "left").select(
        *old, sanitise_hostname("hostname").alias("hostname"), last_seen.alias("last_seen"))
