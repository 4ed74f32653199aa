"""Alert episodes: open, update, resolve and cooldown from per-payload firings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import micros
from .ordered import SLOT_SECONDS, with_neighbours

COOLDOWN_MINUTES = 15


def alert_episodes(
    firings: DataFrame,
    cycles: DataFrame,
    keys: tuple[str, ...] = ("node_id",),
    cooldown_minutes: int = COOLDOWN_MINUTES,
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """One row per episode: node_id, alert_type, severity, created_at, message, value, last_fired_at,
    resolved_at (null while active) and notify.

    `cycles` are all payloads (keys, ts), fired or not: a payload that does not fire a type resolves it.
    With keys ("node_id", "collector") only payloads of the same collector do.

    Severity and start stay those of the first firing, message and value follow the last. An episode is
    announced unless the previous one of the same node and type was resolved less than the cooldown ago.

    A firing starts an episode when the previous payload did not fire its type and ends it when the next
    does not; only these boundary rows are kept, so a type that fires for a year is two rows. Both
    neighbour steps are cut into time slots, so no node is ever gathered in one task.
    """
    keys = list(keys)
    item = F.struct("alert_type", "severity", "message", "value")
    # copies of a payload collapse in the partial set; of differing firings of one type one is kept
    fired = firings.groupBy(*keys, "ts").agg(F.array_sort(F.collect_set(item)).alias("fired"))
    fired = fired.withColumn("fired", F.filter("fired", lambda x, i: ~F.exists(
        F.slice("fired", F.lit(1), i), lambda y: y["alert_type"] == x["alert_type"])))
    none = F.expr("array()").cast(fired.schema["fired"].dataType)
    rows = (
        cycles.select(*keys, "ts").distinct().join(fired, [*keys, "ts"], "left")
        .withColumn("fired", F.coalesce("fired", none))
        .withColumn("types", F.transform("fired", lambda f: f["alert_type"])))
    rows = with_neighbours(rows, keys, "ts", ["ts", "types"], lead=True, slot_seconds=slot_seconds)

    def missing(types: str) -> Column:
        return F.coalesce(~F.array_contains(F.col(types), F.col("alert_type")), F.lit(True))

    edges = (
        rows.select(*keys, "ts", "prev_types", "next_types", "next_ts", F.explode("fired").alias("f"))
        .select(*keys, "ts", "next_ts", "f.*", "prev_types", "next_types")
        .withColumns({"starts": missing("prev_types"), "ends": missing("next_types")})
        .filter("starts or ends")
        .withColumn("resolved_at", F.when(F.col("ends"), F.col("next_ts")))
        .select(*keys, "alert_type", "ts", "severity", "message", "value", "starts", "ends", "resolved_at"))
    edges = with_neighbours(edges, [*keys, "alert_type"], "ts", ["ts", "message", "value", "resolved_at"],
                            lead=True, slot_seconds=slot_seconds * 24)

    def at_end(c: str) -> Column:
        return F.when(F.col("ends"), F.col(c)).otherwise(F.col(f"next_{c}"))

    quiet_since = micros("ts") - F.lit(cooldown_minutes * 60_000_000)
    return edges.filter("starts").select(
        *keys, "alert_type", "severity", F.col("ts").alias("created_at"),
        at_end("message").alias("message"), at_end("value").alias("value"), at_end("ts").alias("last_fired_at"),
        at_end("resolved_at").alias("resolved_at"),
        F.coalesce(micros("prev_resolved_at") <= quiet_since, F.lit(True)).alias("notify"))


def with_cooldown(episodes: DataFrame, cooldown_minutes: int = COOLDOWN_MINUTES,
                  slot_seconds: int = SLOT_SECONDS * 24) -> DataFrame:
    """Adds notify to episodes that came from elsewhere, e.g. the offline check."""
    rows = with_neighbours(episodes, ["node_id", "alert_type"], "created_at", ["resolved_at"],
                           slot_seconds=slot_seconds)
    quiet_since = micros("created_at") - F.lit(cooldown_minutes * 60_000_000)
    return rows.withColumn("notify", F.coalesce(micros("prev_resolved_at") <= quiet_since, F.lit(True))).drop(
        "prev_resolved_at")
