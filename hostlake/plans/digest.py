"""Graded health digests, per node and for the fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import round_to
from ..operators.aggregates import metrics_summary


def node_digests(summary: DataFrame, nodes: DataFrame, hours: int = 168) -> DataFrame:
    """Opener class, bands, concerns, highlights and grade of every registered node ('?' without samples)."""
    s = nodes.select("node_id", "hostname").join(summary, "node_id", "left")
    c = F.col
    none = F.coalesce(c("sample_count"), F.lit(0)) == 0
    active = F.greatest(c("alerts_total") - c("alerts_resolved"), F.lit(0))
    growth = c("disk_max") - c("disk_min")
    on = {m: c(f"{m}_avg") > 0 for m in ("cpu", "memory", "disk", "load")}
    concerns = F.array_compact(F.array(
        F.when(on["cpu"] & (c("cpu_max") > 90), "cpu_peak"),
        F.when(on["memory"] & (c("memory_avg") > 85), "memory_high").when(on["memory"] & (c("memory_avg") > 70), "memory_warm"),
        F.when(on["disk"] & (growth > 5), "disk_growth"),
        F.when(on["disk"] & (c("disk_current") > 90), "disk_critical").when(on["disk"] & (c("disk_current") > 80), "disk_warning"),
        F.when(on["load"] & (c("load_avg") > 10), "load_high")))
    highlights = F.array_compact(F.array(
        F.when(on["cpu"] & (c("cpu_avg") < 5), "cpu_idle"), F.when(c("alerts_total") == 0, "no_alerts")))
    opener = (
        F.when((c("cpu_avg") < 5) & (c("memory_avg") < 40) & (c("load_avg") < 5) & (active == 0), "quiet")
        .when((c("load_avg") > 20) & (c("cpu_avg") < 20), "io_pressure").when(c("cpu_avg") > 70, "hard_working")
        .when(active > 2, "needs_attention").when(c("disk_current") > 80, "tight_storage").otherwise("steady"))
    spread = F.abs(c("memory_max") - c("memory_min"))
    n = F.size(c("concerns"))
    days = round_to((F.lit(100.0) - c("disk_current")) / (F.nullif(growth, F.lit(0.0)) / F.lit(hours / 24.0)), 0)
    return s.withColumns({"concerns": concerns, "highlights": highlights}).select(
        "node_id", "hostname", F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        F.when(none, "?").when(n >= 3, "C").when(n == 2, "B-").when(n == 1, "B+").otherwise("A").alias("grade"),
        F.when(~none, opener).alias("opener"),
        F.when(on["cpu"], F.when(c("cpu_avg") < 10, "idle").when(c("cpu_avg") < 50, "moderate")
               .when(c("cpu_avg") < 80, "heavy").otherwise("critical")).alias("cpu_band"),
        F.when(on["memory"], F.when(spread < 5, "stable").when(spread < 20, "fluctuating").otherwise("volatile")).alias("memory_band"),
        F.when(on["disk"] & (growth > 5), days).alias("days_to_full"),
        F.when(none, F.lit(0)).otherwise(n).alias("concern_count"),
        F.when(none, "").otherwise(F.array_join("concerns", ",")).alias("concerns"),
        F.when(none, "").otherwise(F.array_join("highlights", ",")).alias("highlights"))


def build_node_digests(samples: DataFrame, alerts: DataFrame, nodes: DataFrame, as_of: Column, hours: int = 168) -> DataFrame:
    return node_digests(metrics_summary(samples, alerts, as_of, hours), nodes, hours)


def fleet_digest(digests: DataFrame) -> DataFrame:
    """One row: nodes by grade class and all concerns counted. The concern list is digests itself."""
    return digests.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("grade").isin("A", "B+")).alias("healthy"),
        F.count_if(F.col("grade") == "B-").alias("fair"), F.count_if(F.col("grade").isin("C", "D", "F")).alias("poor"),
        F.sum("concern_count").alias("concerns"))


def fleet_concerns(digests: DataFrame) -> DataFrame:
    """One row per node and concern."""
    return digests.filter("concern_count > 0").select("node_id", "hostname", F.explode(F.split("concerns", ",")).alias("concern"))


def digest_rows(digests: DataFrame, as_of: Column, hours: int = 168) -> DataFrame:
    """Digest table rows with their period, for store_digests."""
    from ..functions.scalars import shift

    return digests.select("node_id", shift(as_of, hours=-hours).alias("period_start"), as_of.alias("period_end"),
                          "grade", F.to_json(F.struct(*[c for c in digests.columns if c != "node_id"])).alias("data"),
                          as_of.alias("created_at"))
