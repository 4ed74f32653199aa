"""Time-ordered derivations: uptime, sparklines, counter rates, spike removal, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import micros, round_to, shift
from .latest import recent_samples
from .ordered import SLOT_SECONDS, with_neighbours, with_position
from .selection import window_since


def metrics_history(metrics: DataFrame, hours: int, as_of: Column, limit: int | None = None) -> DataFrame:
    """Rows of the window, newest first; hours held within one year."""
    rows = window_since(metrics, max(1, min(hours, 8760)), as_of).orderBy(F.desc("ts"), F.desc("sample_id"))
    return rows if limit is None else rows.limit(limit)


def uptime_segments(samples: DataFrame, nodes: DataFrame, as_of: Column, hours: int = 24,
                    gap_seconds: int = 180) -> DataFrame:
    """Online and offline stretches (node_id, start, end, status) of every registered node.

    Two samples in one bucket as wide as the gap can never be separated by more than the gap, so first
    and last time per bucket are enough. That partial aggregate bounds a node's rows by window / gap
    whatever its sample count; the per-node window only sees those.
    """
    gap = gap_seconds * 1_000_000
    opened = shift(as_of, hours=-hours)
    inside = samples.filter((F.col("ts") > opened) & (F.col("ts") <= as_of))
    buckets = inside.groupBy("node_id", F.floor(micros("ts") / F.lit(float(gap))).alias("b")).agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    buckets = buckets.join(nodes.select("node_id"), "node_id", "left_semi")
    w = Window.partitionBy("node_id").orderBy("b")
    apart = F.coalesce(micros("lo") - micros(F.lag("hi").over(w)) > gap, F.lit(True))
    islands = (
        buckets.withColumn("new", apart.cast("int")).withColumn("island", F.sum("new").over(w))
        .groupBy("node_id", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    wi = Window.partitionBy("node_id").orderBy("island")
    islands = islands.withColumns({"before": F.lag("hi").over(wi), "after": F.lead("lo").over(wi)})

    def seg(start, end, status):
        return F.struct(start.alias("start"), end.alias("end"), F.lit(status).alias("status"))

    lo, hi, before, last = F.col("lo"), F.col("hi"), F.col("before"), F.col("after").isNull()
    late = micros(lo) - micros(opened) > gap
    silent = micros(as_of) - micros(hi) > gap
    pieces = F.array_compact(F.array(
        F.when(before.isNotNull(), seg(before, lo, "offline")).when(late, seg(opened, lo, "offline")),
        seg(lo, F.when(last & ~silent, as_of).otherwise(hi), "online"),
        F.when(last & silent, seg(hi, as_of, "offline"))))
    found = islands.select("node_id", F.explode(pieces).alias("s")).select("node_id", "s.*")
    empty = nodes.select("node_id").join(buckets.select("node_id").distinct(), "node_id", "left_anti")
    return found.unionByName(empty.select("node_id", seg(opened, as_of, "offline").alias("s")).select("node_id", "s.*"))


def sparkline(samples: DataFrame, metric: str, as_of: Column, hours: int = 1, points: int = 30,
              slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """At most `points` readings per node: with n of them, those at positions floor(i * n / points)."""
    rows = window_since(samples, hours, as_of).filter(F.col(metric).isNotNull()).select(
        "node_id", "ts", "sample_id", round_to(metric, 1).alias("value"))
    ranked = with_position(rows, ["node_id"], "ts", "sample_id", slot_seconds)
    step = F.col("group_size") / F.lit(float(points))
    guess = F.floor(F.col("pos") / step)
    hit = F.lit(False)
    for i in (guess, guess + 1):
        hit = hit | ((i < points) & (F.floor(i * step) == F.col("pos")))
    return ranked.filter((F.col("group_size") <= points) | hit).select("node_id", "ts", "value")


def _moved(field: str) -> Column:
    """Bytes moved since the previous sample over all interfaces but the loopback; resets count as 0.

    An interface without a previous reading counts from 0; of repeated names the last reading is used.
    """
    def one(n):
        before = F.filter("prev_network", lambda p: p["interface"] == n["interface"])
        prior = F.coalesce(F.get(before, F.size(before) - 1)[field], F.lit(0))
        return F.greatest(F.lit(0).cast("bigint"), F.coalesce(n[field], F.lit(0)) - prior)

    real = F.filter("network", lambda n: n["interface"] != "lo")
    return F.coalesce(F.aggregate(real, F.lit(0).cast("bigint"), lambda a, n: a + one(n)), F.lit(0).cast("bigint"))


def _rates(rows: DataFrame, clamp: float | None, keep: tuple[str, ...] = ()) -> DataFrame:
    seconds = (micros("ts") - micros("prev_ts")) / F.lit(1_000_000.0)
    known = F.coalesce("prev_network", F.expr("array()").cast(rows.schema["network"].dataType))
    rows = rows.withColumn("prev_network", known)
    out = {}
    for name, field in (("rx_mbps", "bytes_recv"), ("tx_mbps", "bytes_sent")):
        rate = round_to(_moved(field) * F.lit(8) / seconds / F.lit(1_000_000.0), 2)
        if clamp is not None:
            rate = F.least(rate, F.lit(float(clamp)))
        out[name] = F.when(seconds > 0, rate).otherwise(0.0)
    return rows.withColumns(out).select("node_id", "ts", "sample_id", *keep, "rx_mbps", "tx_mbps")


def network_rates(samples: DataFrame, clamp: float | None = 1000.0, slot_seconds: int = SLOT_SECONDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mbit/s per sample against the node's previous sample, 0 for the first. `keep`: further columns of the sample that stay."""
    rows = with_neighbours(samples.select("node_id", "ts", "sample_id", "network", *keep), ["node_id"], "ts",
                           ["ts", "network"], tie="sample_id", slot_seconds=slot_seconds)
    return _rates(rows, clamp, keep)


def latest_network_rates(samples: DataFrame, clamp: float | None = None) -> DataFrame:
    """Current rate of each node from its two newest samples; nodes with one sample give no row."""
    two = recent_samples(samples.select("node_id", "ts", "sample_id", "network"), 2)
    pair = two.groupBy("node_id").agg(*[
        F.max(F.when(F.col("rn") == rn, F.col(c))).alias(out)
        for rn, prefix in ((1, ""), (2, "prev_"))
        for c, out in (("ts", prefix + "ts"), ("sample_id", prefix + "sample_id"))],
        F.max_by(F.col("network"), F.when(F.col("rn") == 1, 1)).alias("network"),
        F.max_by(F.col("network"), F.when(F.col("rn") == 2, 1)).alias("prev_network"))
    return _rates(pair.filter("prev_ts < ts"), clamp)


BUCKETS_PER_E = 256  # a bucket of the first step is 0.4 % wide


def upper_medians(rows: DataFrame, columns: tuple[str, ...], least: int = 3) -> DataFrame:
    """(node_id, m_<column>): sorted[n div 2] of a node's values over 0, null with fewer than `least` of them.

    No buffer holds a node's values. Counts by logarithmic bucket say which bucket has the middle place and which place it is in
    there; a node has at most BUCKETS_PER_E times 1,490 buckets, whatever its rows. Only that bucket's values are
    looked at again: equal ones are counted together, and a running count in their order stops at the place. NaN counts as no value.
    """
    group = ["node_id", "_series"]
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("_series"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)]))
    values = rows.select("node_id", one.alias("_x")).select("node_id", "_x.*").filter("_v > 0 and not isnan(_v)")
    # infinite values are a bucket of their own, the last one
    values = values.withColumn("_bucket", F.when(F.col("_v") < float("inf"), F.floor(F.log("_v") * BUCKETS_PER_E)).otherwise(1 << 40))

    def place(counts: DataFrame, order: str) -> DataFrame:
        upto = F.sum("_n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return counts.withColumn("_before", upto - F.col("_n"))

    counts = values.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    middle = F.expr("_total div 2")
    chosen = (
        place(counts, "_bucket").withColumn("_total", F.sum("_n").over(Window.partitionBy(*group)))
        .filter((F.col("_total") >= least) & (F.col("_before") <= middle) & (middle < F.col("_before") + F.col("_n")))
        .select(*group, "_bucket", (middle - F.col("_before")).alias("_place")))
    inside = values.join(chosen, [*group, "_bucket"]).groupBy(*group, "_place", "_v").agg(F.count(F.lit(1)).alias("_n"))
    found = place(inside, "_v").filter((F.col("_before") <= F.col("_place")) & (F.col("_place") < F.col("_before") + F.col("_n")))
    return found.groupBy("node_id").agg(*[F.max(F.when(F.col("_series") == i, F.col("_v"))).alias(f"m_{c}") for i, c in enumerate(columns)])


def spike_filter(rates: DataFrame, columns: tuple[str, ...] = ("rx_mbps", "tx_mbps")) -> DataFrame:
    """Values over ten times the node's upper median of non-zero values (at least 100) become 0. Needs three non-zero values."""
    out = rates.join(upper_medians(rates, columns), "node_id", "left")
    for c in columns:
        spike = F.col(f"m_{c}").isNotNull() & (F.col(c) > F.greatest(F.col(f"m_{c}") * 10, F.lit(100.0)))
        out = out.withColumn(c, F.when(spike, 0.0).otherwise(F.col(c)))
    return out.select(*rates.columns)


def history_series(samples: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Aligned chart series per node: load figures with 0 for missing, and cleaned network rates."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    s = window_since(samples, max(1, min(hours, 8760)), as_of)
    figures = {"cpu": "cpu_percent", "memory": "memory_percent", "disk": "disk_percent", "load": "load1"}
    s = s.select("node_id", "ts", "sample_id", "network", *[zero(c).alias(name) for name, c in figures.items()])
    return spike_filter(network_rates(s, keep=tuple(figures))).select(
        "node_id", "ts", *figures, F.col("rx_mbps").alias("net_rx"), F.col("tx_mbps").alias("net_tx"))


def gpu_history(gpu: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """First device of each GPU sample in the window."""
    dev = F.get("devices", F.lit(0))
    zero = lambda c: F.coalesce(dev[c], F.lit(0.0))
    return window_since(gpu, max(1, min(hours, 8760)), as_of).filter(F.size("devices") > 0).select(
        "node_id", "ts", zero("utilization_percent").alias("gpu_utilization"),
        zero("memory_used_percent").alias("gpu_memory"), zero("temperature_celsius").alias("gpu_temperature"))


def disk_growth(summary: DataFrame, hours: int = 168) -> DataFrame:
    """Growth of the first disk over the period and days until it is full, when it grew by over 5."""
    growth = F.col("disk_max") - F.col("disk_min")
    days = (F.lit(100.0) - F.col("disk_current")) / (growth / F.lit(hours / 24.0))
    return summary.filter((F.col("disk_avg") > 0) & (growth > 5)).select(
        "node_id", round_to(growth, 2).alias("growth"), round_to(days, 0).alias("days_to_full"))


def restart_leaders(containers: DataFrame, limit: int | None = 10) -> DataFrame:
    """Containers that restarted, most restarts first."""
    rows = containers.filter(F.col("restart_count") > 0).orderBy(F.desc("restart_count"), "node_id", "name")
    return rows if limit is None else rows.limit(limit)
