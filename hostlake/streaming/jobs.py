"""Structured Streaming jobs: landing, sessions, summaries, rate limits, rates, episodes, offline check.

Each takes a streaming DataFrame and returns one; sinks and triggers are the caller's. All are also run
in tests against their batch twins on the same rows. Late data: a watermark of ten minutes by default.

Rows wait in aggregation state until the watermark has passed them; the two stateful processors then go through them in order. Backfills
over long histories belong to the batch operators, which cut hot nodes into time slots.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import silver
from ..operators.accounts import THRESHOLDS
from ..operators.rules import default_threshold, fired
from ..operators.silver import worst_disk
from ..sources.landing import land_payloads, whole_payloads

LATE = "10 minutes"


def landing_stream(raw: DataFrame, arrived_at: Column | None = None) -> DataFrame:
    """Raw JSON lines to bronze rows; stateless."""
    return land_payloads(raw, arrived_at)


def drop_redelivered(payloads: DataFrame, keys: tuple[str, ...] = ("node_id", "ts"), ts: str = "ts",
                     late: str = LATE) -> DataFrame:
    """Payloads that an agent sent again after a failed request are dropped while their time is in the watermark.

    The key holds the time, so a busy node's rows are spread over all state partitions.
    """
    return payloads.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def uptime_sessions(samples: DataFrame, gap: str = "3 minutes", late: str = LATE) -> DataFrame:
    """Closed online stretches; the session ends `gap` after its last sample, as batch islands do.

    The session merge happens on partial sessions before the shuffle
    (spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition), so a hot node sends sessions, not samples.
    """
    return (
        samples.withWatermark("ts", late)
        .groupBy("node_id", F.session_window("ts", gap).alias("w"))
        .agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("samples"))
        .drop("w"))


def summaries(samples: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Tumbling statistics per node; partial aggregates before the shuffle."""
    aggs = [F.count(F.lit(1)).alias("sample_count")]
    for name, c in (("cpu", "cpu_percent"), ("memory", "memory_percent"), ("disk", "disk_percent"), ("load", "load1")):
        aggs += [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.avg(c).alias(f"{name}_avg")]
    return (
        samples.withWatermark("ts", late).groupBy("node_id", F.window("ts", width).alias("w")).agg(*aggs)
        .withColumns({"start": F.col("w.start"), "end": F.col("w.end")}).drop("w"))


def sliding_attempts(attempts: DataFrame, key: str, width: str = "1 hour", step: str = "5 minutes",
                     allowed: int = 5, late: str = LATE) -> DataFrame:
    """Attempts per key in sliding windows and whether the key was over its limit."""
    return (
        attempts.withWatermark("ts", late).groupBy(key, F.window("ts", width, step).alias("w"))
        .agg(F.count(F.lit(1)).alias("attempts"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "attempts",
                (F.col("attempts") > allowed).alias("over_limit")))


# ---- rules on the stream ---------------------------------------------------------------------------

FIRED = "ARRAY<STRUCT<alert_type: STRING, severity: STRING, message: STRING>>"


def cycle_firings(cycles: DataFrame, firings: DataFrame) -> DataFrame:
    """(node_id, ts, fired ARRAY): what each payload fired, for the episode stream. For batch inputs."""
    item = F.struct("alert_type", "severity", "message")
    fired = firings.groupBy("node_id", "ts").agg(F.collect_list(item).alias("fired"))
    none = F.expr("array()").cast(fired.schema["fired"].dataType)
    return cycles.select("node_id", "ts").join(fired, ["node_id", "ts"], "left").select(
        "node_id", "ts", F.coalesce("fired", none).alias("fired"))


def _short(firings: Column) -> Column:
    """What the episode stream needs of each firing."""
    return F.transform(firings, lambda f: F.struct(*[f[c].alias(c) for c in ("alert_type", "severity", "message")])).cast(FIRED)


def system_cycle_firings(samples: DataFrame) -> DataFrame:
    """The same from a stream of system samples alone: stateless, evaluated in the sample's own row."""
    rows = samples.withColumn("_worst", worst_disk("disks"))
    return rows.select("node_id", "ts", _short(fired("system")).alias("fired"))


PROJECTIONS = {"system": silver.system_samples, "docker": silver.docker_samples, "services": silver.service_samples,
               "gpu": silver.gpu_samples, "smart": silver.smart_samples}


def at_time(versions: DataFrame, key: str = "node_id", since: str = "valid_from") -> DataFrame:
    """(key, versions ARRAY): all versions of a key's settings in one row, newest first. A key has few: they are set by hand."""
    values = [c for c in versions.columns if c not in (key, since)]
    item = F.struct(F.col(since).cast("timestamp").alias("since"), *values)
    return versions.groupBy(key).agg(F.sort_array(F.collect_list(item), asc=False).alias("versions"))


def _limits(collector: str) -> list[str]:
    """The thresholds that the rules of a collector read."""
    read: list[str] = []
    fired(collector, lambda k: read.append(k) or default_threshold(k))
    return read


def payload_firings(payloads: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """(node_id, ts, fired ARRAY) of whole payloads (node_id, ts, collectors MAP<STRING, VARIANT>), batch or stream.

    The rules of all five collectors are evaluated in the payload's own row: nothing is exploded or grouped. Rules that read no threshold
    are evaluated before the payloads meet the thresholds; of the others only the typed values go into that join. `thresholds`
    has a row for each node, or with a valid_from column a row for each version of its settings; a payload is held against the newest
    version at or before its time, so that the result doesn't depend on when a payload is read. Nodes without one use
    the defaults. A collector that a payload lacks fires nothing.
    """
    rows, known = payloads.select("node_id", F.col("ts").cast("timestamp").alias("ts"), "collectors"), ["node_id", "ts", "collectors"]
    by_limits = [] if thresholds is None else [name for name in PROJECTIONS if _limits(name)]
    columns: dict[str, list[str]] = {}
    for name, project in PROJECTIONS.items():
        one = project(rows.withColumn("data", F.col("collectors")[name]))
        if name == "system":
            one = one.withColumn("_worst", worst_disk("disks"))
        if name in by_limits:  # typed values here, the rules after the join
            columns[name] = [c for c in one.columns if c not in known]
            rows = one.select(*known, *[F.col(c).alias(f"_{name}_{c}") for c in columns[name]])
            known += [f"_{name}_{c}" for c in columns[name]]
        else:
            rows = one.select(*known, _short(fired(name)).alias(f"_{name}"))
            known.append(f"_{name}")
    if thresholds is not None:
        rows = rows.drop("collectors")
        if "valid_from" in thresholds.columns:
            rows = rows.join(at_time(thresholds), "node_id", "left").withColumn(
                "_t", F.get(F.filter("versions", lambda v: v["since"] <= F.col("ts")), F.lit(0))).drop("versions")
        else:
            keys = [k for k in THRESHOLDS if k in thresholds.columns]
            rows = rows.join(thresholds.select("node_id", F.struct(*keys).alias("_t")), "node_id", "left")
        given = set(thresholds.columns)
        threshold = lambda k: f"coalesce(_t.{k}, {default_threshold(k)})" if k in given else default_threshold(k)
        for name in by_limits:
            one = rows.withColumns({c: F.col(f"_{name}_{c}") for c in columns[name]})
            rows = one.withColumn(f"_{name}", _short(fired(name, threshold))).drop(*columns[name], *[f"_{name}_{c}" for c in columns[name]])
    none = F.expr("array()").cast(FIRED)
    return rows.select("node_id", "ts", F.concat(*[F.coalesce(F.col(f"_{name}"), none) for name in PROJECTIONS]).alias("fired"))


def payload_stream(raw: DataFrame, arrived_at: Column | None = None) -> DataFrame:
    """Raw JSON lines to whole payloads; stateless."""
    return whole_payloads(raw, arrived_at)


def fire_batches(payloads: DataFrame, thresholds: Callable[[], DataFrame | None], path: str, checkpoint: str) -> StreamingQuery:
    """Rules on a stream of payloads against a threshold table that changes: it is read anew for each micro-batch.

    What a batch fires goes to its own folder under `path`, which a replay of the batch writes over. The episode stream reads
    that table.
    """
    def fire(batch: DataFrame, batch_id: int) -> None:
        payload_firings(batch, thresholds()).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return payloads.writeStream.foreachBatch(fire).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- keyed state ---------------------------------------------------------------------------------

RATE_ROWS = "node_id STRING, ts TIMESTAMP, rx_mbps DOUBLE, tx_mbps DOUBLE"
CHUNK = 50_000  # result rows put together at a time
BUCKETS = 4096  # state keys of the processors; the nodes are spread over them


def released(rows: DataFrame, c: str, late: str) -> DataFrame:
    """(node_id, ts, us, items): the values of c of each node and time as a JSON array, once the watermark has passed the time.

    Rows wait in Spark's own aggregation state under (node_id, ts): no row can come any more for a time that is released, a trigger
    releases only times after those of the triggers before it, and a busy node's rows are spread over all state partitions. What waits
    is what the allowed lateness spans.
    """
    waiting = rows.filter("ts IS NOT NULL").withWatermark("ts", late).groupBy("node_id", "ts").agg(F.array_sort(F.collect_list(F.struct(c))).alias("items"))
    return waiting.select("node_id", "ts", F.unix_micros("ts").alias("us"), F.to_json("items").alias("items"))


def by_bucket(rows: DataFrame):
    """Released rows grouped by the state key of their node. A bucket and not a node is a key: what Spark does for each key of a Python
    processor (frames, Arrow batches, calls to the state server) takes longer than the few rows that a node has in a trigger. BUCKETS must
    not change during the life of a checkpoint."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.lit(BUCKETS)).cast("int")).groupBy("bucket")


class InOrder(StatefulProcessor):
    """Released rows of each node of a key handled in the order of their time; between triggers a key is one JSON text with a small state
    for each of its nodes, read and written once. Rows in a frame without node_id are of the node that the key names.

    Subclasses say what a new node remembers (`new`) and what the rows of one time do (`step`).
    """

    columns: list[str]
    times: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state STRING")

    def _read(self) -> tuple[dict, int | None]:
        """The nodes of the key with what they remember, and the key's timer."""
        held = self.held.get()
        now = json.loads(held[0]) if held else {"nodes": [], "armed": None}
        return dict(now["nodes"]), now["armed"]

    def _write(self, nodes: dict, armed: int | None) -> None:
        self.held.update((json.dumps({"nodes": list(nodes.items()), "armed": armed}),))  # pairs: a node may be null

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (nodes, armed), given, out = self._read(), {}, []
        for frame in rows:
            names = frame["node_id"].tolist() if "node_id" in frame else [key[0]] * len(frame)
            for node, us, items in zip(names, frame["us"].tolist(), frame["items"].tolist()):
                given.setdefault(node, []).append((us, items))
        for node, released_rows in given.items():
            now = nodes[node] if node in nodes else nodes.setdefault(node, self.new())
            for us, items in sorted(released_rows, key=lambda row: row[0]):
                self.step(now, node, us, json.loads(items), out)
                if len(out) >= CHUNK:
                    yield self._frame(out)
                    out = []
        self._write(nodes, self.after(nodes, armed, timerValues, out))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (nodes, _), out = self._read(), []
        self._write(nodes, self.after(nodes, None, timerValues, out))
        if out:
            yield self._frame(out)

    def after(self, nodes: dict, armed: int | None, timerValues, out: list) -> int | None:
        """What is due without a row; returns the key's timer."""
        return armed

    def close(self) -> None:
        pass

    def _frame(self, out: list) -> pd.DataFrame:
        columns = dict(zip(self.columns, map(list, zip(*out))))
        return pd.DataFrame(columns | {c: (np.array(columns[c], np.int64) * 1000).view("datetime64[ns]") for c in self.times})


class CounterRates(InOrder):
    """Mbit/s of each sample against the node's previous one. A key remembers the counters of its last sample."""

    columns, times = ["node_id", "ts", "rx_mbps", "tx_mbps"], ("ts",)

    def __init__(self, clamp: float | None = 1000.0):
        self.clamp = clamp

    def new(self) -> dict:
        return {"us": None, "network": []}

    def step(self, now: dict, node: str, us: int, items: list, out: list) -> None:
        for item in items:
            before, net = now["us"], [(n.get("interface"), n["rx"], n["tx"]) for n in item["network"]]
            cur, prev = {n[0]: n[1:] for n in net}, {n[0]: n[1:] for n in now["network"]}
            rx = tx = 0.0
            if before is not None and us > before:
                seconds = (us - before) / 1e6
                moved = [[max(0, c[i] - prev.get(name, (0, 0))[i]) for name, c in cur.items() if name != "lo"] for i in (0, 1)]
                rx, tx = (int(sum(m) * 8 / seconds / 1e6 * 100 + 0.5) / 100 for m in moved)
                if self.clamp is not None:
                    rx, tx = min(rx, self.clamp), min(tx, self.clamp)
            out.append((node, us, rx, tx))
            now["us"], now["network"] = us, net


def counter_rates(samples: DataFrame, clamp: float | None = 1000.0, late: str = LATE) -> DataFrame:
    """Rates of samples that arrive in any order within `late`. Needs the RocksDB state store."""
    zero = F.lit(0).cast("bigint")
    net = F.transform(F.coalesce("network", F.expr("array()").cast(samples.schema["network"].dataType)), lambda n: F.struct(
        n["interface"].alias("interface"), F.coalesce(n["bytes_recv"], zero).alias("rx"), F.coalesce(n["bytes_sent"], zero).alias("tx")))
    rows = samples.select("node_id", F.col("ts").cast("timestamp").alias("ts"), net.alias("network"))
    return by_bucket(released(rows, "network", late)).transformWithStateInPandas(
        statefulProcessor=CounterRates(clamp), outputStructType=RATE_ROWS, outputMode="append", timeMode="EventTime")


EPISODE_ROWS = ("node_id STRING, alert_type STRING, event STRING, at TIMESTAMP, created_at TIMESTAMP, severity STRING, "
                "message STRING, notify BOOLEAN")


class Episodes(InOrder):
    """Open episodes and last resolve times of a node, keyed by alert type; emits opened and resolved events.

    Rows of one time are one payload, in whatever triggers they come. With offline_minutes set, node_offline opens at the first
    check that finds no payload for that long and closes at the first check after the next payload, as the batch operator has
    it: checks are every check_seconds of event time. Silences between rows are seen when the later row is released, the last one by a timeout.
    """

    columns = ["node_id", "alert_type", "event", "at", "created_at", "severity", "message", "notify"]
    times = ("at", "created_at")

    def __init__(self, cooldown_minutes: int = 15, offline_minutes: int | None = None, check_seconds: int = 120):
        self.tick = check_seconds * 1_000_000
        self.cooldown = cooldown_minutes * 60_000_000
        self.offline = None if offline_minutes is None else offline_minutes * 60_000_000

    def new(self) -> dict:
        return {"seen": None, "open": {}, "resolved": {}}

    def _opened(self, now, node, kind, at, severity, message):
        resolved = now["resolved"].get(kind)
        notify = resolved is None or resolved <= at - self.cooldown
        now["open"][kind] = (at, severity, message, notify)
        return (node, kind, "opened", at, at, severity, message, notify)

    def _closed(self, now, node, kind, at):
        created, severity, message, notify = now["open"].pop(kind)
        now["resolved"][kind] = at
        return (node, kind, "resolved", at, created, severity, message, notify)

    def _check(self, at: int) -> int:
        """The first check at or after a time."""
        return -(-at // self.tick) * self.tick

    @staticmethod
    def _merged(tied: list) -> dict:
        """The firings of rows of one time by alert type; of differing ones of a type the smallest, as in the batch operator."""
        now = {}
        fired = [tuple(f.get(c) for c in ("alert_type", "severity", "message")) for item in tied for f in item["fired"]]
        for f in sorted(fired, key=lambda f: [(x is not None, x or "") for x in f]):
            now.setdefault(f[0], f)
        return now

    def _silence(self, node: str) -> tuple:
        return "critical", f"No heartbeat from {node} for >{self.offline // 60_000_000} minutes"

    def step(self, now: dict, node: str, us: int, items: list, out: list) -> None:
        fires, last = self._merged(items), now["seen"]
        if self.offline is not None and last is not None:
            opens = self._check(last + self.offline)
            if opens < us and "node_offline" not in now["open"]:
                out.append(self._opened(now, node, "node_offline", opens, *self._silence(node)))
            if "node_offline" in now["open"]:
                out.append(self._closed(now, node, "node_offline", self._check(us)))
        now["seen"] = us
        for kind in sorted(now["open"].keys() - fires.keys()):
            out.append(self._closed(now, node, kind, us))
        for kind, (_, severity, message) in sorted(fires.items()):
            if kind in now["open"]:
                created, first, _, notify = now["open"][kind]
                now["open"][kind] = (created, first, message, notify)
            else:
                out.append(self._opened(now, node, kind, us, severity, message))

    def after(self, nodes: dict, armed: int | None, timerValues, out: list) -> int | None:
        if self.offline is None:
            return armed
        end, due = timerValues.getCurrentWatermarkInMs() * 1000, []
        for node, now in nodes.items():
            at = self._check(now["seen"] + self.offline)
            if at > end:
                due.append(at)
            elif "node_offline" not in now["open"]:
                out.append(self._opened(now, node, "node_offline", at, *self._silence(node)))
        timer = -(-min(due) // 1000) if due else None
        if timer != armed:  # one timer a key, for its first node to fall silent
            if armed is not None:
                self.handle.deleteTimer(armed)
            if timer is not None:
                self.handle.registerTimer(timer)
        return timer


def episode_stream(cycle_rows: DataFrame, cooldown_minutes: int = 15, offline_minutes: int | None = None,
                   late: str = LATE) -> DataFrame:
    """Opened and resolved events from (node_id, ts, fired) rows that arrive in any order within `late`; a payload counts once the
    watermark has passed it. Needs the RocksDB state store."""
    none = F.expr("array()").cast(FIRED)
    rows = cycle_rows.select("node_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(_short(F.col("fired")), none).alias("fired"))
    return by_bucket(released(rows, "fired", late)).transformWithStateInPandas(
        statefulProcessor=Episodes(cooldown_minutes, offline_minutes), outputStructType=EPISODE_ROWS, outputMode="append",
        timeMode="EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State on local disk with changelog checkpoints, so state size is not bound to the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
