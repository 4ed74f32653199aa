"""Streaming jobs over the given tables, drained to a table. The SQL states the batch result."""

from pyspark.sql import functions as F

from ..sources import sinks
from ..sources import testbed as T
from ..streaming import jobs
from ..streaming.runner import drain, new_path
from .alerts import ALL, EPISODES, FIRE_CUSTOM, FIRE_DEFAULT, thresholds
from .base import query
from .metrics import RATES


def samples(spark, d):
    s = T.system_samples(spark, d, T.event_stream(spark, d))
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def plain(df):
    """Times without zone, as in the given tables."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query("stream_landing", """SELECT node_id, ts, unnest(['system'] || CASE event_type WHEN 'click' THEN ['docker'] WHEN 'signup' THEN ['services'] WHEN 'view' THEN ['gpu']
    WHEN 'purchase' THEN ['smart', 'zfs'] ELSE [] END) AS metric_type FROM e""")
def _(spark, d):
    """Every payload is delivered twice and lands once."""
    path = new_path(spark, "payloads")
    lines = T.payload_lines(spark, d)
    lines.select(F.explode(F.array_repeat("value", 2)).alias("value")).write.option("compression", "gzip").text(path)
    landed = jobs.landing_stream(spark.readStream.text(path), T.as_of().cast("timestamp"))
    once = jobs.drop_redelivered(landed.select("node_id", "ts", "metric_type"), ("node_id", "ts", "metric_type"), late="60 days")
    return plain(drain(once, "landing"))


CHANGES = """SELECT node_id, alert_type, 'opened' AS event, created_at AS at, created_at, severity, notify FROM ep WHERE created_at <= {wm} UNION ALL
    SELECT node_id, alert_type, 'resolved', resolved_at, created_at, severity, notify FROM ep WHERE resolved_at <= {wm}"""
WM = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM s)"
CHANGES = CHANGES.format(wm=WM)


@query("stream_sessions", f"""WITH f AS (SELECT node_id, ts, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY ts) AS g
        FROM (SELECT node_id, ts, lag(ts) OVER (PARTITION BY node_id ORDER BY ts) AS p FROM s))
    SELECT node_id, min(ts) AS start, max(ts) AS "end", count(*) AS samples FROM f GROUP BY node_id, g HAVING max(ts) + INTERVAL 12 HOUR <= {WM}""")
def _(spark, d):
    return plain(drain(jobs.uptime_sessions(samples(spark, d), "12 hours"), "sessions"))


@query("stream_summaries", f"""SELECT node_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS sample_count, max(cpu_percent) AS cpu_max, min(memory_percent) AS memory_min,
    floor(avg(disk_percent) * 100 + 0.5) / 100 AS disk_avg FROM s GROUP BY 1, 2 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= {WM}""")
def _(spark, d):
    out = plain(drain(jobs.summaries(samples(spark, d), "1 day"), "summaries"))
    avg = F.floor(F.col("disk_avg") * 100 + 0.5) / 100
    return out.select("node_id", "start", "sample_count", "cpu_max", "memory_min", avg.alias("disk_avg"))


@query("stream_rate_limits", f"""WITH w AS (SELECT node_id, CAST(time_bucket(INTERVAL 6 HOUR, ts) AS TIMESTAMP) - to_hours(i * 6) AS start FROM s, (SELECT unnest([0, 1, 2, 3]) AS i))
    SELECT node_id, start, start + INTERVAL 24 HOUR AS "end", count(*) AS attempts, count(*) > 5 AS over_limit FROM w GROUP BY 1, 2 HAVING start + INTERVAL 24 HOUR <= {WM}""")
def _(spark, d):
    return plain(drain(jobs.sliding_attempts(samples(spark, d).select("node_id", "ts"), "node_id", "24 hours", "6 hours"), "attempts"))


@query("stream_rates", f"WITH {RATES} SELECT node_id, ts, least(rx_mbps, 1000) AS rx_mbps, least(tx_mbps, 1000) AS tx_mbps FROM r3 WHERE ts <= {WM}")
def _(spark, d):
    """Rows come out once the watermark has passed them."""
    jobs.use_rocksdb(spark)
    return plain(drain(jobs.counter_rates(samples(spark, d)), "rates"))


@query("stream_episodes", f"""WITH {FIRE_DEFAULT.replace('f0 AS (', 'fa AS (')}, f0 AS (SELECT * FROM fa WHERE collector = 'system'), {EPISODES.format(cool='900000000', **ALL)}
    {CHANGES}""")
def _(spark, d):
    jobs.use_rocksdb(spark)
    return plain(drain(jobs.episode_stream(jobs.system_cycle_firings(samples(spark, d))), "episodes")).drop("message")


@query("stream_offline", f"""WITH g AS (SELECT node_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY node_id ORDER BY ts) AS nx FROM (SELECT DISTINCT node_id, ts FROM s)),
    o AS (SELECT *, CAST(ceil((us + 43200000000) / 120000000.0) AS BIGINT) * 120000000 AS op, CAST(ceil(nx / 120000000.0) AS BIGINT) * 120000000 AS cl FROM g),
    k AS (SELECT * FROM o WHERE op <= epoch_us({WM}) AND coalesce(op < nx, true))
    SELECT node_id, 'opened' AS event, make_timestamp(op) AS at, make_timestamp(op) AS created_at FROM k UNION ALL
    SELECT node_id, 'resolved', make_timestamp(cl), make_timestamp(op) FROM k WHERE nx <= epoch_us({WM})""")
def _(spark, d):
    """No payload fires anything here; a node counts as offline after 12 hours."""
    jobs.use_rocksdb(spark)
    none = F.expr("array()").cast("array<struct<alert_type:string,severity:string,message:string>>")
    rows = samples(spark, d).select("node_id", "ts", none.alias("fired"))
    return plain(drain(jobs.episode_stream(rows, offline_minutes=720), "offline")).select("node_id", "event", "at", "created_at")


FIRE_PAYLOADS = FIRE_CUSTOM.replace("WHERE load1 > cpu_count * 2", "WHERE load1 > cpu_count * 2 AND sample_id % 4 <> 3")  # one payload in four has no load
PAYLOAD_EPISODES = f"{FIRE_PAYLOADS}, {EPISODES.format(cool='86400000000', **ALL)}"


def payloads(spark, d):
    """All raw lines as a file stream."""
    path = new_path(spark, "lines")
    T.payload_lines(spark, d).write.text(path)
    return jobs.payload_stream(spark.readStream.option("maxFilesPerTrigger", 1000).text(path), T.as_of().cast("timestamp"))


def payload_parts(spark, d, parts: int, path: str):
    """All raw lines in `parts` folders under path in the order of time, one after the other, each from many tasks; yields after each.

    The lines are built once and written once, compressed and dealt out by time; a part then comes as one move of its folder.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    samples = T.system_samples(spark, d).select(us.alias("us"))
    cuts = samples.agg(F.percentile_approx("us", [k / parts for k in range(1, parts)], 1000).alias("q")).first()["q"] or []
    part = sum([(us > cut).cast("int") for cut in cuts], F.lit(0))
    lines = T.payload_lines(spark, d, keep=("ts",)).filter("value IS NOT NULL").select("value", part.alias("part"))
    staged = new_path(spark, "staged-lines")
    lines.write.option("compression", "lz4").partitionBy("part").text(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(path))
    for i in range(len(cuts) + 1):
        ready, to = hadoop(f"{staged}/part={i}"), hadoop(f"{path}/part{i}")
        if not fs.exists(ready):
            spark.createDataFrame([], "value STRING").coalesce(1).write.text(to.toString())  # no line in this part
        elif not fs.rename(ready, to):
            raise OSError(f"{ready.toString()} was not moved to {to.toString()}")
        yield i


def fired_table(spark, path):
    """The table that fire_batches writes, as a stream."""
    return spark.readStream.schema(f"node_id STRING, ts TIMESTAMP, fired {jobs.FIRED}").parquet(path).select("node_id", "ts", "fired")


def fired_payloads(spark, d):
    """What the payloads fire by the nodes' own thresholds, as a stream over the table that the first job writes."""
    path = new_path(spark, "fired")
    jobs.fire_batches(payloads(spark, d), lambda: thresholds(spark, d), path, path + "-checkpoint").awaitTermination()
    return fired_table(spark, path)


@query("stream_firings_custom", f"WITH {FIRE_PAYLOADS} SELECT node_id, ts, alert_type, severity, message FROM f0")
def _(spark, d):
    """Rules of all five collectors on raw payloads, with own thresholds."""
    path = new_path(spark, "fired")
    jobs.fire_batches(payloads(spark, d), lambda: thresholds(spark, d), path, path + "-checkpoint").awaitTermination()
    rows = spark.read.schema(f"node_id STRING, ts TIMESTAMP, fired {jobs.FIRED}").parquet(path)
    return plain(rows.select("node_id", "ts", F.explode("fired").alias("f")).select("node_id", "ts", "f.*"))


@query("stream_episodes_custom", f"WITH {PAYLOAD_EPISODES} {CHANGES}")
def _(spark, d):
    """Raw payloads to episode changes: own thresholds, a cooldown of a day."""
    jobs.use_rocksdb(spark)
    return plain(drain(jobs.episode_stream(fired_payloads(spark, d), cooldown_minutes=1440), "episodes")).drop("message")


@query("episodes_upsert", f"""WITH {PAYLOAD_EPISODES} SELECT node_id, alert_type, severity, created_at, CASE WHEN resolved_at <= {WM} THEN resolved_at END AS resolved_at, notify
    FROM ep WHERE created_at <= {WM}""")
def _(spark, d):
    """The same changes in three triggers, merged batch by batch into the episode table."""
    jobs.use_rocksdb(spark)
    path, fired, lines = (new_path(spark, name) for name in ("episode-table", "fired", "lines"))
    for _ in payload_parts(spark, d, 3, lines):
        raw = jobs.payload_stream(spark.readStream.text(f"{lines}/part*"), T.as_of().cast("timestamp"))
        jobs.fire_batches(raw, lambda: thresholds(spark, d), fired, fired + "-checkpoint").awaitTermination()
        changes = jobs.episode_stream(fired_table(spark, fired), cooldown_minutes=1440)
        sinks.merge_episode_stream(changes, path, path + "-checkpoint").awaitTermination()
    return plain(sinks.stored_episodes(spark, path).select("node_id", "alert_type", "severity", "created_at", "resolved_at", "notify"))
