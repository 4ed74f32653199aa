"""The given star-schema tables seen as fleet telemetry (views for checks and benchmarks).

Every view reads whole tables. One event is one payload of node n<user_id>; its numbers come from the
event's value, props.k and ids. Line items are container rows of supplier nodes, customers are the
node registry and its owners, nations the owning accounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.latest import latest_row

AS_OF = "2024-01-31 00:00:00"
ONLINE_MINUTES = 720
GB = 1073741824


# Column types of the given tables, so that opening one needs no schema job.
SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def event_stream(spark, sf_dir) -> DataFrame:
    """The events table as a file stream."""
    return spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def newest_events(spark, sf_dir, event_type: str | None = None) -> DataFrame:
    """Each node's newest event, or newest of one type: picked on the raw rows, before payloads are built."""
    e = table(spark, sf_dir, "events")
    if event_type is not None:
        e = e.filter(F.col("event_type") == event_type)
    return latest_row(e, ["user_id"], ["ts", "event_id"])


def newest(spark, sf_dir, what: str) -> DataFrame:
    """Newest sample per node of a collector."""
    kind, samples = {
        "system": (None, system_samples), "docker": ("click", docker_samples), "gpu": ("view", gpu_samples),
        "smart": ("purchase", smart_samples), "zfs": ("purchase", zfs_samples)}[what]
    return samples(spark, sf_dir, newest_events(spark, sf_dir, kind))


def _base(spark, sf_dir, events: DataFrame | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events") if events is None else events
    return e.selectExpr(
        "concat('n', user_id) AS node_id", "ts", "event_id AS sample_id", "event_type", "value", "user_id AS u",
        "cast(get_json_object(props, '$.k') AS BIGINT) AS k", "props")


def system_samples(spark, sf_dir, events: DataFrame | None = None) -> DataFrame:
    d0, d1, gb = "(k * 37 + u) % 101", "(k * 53 + u * 7) % 101", "1073741824"

    def disk(mount, dev, used, size):
        return (f"named_struct('mountpoint', '{mount}', 'device', '{dev}', 'used_percent', cast({used} AS DOUBLE), "
                f"'total_bytes', {size} * {gb}, 'free_bytes', {size} * {gb} div 101 * (101 - {used}))")

    def nic(name, recv, sent):
        return f"named_struct('interface', '{name}', 'bytes_recv', {recv}, 'bytes_sent', {sent})"

    eth0 = nic("eth0", "k * 7500000 + sample_id * 1000", "k * 1250000 + sample_id * 10")
    eth1 = nic("eth1", "(99 - k) * 1000000", "(99 - k) * 500000")
    lo = nic("lo", "sample_id * 1000000", "sample_id * 1000000")
    return _base(spark, sf_dir, events).selectExpr(
        "node_id", "ts", "sample_id", "cast(null AS STRING) AS hostname", "least(value, 100D) AS cpu_percent",
        "cast(u % 8 + 1 AS INT) AS cpu_count", "cast(k AS DOUBLE) AS memory_percent",
        f"(u % 5 + 4) * {gb} AS memory_total_bytes", f"(u % 5 + 4) * {gb} div 100 * k AS memory_used_bytes",
        f"array({disk('/', '/dev/sda1', d0, '(u + 100)')}, {disk('/data', '/dev/sdb1', d1, '(u + 200)')}) AS disks",
        f"cast({d0} AS DOUBLE) AS disk_percent", "value / 10 AS load1", "value / 20 AS load5", "value / 40 AS load15",
        "k * 3600 + sample_id % 5000 AS uptime_seconds",
        f"IF(k % 3 = 0, array({eth0}, {eth1}, {lo}), array({eth0}, {lo})) AS network",
        "array(named_struct('label', 'package', 'value', cast(k % 70 + 30 AS DOUBLE))) AS temperatures")


def docker_samples(spark, sf_dir, events: DataFrame | None = None) -> DataFrame:
    def container(i: int) -> str:
        return (
            f"named_struct('id', concat('c{i}-', u), 'name', concat('svc', (k + {i}) % 7), 'image', 'img', "
            f"'state', IF((k + {i}) % 3 <> 0, 'running', 'exited'), 'status', '', "
            f"'restart_count', cast(k * {i + 1} % 6 AS INT), 'cpu_percent', cast(k * {i + 2} % 101 AS DOUBLE), "
            f"'memory_usage_bytes', (k + 1) * {i + 1} * 1048576, 'memory_limit_bytes', 1073741824L)")

    return _base(spark, sf_dir, events).filter("event_type = 'click'").selectExpr(
        "node_id", "ts", "sample_id", f"array({container(0)}, {container(1)}, {container(2)}) AS containers")


def service_samples(spark, sf_dir, events: DataFrame | None = None) -> DataFrame:
    return _base(spark, sf_dir, events).filter("event_type = 'signup'").selectExpr(
        "node_id", "ts", "sample_id",
        "array(named_struct('name', 'web', 'healthy', k % 5 <> 0), named_struct('name', 'db', 'healthy', k % 7 <> 0)) AS services")


def gpu_samples(spark, sf_dir, events: DataFrame | None = None) -> DataFrame:
    def device(i: int) -> str:
        pct, part = f"(k * {5 + i} % 101)", 8 * GB // 101
        return (
            f"named_struct('index', {i}, 'name', 'GPU-{i}', 'utilization_percent', cast(k * {3 + i} % 101 AS DOUBLE), "
            f"'memory_total_bytes', {8 * GB}L, 'memory_used_bytes', {part} * {pct}, 'memory_free_bytes', {part} * (101 - {pct}), "
            f"'memory_used_percent', cast({pct} AS DOUBLE), 'temperature_celsius', cast(k % 60 + 40 - {i} AS DOUBLE), "
            f"'power_watts', cast(k + 50 AS DOUBLE), 'power_limit_watts', 250D, 'fan_speed_percent', cast(k % 100 AS DOUBLE))")

    return _base(spark, sf_dir, events).filter("event_type = 'view'").selectExpr(
        "node_id", "ts", "sample_id", f"IF(u % 2 = 0, array({device(0)}, {device(1)}), array({device(0)})) AS devices")


def smart_samples(spark, sf_dir, events: DataFrame | None = None) -> DataFrame:
    return _base(spark, sf_dir, events).filter("event_type = 'purchase'").selectExpr(
        "node_id", "ts", "sample_id",
        "array(named_struct('device', 'sda', 'model', 'DISK', 'healthy', IF(k % 10 = 1, null, k % 10 <> 0), "
        "'temperature_c', cast(k % 40 + 35 AS DOUBLE), 'power_on_hours', k * 100, "
        "'reallocated_sector_ct', greatest(k - 90, 0), 'error', IF(k % 13 = 0, 'timeout', null))) AS devices")


def zfs_samples(spark, sf_dir, events: DataFrame | None = None) -> DataFrame:
    return _base(spark, sf_dir, events).filter("event_type = 'purchase'").selectExpr(
        "node_id", "ts", "sample_id",
        "array(named_struct('name', 'tank', 'used_percent', cast(k * 11 % 101 AS DOUBLE), "
        "'health', IF(k % 6 <> 0, 'ONLINE', 'DEGRADED'))) AS pools")


def payload_lines(spark, sf_dir, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same telemetry as raw JSON lines, as an agent would post them; load in three shapes. `keep`: columns of the samples beside the line."""
    sys = system_samples(spark, sf_dir)
    rot = F.col("sample_id") % 4
    inner = {"ignoreNullFields": "true"}
    load = (
        F.when(rot == 0, F.to_json(F.struct(F.col("load1"), F.col("load5"), F.col("load15"))))
        .when(rot == 1, F.to_json(F.array("load1", "load5", "load15")))
        .when(rot == 2, F.col("load1").cast("string"))
        .otherwise(F.lit("null"))
    )
    body = F.to_json(F.struct(
        F.struct(F.col("cpu_count").alias("count"), F.col("cpu_percent").alias("total_percent")).alias("cpu"),
        F.struct(F.col("memory_percent").alias("used_percent"), F.col("memory_total_bytes").alias("total_bytes"),
                 F.col("memory_used_bytes").alias("used_bytes")).alias("memory"),
        F.col("disks").alias("disk"), "network", "uptime_seconds",
        F.transform("temperatures", lambda t: F.struct(
            t["label"].alias("sensor_key"), t["value"].alias("temperature_celsius"))).alias("temperatures"),
    ), inner)
    sys_json = F.concat(F.expr("left({0}, length({0}) - 1)".format("body")), F.lit(',"load_average":'), load, F.lit("}"))
    sys = sys.withColumn("body", body).select("node_id", "ts", "sample_id", *[c for c in keep if c not in ("node_id", "ts", "sample_id")], sys_json.alias("sys_json"))

    def extra(df, name, column, wrap):
        j = F.to_json(F.struct(F.col(column).alias(column)), inner) if wrap else F.to_json(F.col(column), inner)
        return df.select(F.col("sample_id"), F.concat(F.lit(f',"{name}":'), j).alias("more"))

    more = (
        extra(docker_samples(spark, sf_dir), "docker", "containers", True)
        .unionByName(extra(service_samples(spark, sf_dir), "services", "services", False))
        .unionByName(extra(smart_samples(spark, sf_dir), "smart", "devices", True))
        .unionByName(extra(zfs_samples(spark, sf_dir), "zfs", "pools", True))
        .unionByName(extra(gpu_samples(spark, sf_dir).withColumn("devices", F.transform("devices", lambda g: g.withField(
            "memory", F.struct(*[g[f"memory_{c}"].alias(c) for c in ("total_bytes", "used_bytes", "free_bytes", "used_percent")])).dropFields(
            *[f"memory_{c}" for c in ("total_bytes", "used_bytes", "free_bytes", "used_percent")]))), "gpu", "devices", True))
        .groupBy("sample_id").agg(F.concat_ws("", F.sort_array(F.collect_list("more"))).alias("more"))
    )
    joined = sys.join(more, "sample_id", "left")
    return joined.select(F.concat(
        F.lit('{"lab_id":"'), F.col("node_id"), F.lit('","hostname":"h","timestamp":"'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z","collectors":{"system":'),
        F.col("sys_json"), F.coalesce(F.col("more"), F.lit("")), F.lit("}}")).alias("value"), *keep)


def registrations(spark, sf_dir) -> DataFrame:
    """Registered nodes; customers in debt were removed, so their samples are orphans."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    key, nat = F.col("c_custkey"), F.col("c_nationkey")
    return c.select(
        F.concat(F.lit("n"), key).alias("node_id"),
        F.concat(F.lower("c_mktsegment"), F.lit("-"), key).alias("hostname"),
        F.element_at(F.array(F.lit("linux"), F.lit("freebsd"), F.lit("darwin")), (nat % 3 + 1).cast("int")).alias("os"),
        F.when(nat % 2 == 0, "amd64").otherwise("arm64").alias("arch"),
        F.concat(F.lit("0."), nat % 4).alias("agent_version"),
        (F.lit("2023-01-01").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), key.cast("int"))).alias("registered_at"),
    )


def nodes(spark, sf_dir) -> DataFrame:
    """Registry with last_seen taken from the samples (rows of the fact pre-aggregated per node)."""
    seen = _base(spark, sf_dir).groupBy("node_id").agg(F.max("ts").alias("last_seen"))
    return registrations(spark, sf_dir).join(seen, "node_id", "left")


def ownership(spark, sf_dir) -> DataFrame:
    """Which account registered which node on which plan ('gold' is unknown, some have none)."""
    seg = F.col("c_mktsegment")
    plan = (F.when(seg == "BUILDING", "pro").when(seg == "MACHINERY", "business")
            .when(seg == "HOUSEHOLD", "gold").when(seg == "FURNITURE", "free"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("acct"), F.col("c_nationkey")).alias("account"),
        F.concat(F.lit("n"), F.col("c_custkey")).alias("node_id"),
        plan.alias("plan"),
        (F.lit("2023-01-01").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.col("c_custkey").cast("int"))).alias("created_at"),
        F.concat(F.lit("10.0.0."), F.col("c_nationkey")).alias("ip_address"),
    )


def preferences(spark, sf_dir) -> DataFrame:
    """Threshold settings: one per account (node_id null), and per node for rich customers."""
    n = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("acct"), F.col("n_nationkey")).alias("account"),
        F.lit(None).cast("string").alias("node_id"),
        F.create_map(F.lit("cpu_warning"), (F.col("n_nationkey") + 60).cast("double"),
                     F.lit("disk_critical"), (F.col("n_nationkey") + 75).cast("double")).alias("data"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(
        F.concat(F.lit("acct"), F.col("c_nationkey")).alias("account"),
        F.concat(F.lit("n"), F.col("c_custkey")).alias("node_id"),
        F.create_map(F.lit("cpu_warning"), (F.col("c_nationkey") + 40).cast("double"),
                     F.lit("memory_warning"), F.lit(50.0)).alias("data"))
    return n.unionByName(c)


def alerts(spark, sf_dir) -> DataFrame:
    """A small alert history: every error event is one alert."""
    k = F.col("k")
    return _base(spark, sf_dir).filter("event_type = 'error'").select(
        F.col("sample_id").alias("alert_id"), "node_id",
        F.element_at(F.array(*map(F.lit, ["cpu_high", "memory_high", "disk_critical", "service_failed", "gpu_temp_high"])),
                     (k % 5 + 1).cast("int")).alias("alert_type"),
        F.when(k % 4 == 0, "critical").when(k % 4 == 1, "info").otherwise("warning").alias("severity"),
        F.concat(F.lit("alert "), F.col("sample_id")).alias("message"),
        F.col("ts").alias("created_at"),
        F.when(k >= 30, F.col("ts") + F.make_dt_interval(F.lit(0), k.cast("int"))).alias("resolved_at"),
    )


def raw_logs(spark, sf_dir) -> DataFrame:
    """One log entry per event, before normalisation."""
    et, v = F.col("event_type"), F.col("value")
    return _base(spark, sf_dir).select(
        F.col("sample_id").alias("log_id"), "node_id",
        F.when(F.col("k") != 0, F.col("ts")).alias("ts"),
        F.col("ts").alias("arrived_at"),
        F.when(F.col("k") % 10 != 9, F.concat(F.lit("svc"), F.col("u") % 7)).alias("source"),
        F.when(et == "error", "ERROR").when(v > 100, "Warn").when(et == "purchase", "debug")
        .when(et == "view", "notice").alias("level"),
        F.concat(et, F.lit(" "), F.col("props")).alias("message"),
        F.lit(None).cast("string").alias("unit"),
    )


def channels(spark, sf_dir) -> DataFrame:
    """Notification channels: regions are admin channels, nations belong to their account."""
    sev = lambda key: F.when(key % 3 == 0, "info").when(key % 3 == 1, "warning").otherwise("critical")
    r = table(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey")).alias("channel_id"), F.col("r_name").alias("name"),
        F.lit("webhook").alias("channel_type"), (F.col("r_regionkey") != 2).alias("enabled"),
        sev(F.col("r_regionkey")).alias("min_severity"), F.lit(None).cast("string").alias("owner"))
    n = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("u"), F.col("n_nationkey")).alias("channel_id"), F.col("n_name").alias("name"),
        F.lit("ntfy").alias("channel_type"), (F.col("n_regionkey") != 1).alias("enabled"),
        sev(F.col("n_nationkey")).alias("min_severity"),
        F.concat(F.lit("acct"), F.col("n_nationkey")).alias("owner"))
    return r.unionByName(n)


def maintenance(spark, sf_dir) -> DataFrame:
    """Maintenance windows, one per urgent or high order, started on the order's day shifted to 2024."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    start = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (key % 720).cast("int"))
    return o.filter("o_orderpriority in ('1-URGENT', '2-HIGH')").select(
        F.concat(F.lit("n"), F.col("o_custkey")).alias("node_id"),
        F.col("o_orderpriority").alias("reason"), start.alias("started_at"),
        F.when(F.col("o_orderstatus") != "P", start + F.make_dt_interval(F.lit(0), (key % 96).cast("int"))).alias("ends_at"),
        (F.col("o_orderstatus") != "F").alias("enabled"))


def container_rows(spark, sf_dir) -> DataFrame:
    """Line items as container rows: a supplier is a host, a month is one sample of it."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("node_id"),
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.concat_ws("-", F.lit("p"), F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")).alias("name"),
        F.when(F.col("l_linestatus") == "O", "running").otherwise("exited").alias("state"),
        F.col("l_linenumber").alias("restart_count"),
        (F.col("l_discount") * 1000).alias("cpu_percent"),
        F.col("l_extendedprice").alias("memory_usage_bytes"))


def container_counters(spark, sf_dir) -> DataFrame:
    """Cumulative counters per container: a part run by a supplier, read at each shipment."""
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    return li.select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("node_id"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("container"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"),
        F.floor(price * 100).alias("total_usage"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("system_usage"),
        (F.col("l_linenumber") % 3).cast("int").alias("online_cpus"),
        (F.col("l_linenumber") % 2).cast("int").alias("percpu_count"),
        F.lit(4).alias("host_cpus"),
        F.floor(price).alias("memory_usage"),
        F.when(F.col("l_returnflag") == "A", F.floor(price / 2)).alias("cache"),
        F.when(F.col("l_returnflag") != "A", F.floor(price * F.col("l_quantity") / 20)).alias("inactive_file"),
        F.lit(1000000).cast("bigint").alias("memory_limit"))


def processes(spark, sf_dir) -> DataFrame:
    """Line items as processes seen in one sample (order) of one host (supplier)."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("node_id"), F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pid"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("name"), F.col("l_extendedprice").alias("cpu_percent"))


# Phrasings a user types, %h is a host name and %n a number.
PHRASES = (
    "Show me all alerts", "Which server uses the most CPU?", "Why is %h slow?", "status of %h",
    "What happened in the last %n hours?", "how much disk space do I have", "recent error logs",
    "fleet summary", "gpu status", "are my drives healthy", "list nodes", "network usage",
    "show containers on %h", "how hot is %h", "what needs attention?", "how do i add a node",
    "what's the weather", "hello", "/alerts active", "alert me when CPU exceeds %n%",
    "critical disk %n", "memry usage for the past %n days", "stautus of %h", "what happened last night",
    "anything happen yesterday", "last %n minutes", "wie ist der status", "gpu mem %n", "temperature %n load %n",
    "which container is restarting", "compare %h vs db", "xyzzy %n",
)


def questions(spark, sf_dir) -> DataFrame:
    """Every user turn of the conversations, and one typed phrase per event about its node."""
    host = F.concat(F.lit("building-"), F.col("u"))
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("sample_id") % len(PHRASES) + 1).cast("int"))
    typed = _base(spark, sf_dir).select(
        F.concat(F.lit("e"), F.col("sample_id")).alias("question_id"),
        F.replace(F.replace(phrase, F.lit("%h"), host), F.lit("%n"), F.col("k").cast("string")).alias("question"))
    said = table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id"), F.col("turn")).alias("question_id"),
        F.col("text").alias("question"))
    return typed.unionByName(said)
