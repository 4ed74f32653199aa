"""Log landing, levels, text parsers of host tools."""

from pyspark.sql import functions as F

from ..functions.scalars import infer_level, level_rank, priority_to_level
from ..operators import agent_text as text
from ..operators import aggregates as A
from ..operators import selection as sel
from ..plans import reports as R
from ..sources import landing
from ..sources import testbed as T
from .base import query


def logs(spark, d):
    return landing.normalise_logs(T.raw_logs(spark, d)).drop("arrived_at")


@query("normalise_logs", "SELECT log_id, node_id, ts, source, level, message FROM l")
def _(spark, d):
    return logs(spark, d).drop("unit")


@query("land_logs", """SELECT node_id, ts, coalesce(source, 'unknown') AS source, CASE WHEN lower(level) IN ('debug', 'info', 'warn', 'error') THEN lower(level) ELSE 'info' END AS level,
    message FROM (SELECT * EXCLUDE (ts), CASE WHEN ts IS NULL THEN TIMESTAMP '2024-01-31' ELSE ts END AS ts FROM rl)""")
def _(spark, d):
    """Log pushes of one entry each, written as JSON lines and landed again."""
    entry = F.struct(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("ts"), "source", "level", "message", "unit")
    raw = T.raw_logs(spark, d).select(F.to_json(F.struct(F.col("node_id").alias("lab_id"), F.array(entry).alias("entries"))).alias("value"))
    out = landing.land_logs(raw, T.as_of().cast("timestamp"))
    return out.select("node_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "source", "level", "message")


@query("get_logs", "SELECT log_id, node_id, ts, source, message FROM l WHERE level = 'error' AND source = 'svc3' AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, log_id DESC LIMIT 50 OFFSET 10")
def _(spark, d):
    page = sel.get_logs(logs(spark, d), level="ERROR", source="svc3", since=F.lit("2024-01-05").cast("timestamp_ntz"), limit=50, offset=10)
    return page.select("log_id", "node_id", "ts", "source", "message")


@query("search_logs", "SELECT log_id, ts, message FROM l WHERE message ILIKE '%PURCHASE%\"k\": 4%' ORDER BY ts DESC, log_id DESC LIMIT 100")
def _(spark, d):
    return sel.search_logs(logs(spark, d), 'PURCHASE%"k": 4', limit=100).select("log_id", "ts", "message")


@query("recent_errors", "SELECT log_id, node_id, ts, hostname FROM l JOIN reg USING (node_id) WHERE level = 'error' ORDER BY ts DESC, log_id DESC LIMIT 10")
def _(spark, d):
    return sel.recent_error_logs(logs(spark, d), T.registrations(spark, d), 10).select("log_id", "node_id", "ts", "hostname")


@query("log_counts", "SELECT node_id, level, source, count(*) AS entries FROM l GROUP BY 1, 2, 3")
def _(spark, d):
    return A.log_counts(logs(spark, d))


@query("log_sources", "SELECT DISTINCT node_id, source FROM l")
def _(spark, d):
    return A.log_sources(logs(spark, d))


@query("logs_report", """SELECT node_id, hostname, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, log_id DESC) AS rn, ts, level, source, left(message, 120) AS message
    FROM l JOIN reg USING (node_id) QUALIFY rn <= 5""")
def _(spark, d):
    return R.logs_report(logs(spark, d), T.registrations(spark, d))


LEVEL = """CASE WHEN regexp_matches(lower({0}), 'error|fatal|panic|crit') THEN 'error' WHEN contains(lower({0}), 'warn') THEN 'warn'
    WHEN regexp_matches(lower({0}), 'debug|trace') THEN 'debug' ELSE 'info' END"""


@query("level_inference", f"""SELECT 'd' || doc_id AS id, {LEVEL.format('text')} AS level FROM documents UNION ALL
    SELECT 'p' || page_id, {LEVEL.format('html')} FROM pages UNION ALL SELECT 'l' || log_id, {LEVEL.format('message')} FROM rl""")
def _(spark, d):
    docs = T.table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("m"))
    pages = T.table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("m"))
    rows = T.raw_logs(spark, d).select(F.concat(F.lit("l"), "log_id").alias("id"), F.col("message").alias("m"))
    return docs.unionByName(pages).unionByName(rows).select("id", infer_level("m").alias("level"))


@query("min_level", """SELECT log_id, coalesce(level, 'none') AS level FROM rl WHERE CASE lower(coalesce(level, 'none')) WHEN 'debug' THEN 0 WHEN 'warn' THEN 2 WHEN 'error' THEN 3 ELSE 1 END >= 2""")
def _(spark, d):
    raw = T.raw_logs(spark, d).select("log_id", F.coalesce("level", F.lit("none")).alias("level"))
    return text.at_least(raw, "warning")


@query("syslog_levels", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 3 THEN 'error' WHEN l_linenumber = 4 THEN 'warn' WHEN l_linenumber = 7 THEN 'debug' ELSE 'info' END AS level,
    CASE WHEN l_linenumber <= 3 THEN 3 WHEN l_linenumber = 4 THEN 2 WHEN l_linenumber = 7 THEN 0 ELSE 1 END AS level_rank FROM lineitem""")
def _(spark, d):
    li = T.table(spark, d, "lineitem").withColumn("level", priority_to_level("l_linenumber"))
    return li.select("l_orderkey", "l_linenumber", "level", level_rank("level").alias("level_rank"))


@query("cap_per_push", """SELECT log_id FROM l QUALIFY row_number() OVER (PARTITION BY node_id, date_trunc('day', ts) ORDER BY ts, log_id) <= 2""")
def _(spark, d):
    pushes = logs(spark, d).withColumn("push", F.date_trunc("DAY", "ts"))
    return text.cap_per_push(pushes, ["node_id", "push"], ["ts", "log_id"], 2).select("log_id")


@query("parse_gpu_csv", """SELECT p_partkey, p_size AS index, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 0.0 ELSE p_size END::DOUBLE AS utilization_percent,
    CASE WHEN p_retailprice > 0 THEN CAST(floor(p_retailprice * 1048576) AS BIGINT) ELSE 0 END AS memory_total_bytes, CASE WHEN p_retailprice > 0 THEN (p_size::DOUBLE / p_retailprice) * 100 ELSE 0.0 END AS memory_used_percent,
    (p_size + 30)::DOUBLE AS temperature_celsius, 0.0::DOUBLE AS fan_speed_percent FROM part WHERE p_size % 7 <> 0""")
def _(spark, d):
    """Device lines; parts of some sizes give a line that is too short."""
    p = T.table(spark, d, "part")
    size = F.col("p_size").cast("string")
    util = F.when(F.col("p_size") % 2 == 0, "[Not Supported]").otherwise(size)
    line = F.concat_ws(", ", size, "p_name", util, F.col("p_retailprice").cast("string"), size, size, (F.col("p_size") + 30).cast("string"),
                       F.lit("55.5"), F.lit("250"), F.when(F.col("p_size") % 7 != 0, "[N/A]"))
    out = text.parse_gpu_csv(p.select("p_partkey", line.alias("value")))
    return out.select("p_partkey", "index", "name", "utilization_percent", "memory_total_bytes", "memory_used_percent", "temperature_celsius", "fan_speed_percent")


@query("parse_pool_list", """SELECT o_orderkey, 'pool' || o_custkey AS name, o_orderstatus AS health, o_orderkey * 1000 AS size_bytes, o_custkey AS used_bytes, o_orderkey * 1000 - o_custkey AS free_bytes,
    CAST(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 90 END AS INT) AS fragmentation, CASE WHEN o_orderkey > 0 THEN o_custkey::DOUBLE / (o_orderkey * 1000) * 100 ELSE 0.0 END AS used_percent FROM orders""")
def _(spark, d):
    o = T.table(spark, d, "orders")
    frag = F.when(F.col("o_custkey") % 3 == 0, "-").otherwise(F.concat(F.col("o_custkey") % 90, F.lit("%")))
    size = F.col("o_orderkey") * 1000
    line = F.concat_ws("\t", F.concat(F.lit("pool"), F.col("o_custkey")), size.cast("string"), F.col("o_custkey").cast("string"), (size - F.col("o_custkey")).cast("string"),
                       F.lit("-"), F.lit("-"), frag, F.lit("10"), F.lit("1.00"), "o_orderstatus", F.lit("-"))
    return text.parse_pool_list(o.select("o_orderkey", line.alias("value")))


@query("parse_pool_status", """SELECT o_orderkey, CAST(o_custkey % 5 AS INT) AS read_errors, CAST(o_custkey % 7 AS INT) AS write_errors, CAST(o_custkey % 9 AS INT) AS cksum_errors,
    CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%a %b %d %Y') WHEN 'O' THEN 'in progress' ELSE 'never' END AS last_scrub,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey % 11 AS INT) ELSE 0 END AS scrub_errors FROM orders""")
def _(spark, d):
    o = T.table(spark, d, "orders")
    pool = F.concat(F.lit("pool"), F.col("o_custkey"))
    k = F.col("o_custkey")
    scan = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("scrub repaired 0B in 01:00:00 with "), k % 11, F.lit(" errors on "), F.date_format("o_orderdate", "EEE MMM dd yyyy")))
            .when(F.col("o_orderstatus") == "O", "scrub in progress since today").otherwise("none requested"))
    body = F.concat(F.lit("  pool: "), pool, F.lit("\n state: ONLINE\n  scan: "), scan, F.lit("\nconfig:\n\n\tNAME        STATE     READ WRITE CKSUM\n\t"), pool,
                    F.lit("  ONLINE  "), k % 5, F.lit("  "), k % 7, F.lit("  "), k % 9, F.lit("\n\t  sda  ONLINE 0 0 0\nerrors: No known data errors\n"))
    return text.parse_pool_status(o.select("o_orderkey", pool.alias("name"), body.alias("value"))).drop("name")


@query("parse_smart_json", """SELECT p_partkey, p_name AS model, CASE WHEN length(p_brand || p_partkey) > 6 THEN '...' || right(p_brand || p_partkey, 6) ELSE p_brand || p_partkey END AS serial,
    p_size % 5 <> 0 AS healthy, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE ELSE 33.0 END::DOUBLE AS temperature_c, p_partkey * 3 AS power_on_hours,
    CASE WHEN p_size % 2 = 0 THEN p_size ELSE 9 END::BIGINT AS reallocated_sector_ct, CASE WHEN p_size % 2 = 0 THEN p_size + 1 ELSE 0 END::BIGINT AS pending_sector_ct FROM part""")
def _(spark, d):
    """Even sizes are SATA documents with attributes, odd ones NVMe documents without a temperature."""
    p = T.table(spark, d, "part")
    head = F.concat(F.lit('{"model_name":"'), "p_name", F.lit('","serial_number":"'), "p_brand", F.col("p_partkey"), F.lit('","power_on_time":{"hours":'), F.col("p_partkey") * 3, F.lit("}"),
                    F.when(F.col("p_size") % 5 == 0, ',"smart_status":{"passed":false}').otherwise(""))
    sata = F.concat(F.lit(',"temperature":{"current":'), "p_size", F.lit('},"ata_smart_attributes":{"table":[{"id":5,"raw":{"value":'), "p_size",
                    F.lit('}},{"id":9,"raw":{"value":1}},{"id":197,"raw":{"value":'), F.col("p_size") + 1, F.lit("}}]}}"))
    nvme = F.lit(',"nvme_smart_health_information_log":{"temperature":33,"media_errors":9}}')
    doc = F.concat(head, F.when(F.col("p_size") % 2 == 0, sata).otherwise(nvme))
    return text.parse_smart_json(p.select("p_partkey", doc.alias("value")))


@query("parse_journal_json", """SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, 'journald' AS source, CASE WHEN u % 8 <= 3 THEN 'error' WHEN u % 8 = 4 THEN 'warn' WHEN u % 8 = 7 THEN 'debug' ELSE 'info' END AS level,
    event_type AS message, 'unit' || u AS unit FROM (SELECT *, user_id AS u FROM events) WHERE event_type <> 'view' AND event_type <> 'click'""")
def _(spark, d):
    """Views give an empty message and clicks a broken line; both are dropped."""
    b = T._base(spark, d)
    line = F.concat(F.lit('{"MESSAGE":"'), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")), F.lit('","_SYSTEMD_UNIT":"unit'), F.col("u"), F.lit('","PRIORITY":"'), F.col("u") % 8,
                    F.lit('","__REALTIME_TIMESTAMP":"'), F.unix_micros(F.col("ts").cast("timestamp")), F.lit('"'), F.when(F.col("event_type") == "click", "").otherwise("}"))
    out = text.parse_journal_json(b.select(F.col("sample_id").alias("event_id"), line.alias("value")))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("parse_container_log", """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-01-31' ELSE ts END AS ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
    CASE WHEN user_id % 3 = 0 THEN event_type || ' ' || props ELSE event_type || ' ' || props || ' end' END AS message FROM events""")
def _(spark, d):
    b = T._base(spark, d)
    msg = F.concat("event_type", F.lit(" "), "props")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z  "))
    line = F.when(F.col("u") % 3 == 0, msg).otherwise(F.concat(stamp, msg, F.lit(" end")))
    out = text.parse_container_log(b.select(F.col("sample_id").alias("event_id"), line.alias("value")), T.as_of().cast("timestamp"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
