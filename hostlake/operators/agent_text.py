"""Text written by host tools, parsed as columns of a text table (column `value`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_col, infer_level, level_rank, mib_to_bytes, priority_to_level
from ..sources.landing import MESSAGE_LIMIT


def _number(c: Column) -> Column:
    """0 for values in brackets such as [N/A] and for anything that is not a number."""
    return F.when(c.startswith("["), 0.0).otherwise(F.coalesce(c.try_cast("double"), F.lit(0.0)))


def parse_gpu_csv(lines: DataFrame) -> DataFrame:
    """Ten comma-separated fields per device; shorter lines are dropped."""
    f = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = lines.withColumn("f", f).filter(F.size("f") >= 10)
    at = lambda i: F.col("f")[i]
    total, used, free = _number(at(3)), _number(at(4)), _number(at(5))
    return rows.select(
        *[c for c in lines.columns if c != "value"],
        F.coalesce(at(0).try_cast("int"), F.lit(0)).alias("index"), at(1).alias("name"),
        _number(at(2)).alias("utilization_percent"),
        mib_to_bytes(total).alias("memory_total_bytes"), mib_to_bytes(used).alias("memory_used_bytes"),
        mib_to_bytes(free).alias("memory_free_bytes"),
        F.when(total > 0, used / total * 100.0).otherwise(0.0).alias("memory_used_percent"),
        _number(at(6)).alias("temperature_celsius"), _number(at(7)).alias("power_watts"),
        _number(at(8)).alias("power_limit_watts"), _number(at(9)).alias("fan_speed_percent"))


def parse_pool_list(lines: DataFrame) -> DataFrame:
    """At least ten blank-separated fields per pool; sizes in bytes."""
    rows = lines.withColumn("f", F.split(F.trim("value"), r"\s+")).filter(F.size("f") >= 10)
    at = lambda i: F.col("f")[i]
    big = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))
    size, used = big(at(1)), big(at(2))
    return rows.select(
        *[c for c in lines.columns if c != "value"],
        at(0).alias("name"), at(9).alias("health"), size.alias("size_bytes"), used.alias("used_bytes"),
        big(at(3)).alias("free_bytes"),
        F.coalesce(F.regexp_replace(at(6), "%$", "").try_cast("int"), F.lit(0)).alias("fragmentation"),
        F.when(size > 0, used / size * 100.0).otherwise(0.0).alias("used_percent"))


def parse_pool_status(texts: DataFrame, pool="name") -> DataFrame:
    """Error counters of the pool's own row and the outcome of the last scrub, from whole status texts."""
    fields = F.transform(F.split("value", "\n"), lambda x: F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " "))
    own = F.get(F.filter(fields, lambda f: (F.size(f) >= 5) & (F.get(f, F.lit(0)) == as_col(pool))), F.lit(0))
    num = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    scan = F.regexp_extract("value", r"(?m)^\s*(scan:.*)$", 1)
    rows = texts.withColumns({"own": own, "scan": scan})
    done = F.col("scan").contains("scrub repaired")
    return rows.select(
        *[c for c in texts.columns if c != "value"],
        *[num(F.get("own", F.lit(i))).alias(n) for i, n in enumerate(("read_errors", "write_errors", "cksum_errors"), 2)],
        F.when(done, F.trim(F.regexp_extract("scan", r" on (.*)$", 1)))
        .when(F.col("scan").contains("scrub in progress"), "in progress")
        .when(F.col("scan").contains("none requested"), "never").otherwise("").alias("last_scrub"),
        F.when(done, num(F.regexp_extract("scan", r"with (\S+) ", 1))).otherwise(0).alias("scrub_errors"))


SMART_DOC = (
    "model_name STRING, serial_number STRING, smart_status STRUCT<passed BOOLEAN>, "
    "temperature STRUCT<current DOUBLE>, power_on_time STRUCT<hours BIGINT>, "
    "ata_smart_attributes STRUCT<table ARRAY<STRUCT<id INT, raw STRUCT<value BIGINT>>>>, "
    "nvme_smart_health_information_log STRUCT<temperature DOUBLE, media_errors BIGINT>"
)


def parse_smart_json(docs: DataFrame) -> DataFrame:
    rows = docs.withColumn("d", F.from_json("value", SMART_DOC))
    serial, temp = F.col("d.serial_number"), F.coalesce("d.temperature.current", F.lit(0.0))
    nvme = F.col("d.nvme_smart_health_information_log")

    def attribute(i: int) -> Column:
        hits = F.filter("d.ata_smart_attributes.table", lambda a: a["id"] == i)
        return F.coalesce(F.get(hits, F.size(hits) - 1)["raw"]["value"], F.lit(0))

    return rows.select(
        *[c for c in docs.columns if c != "value"],
        F.coalesce("d.model_name", F.lit("")).alias("model"),
        F.when(F.length(serial) > 6, F.concat(F.lit("..."), F.right(serial, F.lit(6))))
        .otherwise(F.coalesce(serial, F.lit(""))).alias("serial"),
        F.coalesce("d.smart_status.passed", F.lit(True)).alias("healthy"),
        F.when(temp == 0, F.coalesce(nvme["temperature"], temp)).otherwise(temp).alias("temperature_c"),
        F.coalesce("d.power_on_time.hours", F.lit(0)).alias("power_on_hours"),
        F.coalesce(nvme["media_errors"], attribute(5)).alias("reallocated_sector_ct"),
        attribute(197).alias("pending_sector_ct"))


def parse_journal_json(lines: DataFrame, arrived: Column | None = None) -> DataFrame:
    """Journal entries with a message; broken lines and empty messages are dropped."""
    j = F.from_json("value", "MESSAGE STRING, _SYSTEMD_UNIT STRING, PRIORITY STRING, __REALTIME_TIMESTAMP STRING")
    us = F.col("j.__REALTIME_TIMESTAMP").try_cast("bigint")
    when = F.timestamp_micros((F.floor(us / 1_000_000) * 1_000_000).cast("bigint"))
    # exploding keeps the message test from being pushed down as a second parse of every line
    rest = [c for c in lines.columns if c != "value"]
    parsed = lines.select(*rest, j.alias("p")).select(*rest, F.explode(F.when(F.col("p.MESSAGE") != "", F.array("p"))).alias("j"))
    return (
        parsed.select(*rest,
                F.coalesce(when, arrived if arrived is not None else F.current_timestamp()).alias("ts"),
                F.lit("journald").alias("source"), priority_to_level("j.PRIORITY").alias("level"),
                F.left("j.MESSAGE", F.lit(MESSAGE_LIMIT)).alias("message"),
                F.coalesce("j._SYSTEMD_UNIT", F.lit("")).alias("unit")))


def parse_container_log(lines: DataFrame, arrived: Column) -> DataFrame:
    """A leading time stamp of 21 to 39 characters is split off, else the line keeps the arrival time."""
    v = F.col("value")
    stamp = F.regexp_extract(v, r"^(\S{21,39}) ", 1)
    stamped = (F.length(v) > 30) & (stamp != "") & ((F.substring(v, 5, 1) == "-") | (F.substring(v, 11, 1) == "T"))
    message = F.when(stamped, F.trim(F.substring(v, F.length(stamp) + 2, F.length(v)))).otherwise(v)
    return (
        lines.filter("value <> ''")
        .withColumn("stamp", F.when(stamped, stamp)).withColumn("message", message).filter("message <> ''")
        .select(*[c for c in lines.columns if c != "value"],
                F.coalesce(F.try_to_timestamp(F.col("stamp")), arrived).alias("ts"),
                infer_level("message").alias("level"), F.left("message", F.lit(MESSAGE_LIMIT)).alias("message")))


def at_least(logs: DataFrame, level: str) -> DataFrame:
    """Entries whose level ranks at or above the given one; unknown levels rank as info."""
    return logs.filter(level_rank("level") >= level_rank(F.lit(level)))


def cap_per_push(entries: DataFrame, push: list[str], order: list[str], n: int = 100) -> DataFrame:
    """The first n entries of each push; the rank filter also runs before the shuffle."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*push).orderBy(*order)
    return entries.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def container_share(n: int, containers: int) -> int:
    """Lines a single container may add to a push of n."""
    return max(10, n // max(1, containers))
