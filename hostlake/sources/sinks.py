"""Writers of result tables: date-partitioned Parquet, staged so that a table is never read and overwritten at once."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_date(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("date", F.to_date(ts))


def append_by_date(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends rows under date=... folders: rebalanced by date, so that a large day becomes several tasks, sorted inside files."""
    dated = with_date(df, ts).hint("rebalance", F.col("date"))
    dated.sortWithinPartitions("date", "node_id", ts).write.mode("append").partitionBy("date").parquet(path)


def replace_dates(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """Overwrites only the dates that are present in df; other dates stay."""
    with_date(df, ts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def _dates_on_disk(spark: SparkSession, path: str) -> dict[str, object]:
    """The date folders of a table with their paths, from one listing of the table's folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(root) if fs.exists(root) else []
    return {f.getPath().getName()[5:]: f.getPath() for f in found if f.getPath().getName().startswith("date=")}


def expire_dates(spark: SparkSession, path: str, staged: str, keep, as_of, shortest_hours: int, longest_hours: int) -> dict[str, list[str]]:
    """Retention that touches only dates that can hold expired rows.

    Dates younger than the shortest window stay as they are; dates older than the longest one go as folders, unread. Only those
    between are read: keep(rows) of them is written to `staged` first and then replaces these dates. as_of: a datetime.
    Returns the dates kept, rewritten and dropped.
    """
    import datetime as dt

    young, old = ((as_of - dt.timedelta(hours=h)).date().isoformat() for h in (shortest_hours, longest_hours))
    on_disk = _dates_on_disk(spark, path)
    done = {"kept": sorted(d for d in on_disk if d > young), "dropped": sorted(d for d in on_disk if d < old),
            "rewritten": sorted(d for d in on_disk if old <= d <= young)}
    table = spark.read.parquet(path) if on_disk else None
    empty = []
    if done["rewritten"]:
        between = table.filter((F.col("date") >= F.lit(old).cast("date")) & (F.col("date") <= F.lit(young).cast("date")))
        keep(between).write.mode("errorifexists").partitionBy("date").parquet(staged)
        left = _dates_on_disk(spark, staged)
        if left:
            (spark.read.schema(table.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("date").parquet(path))
        empty = [d for d in done["rewritten"] if d not in left]
    for d in done["dropped"] + empty:
        on_disk[d].getFileSystem(spark._jsc.hadoopConfiguration()).delete(on_disk[d], True)
    return done


def upsert_episodes(spark: SparkSession, changed: DataFrame, path: str, staged: str, keys: tuple[str, ...] = ("node_id", "alert_type", "created_at")) -> None:
    """Merges changed episodes into the table: only their dates are read, rows with the same keys are replaced, the others stay."""
    dated = with_date(changed, "created_at")
    dates = dated.select("date").distinct()
    merged = dated
    if _dates_on_disk(spark, path):
        old = spark.read.parquet(path).join(dates, "date", "left_semi").join(dated.select(*keys).distinct(), list(keys), "left_anti")
        merged = old.unionByName(dated, allowMissingColumns=True)
    merged.hint("rebalance", F.col("date")).write.mode("errorifexists").partitionBy("date").parquet(staged)
    (spark.read.schema(merged.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path))


EPISODE_TABLE = ("node_id STRING, alert_type STRING, severity STRING, created_at TIMESTAMP, message STRING, resolved_at TIMESTAMP, "
                 "notify BOOLEAN, date DATE")


def _applied(path: str) -> str:
    return path.rstrip("/") + "-applied"


def last_applied(spark: SparkSession, path: str) -> int:
    """The newest micro-batch whose changes are in the table at path, -1 before the first."""
    try:
        done = spark.read.schema("batch_id LONG").parquet(_applied(path)).agg(F.max("batch_id").alias("b")).first()["b"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        done = None
    return -1 if done is None else done


def merge_episode_changes(changes: DataFrame, batch_id: int, path: str) -> bool:
    """Merges one micro-batch of opened and resolved events into the episode table; False if it was merged before.

    A change carries the whole episode, so a batch is reduced to one row an episode and replaces the stored one. Only the dates of
    changed episodes are read and written. The number of a batch is noted after its merge: a replay after a loss in between merges the
    same rows again, and a batch that was noted, or is older than one that was, changes nothing.
    """
    spark = changes.sparkSession
    if batch_id <= last_applied(spark, path):
        return False
    keys = ["node_id", "alert_type", "created_at"]
    newest = F.struct((F.col("event") == "resolved").alias("done"), F.col("at"), *[F.col(c) for c in ("severity", "message", "notify")])
    rows = changes.groupBy(*keys).agg(F.max(newest).alias("x")).select(
        "node_id", "alert_type", "x.severity", "created_at", "x.message", F.when(F.col("x.done"), F.col("x.at")).alias("resolved_at"), "x.notify")
    staged = f"{path.rstrip('/')}-staged/{batch_id}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{staged}-changes")  # read twice below
    rows = spark.read.schema(rows.schema).parquet(f"{staged}-changes")
    if not rows.isEmpty():
        upsert_episodes(spark, rows, path, staged)
    spark.createDataFrame([(batch_id,)], "batch_id LONG").coalesce(1).write.mode("append").parquet(_applied(path))
    return True


def merge_episode_stream(changes: DataFrame, path: str, checkpoint: str):
    """Runs a stream of episode changes into the table at path until its present input is done."""
    return changes.writeStream.foreachBatch(lambda rows, batch_id: merge_episode_changes(rows, batch_id, path)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_episodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EPISODE_TABLE).parquet(path)


def write_alert_episodes(episodes: DataFrame, path: str) -> None:
    replace_dates(episodes, path, "created_at")


def store_digests(digests: DataFrame, path: str) -> None:
    digests.write.mode("append").parquet(path)


def log_questions(routed: DataFrame, path: str) -> None:
    """Question log: question, type, matched, confidence, account, time."""
    matched = ~F.col("query_type").isin("fallback", "error")
    cols = [c for c in ("question_id", "question", "account", "created_at") if c in routed.columns]
    routed.select(*cols, "query_type", matched.alias("matched"), "confidence").write.mode("append").parquet(path)


def rewrite_kept(spark: SparkSession, path: str, staged: str, keep) -> DataFrame:
    """Writes keep(table at path) to the new path `staged` and returns it; the caller then switches over.

    The old files are not touched, so a lost executor or a failed job leaves the table as it was.
    """
    keep(spark.read.parquet(path)).write.mode("errorifexists").parquet(staged)
    return spark.read.parquet(staged)
