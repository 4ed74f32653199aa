"""Newest-row operators and key-wise upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order columns per key: a partial aggregate, no self-join and no window."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(top.alias("_top")).select(*keys, "_top.*")


def latest_per_type(metrics: DataFrame) -> DataFrame:
    """The newest sample of each type of each node; of equal times the last stored wins."""
    return latest_row(metrics, ["node_id", "metric_type"], ["ts", "sample_id"])


def latest_sample(samples: DataFrame) -> DataFrame:
    return latest_row(samples, ["node_id"], ["ts", "sample_id"])


def latest_snapshot(rows: DataFrame) -> DataFrame:
    """All rows of each node's newest time, for tables that hold several rows per sample."""
    newest = rows.groupBy("node_id").agg(F.max("ts").alias("ts"))
    return rows.join(newest, ["node_id", "ts"], "left_semi")


def recent_samples(samples: DataFrame, n: int = 2) -> DataFrame:
    """The newest n samples per node; Spark cuts every map task to n rows per node before the shuffle."""
    w = Window.partitionBy("node_id").orderBy(F.desc("ts"), F.desc("sample_id"))
    return samples.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def latest_digest(digests: DataFrame) -> DataFrame:
    return latest_row(digests, ["node_id"], ["created_at"])


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union of both with the newest row per key kept; null keys count as a value."""
    return latest_row(old.unionByName(new), keys, order)


def upsert_preferences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Latest setting wins per (account, type, node or none)."""
    return upsert_latest(old, new, ["account", "pref_type", "node_id"], ["updated_at"])


def upsert_channels(old: DataFrame, edits: DataFrame) -> DataFrame:
    """Latest edit wins per channel; an edit marked deleted removes it."""
    return upsert_latest(old, edits, ["channel_id"], ["updated_at"]).filter(~F.col("deleted"))


def claim_once(claims: DataFrame) -> DataFrame:
    """The first claim of every external event; later ones are ignored."""
    rest = [c for c in claims.columns if c != "event_id"]
    first = F.min_by(F.struct(*rest), F.struct("claimed_at", "claim_id"))
    return claims.groupBy("event_id").agg(first.alias("_f")).select("event_id", "_f.*")
