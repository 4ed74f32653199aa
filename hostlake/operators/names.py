"""Fuzzy matching of names and texts with host and container names, as equi-joins on short grams.

"A contains B" is decided at an anchor: of the grams of a name (the whole name up to 8 bytes, else 8, 16 or 32 bytes), the one that
the fewest names have. Only positions of a text whose gram may be an anchor, by a bitmap of fixed size, become rows; only where a
gram is an anchor is the whole name compared, in place. Names have any length; no pair of a name and a text is formed unless the
anchor meets. Names are made distinct first, and hosts are reduced to the first one per joined name.

Rows of grams go through a shuffle before they are joined: Spark then knows their size and broadcasts only what is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.runner import new_path
from .grams import bitmap, grams

WORDS = r"[-_.\s]+"


def _anchors(names: DataFrame, c: str) -> DataFrame:
    """(c, gram, size, anchor_at): the rarest gram of every distinct name and its first position there, written to the shared folder."""
    rows = grams(names.select(c).distinct(), c, c).repartition("gram")
    shared = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("_shared"))
    rarest = F.min_by(F.struct("gram", "size", F.col("at").alias("anchor_at")), F.struct("_shared", "at"))
    anchors = rows.join(shared, "gram").groupBy(c).agg(rarest.alias("_a")).select(c, "_a.*")
    path = new_path(names.sparkSession, "anchors")
    anchors.write.parquet(path)  # read by the bitmap and by the join
    return names.sparkSession.read.schema(anchors.schema).parquet(path)


def text_key(text) -> Column:
    return F.unhex(F.md5(text))


def _met(bodies: DataFrame, body: str, names: DataFrame, name: str) -> DataFrame:
    """(_key, body, name): every row of bodies (_key, body) with every name that occurs in it, once."""
    anchors = _anchors(names, name)
    rows = grams(bodies, "_key", body, bitmap(anchors)).repartition("gram")
    at = rows.join(anchors.drop("size"), "gram").select("_key", name, (F.col("at") - F.col("anchor_at") + 1).alias("_from")).filter("_from > 0")
    wanted = F.col(name).cast("binary")
    here = F.col(body).cast("binary").substr(F.col("_from").cast("int"), F.length(wanted)) == wanted
    return at.distinct().join(bodies, "_key").filter(here).drop("_from").distinct()


def _bodies(texts: DataFrame, body: str) -> DataFrame:
    return texts.select(body).filter(F.length(body) > 0).distinct().withColumn("_key", text_key(body))


def contained(texts: DataFrame, body: str, names: DataFrame, name: str) -> DataFrame:
    """(body, name): every distinct text with every name that occurs in it. Empty and null strings match nothing."""
    return _met(_bodies(texts, body), body, names, name).select(body, name)


def _first(df: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """The row that is first in registry order per key (partial aggregate)."""
    order = F.struct(*more, F.col("ord"), F.col("node_id"))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_m")).select(*keys, "_m.*")


def registry_order(nodes: DataFrame) -> DataFrame:
    """Hosts with their sort key: last seen first, never seen last."""
    us = F.unix_micros(F.col("last_seen").cast("timestamp"))
    return nodes.select("node_id", "hostname", F.lower("hostname").alias("host"),
                        F.coalesce(-us, F.lit(2**62)).alias("ord"))


def match_node(names: DataFrame, nodes: DataFrame, name: str = "name") -> DataFrame:
    """Best node per name: equal, else one contains the other, else a word of the host name is equal.

    Within a rank the first node in registry order wins. Unmatched and empty names give no row.
    """
    # A word of a host name is a substring of it, so "contains" already covers the word rank.
    wanted = names.select(F.trim(F.lower(name)).alias("needle")).filter("needle <> ''").distinct()
    hosts = _first(registry_order(nodes), ["host"])
    exact = wanted.join(hosts, wanted["needle"] == hosts["host"]).withColumn("match_rank", F.lit(1))
    in_host = contained(hosts, "host", wanted, "needle").join(hosts, "host").withColumn("match_rank", F.lit(2))
    has_host = contained(wanted, "needle", hosts, "host").join(hosts, "host").withColumn("match_rank", F.lit(2))
    cols = ["needle", "node_id", "hostname", "ord", "match_rank"]
    hits = exact.select(*cols).unionByName(in_host.select(*cols)).unionByName(has_host.select(*cols))
    best = _first(hits, ["needle"], F.col("match_rank"))
    return names.join(best.drop("ord"), F.trim(F.lower(name)) == best["needle"]).drop("needle")


def extract_node_name(texts: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """The node a text speaks of: its whole host name occurs, or a word of it that no other host contains."""
    low = F.lower(text)
    bodies = _bodies(texts.select(low.alias("body")), "body")
    hosts_all = registry_order(nodes)
    hosts = _first(hosts_all, ["host"])
    whole = _met(bodies, "body", hosts, "host").select("_key", "host").join(hosts, "host").select("_key", "node_id", "hostname", "ord")

    words = hosts_all.select("host", F.explode(F.split("host", WORDS)).alias("word")).filter(F.length("word") >= 3)
    vocabulary = words.select("word").distinct()
    # counted per word, so a word that very many hosts contain is one row when it meets the texts
    once = (contained(hosts_all, "host", vocabulary, "word").join(hosts_all, "host").groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.first("node_id").alias("node_id"), F.first("hostname").alias("hostname"),
        F.first("ord").alias("ord")).filter("n = 1"))
    # where a word occurs, the text is split to see whether it stands there by itself
    alone = F.array_contains(F.split("body", r"(?U)[^\w]+"), F.col("word"))
    by_word = _met(bodies, "body", once, "word").filter(alone).select("_key", "word").join(once, "word").select("_key", "node_id", "hostname", "ord")
    best = _first(whole.unionByName(by_word), ["_key"])
    return texts.join(best.drop("ord"), text_key(low) == best["_key"]).drop("_key")


def find_container(names: DataFrame, containers: DataFrame, nodes: DataFrame, name: str = "name") -> DataFrame:
    """First container, in registry order and then position, whose name contains the input or the reverse."""
    wanted = names.select(F.lower(name).alias("needle")).filter("needle <> ''").distinct()
    rows = containers.select(
        "node_id", "pos", F.col("name").alias("container"), "state", "status", "restart_count",
        F.lower("name").alias("cname"))
    listed = rows.join(registry_order(nodes).select("node_id", "hostname", "ord"), "node_id")
    firsts = _first(listed, ["cname"], F.col("ord"), F.col("node_id"), F.col("pos"))
    a = contained(firsts, "cname", wanted, "needle").join(firsts, "cname")
    b = contained(wanted, "needle", firsts, "cname").join(firsts, "cname")
    cols = ["needle", "node_id", "hostname", "ord", "pos", "container", "state", "status", "restart_count"]
    best = _first(a.select(*cols).unionByName(b.select(*cols)), ["needle"], F.col("ord"), F.col("node_id"), F.col("pos"))
    return names.join(best.drop("ord", "pos"), F.lower(name) == best["needle"]).drop("needle")
