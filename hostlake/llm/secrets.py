"""Secret scan with DataFrame functions only: patterns for known kinds, and sliding-window Shannon entropy for unknown ones.

Places come from two functions with the same leftmost, non-overlapping matching: `split` gives the gaps between the matches,
`regexp_extract_all` the matches; running lengths of both are the places, in code points.

Entropy. Candidates are runs of token characters that no known kind covers. Their class is hex (digits and one case of a-f),
alphanumeric or base64, each with its own threshold. A window of WINDOW characters slides over a candidate; an array of counts is
changed by the character that enters and the one that leaves, and with it the sum of c * log2(c) that gives the entropy. The
candidate is a secret if its highest window reaches the threshold and no allow-list pattern suppresses it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlake.llm.common import register, table

ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # shorter runs never match from a later start either, so the length can be part of the pattern
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGN = 12
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}  # bits per character; a window of 20 has 4.32 at most
ALLOW = (
    r"^[0-9]+$",  # numbers
    r"^[A-Za-z]+$", r"^[a-z]+([-_/][a-z]+)+$", r"^[A-Z]+([-_/][A-Z]+)+$",  # words, slugs and paths
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"(?i)example|placeholder|changeme|your[_-]?(key|token)", r"^[-_=+/]+$",
)
BLOCK = 512
PIECE = 256  # windows that one scan of a candidate covers; a longer candidate is scanned in pieces


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, not at each use inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    """An array in slices of BLOCK, so that work on long arrays doesn't grow with their square."""
    return _let(items, lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(1), F.size(x), F.lit(BLOCK)), lambda i: F.slice(x, i, BLOCK)))
                .otherwise(F.array()))


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, len, match>> of all matches."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("match")))
    empty = F.array().cast("array<struct<start:int,len:int,match:string>>")

    def walked(block: Column, at: Column) -> Column:
        return F.aggregate(
            block, F.struct(at.alias("at"), empty.alias("out")),
            lambda acc, s: F.struct((acc["at"] + s["gap"] + s["len"]).alias("at"), F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + s["gap"]).alias("start"), s["len"].alias("len"), s["match"].alias("match")))).alias("out")))

    def over_block(acc: Column, block: Column) -> Column:
        return F.struct((acc["at"] + F.aggregate(block, F.lit(0), lambda n, s: n + s["gap"] + s["len"])).alias("at"),
                        F.concat(acc["out"], F.array(walked(block, acc["at"])["out"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,len:int,match:string>>>").alias("out"))
    steps = F.filter(steps, lambda s: s["match"].isNotNull())  # after the last match is one more gap
    return F.when(F.regexp(text, F.lit(pattern)), F.flatten(F.aggregate(_blocks(steps), start, over_block, lambda acc: acc["out"]))).otherwise(empty)


def _span(kind: int, places: Column) -> Column:
    """array<struct<start, kind, end>>, which sorts by start and then by kind."""
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), (p["start"] + p["len"]).alias("end")))


def _clog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def highest_entropy(text: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy of the windows of a text of ASCII characters; null where the text is shorter than a window."""

    def piece(first: Column, codes: Column) -> Column:
        last = F.least(first + PIECE + window - 2, F.size(codes) - 1)
        start = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("s"), F.lit(1e9).alias("least"))

        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.when(i - first >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
            up, down = F.get(acc["n"], enters), F.get(acc["n"], leaves)
            # the entering character first: its new count is up + 1, from which the leaving one is taken
            down_now = F.when(leaves == enters, down + 1).otherwise(down)
            s = acc["s"] - _clog(up) + _clog(up + 1) + F.when(leaves >= 0, _clog(down_now - 1) - _clog(down_now)).otherwise(0.0)
            n = F.transform(acc["n"], lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0))
            return F.struct(n.alias("n"), s.alias("s"), F.when(i - first >= window - 1, F.least(acc["least"], s)).otherwise(acc["least"]).alias("least"))

        return F.aggregate(F.sequence(first, last), start, step, lambda acc: acc["least"])

    pieces = _let(F.transform(F.split(text, ""), F.ascii), lambda codes: F.transform(
        F.sequence(F.lit(0), F.size(codes) - window, F.lit(PIECE)), lambda first: piece(first, codes)))
    return F.when(F.length(text) >= window, F.lit(math.log2(window)) - F.array_min(pieces) / window)


def _is_secret(text: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | F.regexp(text, F.lit(pattern))
    threshold = (F.when(F.regexp(text, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), THRESHOLDS["hex"]).when(F.regexp(text, F.lit("^[A-Za-z0-9]+$")), THRESHOLDS["alnum"])
                 .otherwise(THRESHOLDS["base64"]))
    return ~allowed & (highest_entropy(text) >= threshold)


def secrets(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans), one row for each row of documents.

    Base kinds, leftmost and non-overlapping each: assign (group 2 of 12 characters or more), access, hex. spans joins all spans
    `kind:start:end` (code points, end exclusive) by start, then kind; base_sha256 is the hash of the base ones joined likewise.
    Null and empty texts have no spans; null doc_ids and repeated rows are kept; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    rows = rows.select(
        "doc_id", "t",
        F.filter(_places(F.col("t"), ASSIGN), lambda p: F.length(F.regexp_extract(p["match"], ASSIGN, 2)) >= MIN_ASSIGN).alias("assign"),
        F.when(F.contains("t", F.lit("AKIA")), _places(F.col("t"), ACCESS)).otherwise(F.array().cast("array<struct<start:int,len:int,match:string>>")).alias("access"),
        _places(F.col("t"), HEX).alias("hex"), _places(F.col("t"), CANDIDATE).alias("runs"))
    base = F.array_sort(F.concat(*[_span(k, F.col(name)) for k, name in enumerate(KINDS[:3])]))
    rows = rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], base.alias("base"), "runs")
    # by block of base spans, which are in order: its first start and last end, then its spans
    rows = rows.withColumn("held", F.transform(_blocks(F.col("base")), lambda b: F.struct(
        b[0]["start"].alias("start"), F.array_max(F.transform(b, lambda x: x["end"])).alias("end"), b.alias("spans"))))

    def meets(span: Column, run: Column) -> Column:
        return (span["start"] < run["start"] + run["len"]) & (span["end"] > run["start"])

    free = F.filter("runs", lambda r: ~F.exists("held", lambda b: F.when(meets(b, r), F.exists(b["spans"], lambda s: meets(s, r))).otherwise(False)))
    rows = rows.withColumn("more", _span(3, F.filter(free, lambda r: _is_secret(r["match"]))))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")

    return rows.select("doc_id", *[f"n_{k}" for k in KINDS[:3]], F.size("more").cast("long").alias("n_entropy"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                       joined(F.array_sort(F.concat("base", "more"))).alias("spans"))


@register("op6_secrets")
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
