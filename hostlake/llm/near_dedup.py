"""Near-duplicates by circulant MinHash: two fixed permutations, one shifted circularly, give all signature coordinates.

Permutation `sigma` scatters a document's shingles over a universe of 2 ** 20 cells; coordinate k is the smallest value that
`pi`, shifted circularly by k, gives to an occupied cell. The shifts of a cell are one contiguous slice of pi, so a shingle costs
one copy of a slice instead of 128 hash functions. Bands of coordinates propose pairs; the full shingle sets decide.

Documents with equal sets are one class. Members of a bucket with too many shingles of their own for any link leave it. The others
are held against one leader of the bucket. Two members that both link with it are in one component and need no pair. For any other
two, the leader's set tells how much their differences from it must have in common to link (`_across`), so they meet in an equi-join on
elements of the differences, rare ones first, and only as far into each difference as the required common part leaves room. Before full
sets meet, sketches of 1,024 bits (one of each of 1,024 circulant coordinates) rule out pairs that are far below the similarity.
Nothing is capped. A pair at similarity 0.75 exactly is missed with a probability of about 1e-5 for each link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlake.llm.common import (U64, byte_classes, in_bits, membership_bits, mix, register, row_groups, shingle_hashes, table, text_bytes,
                                 word_hashes, written)

SHINGLE = 5
UNIVERSE_BITS = 20
BANDS, BAND_ROWS = 32, 4
SKETCH_BITS = 1024
SEED = 20240


@lru_cache(maxsize=4)
def _permutations(seed: int, width: int = BANDS * BAND_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and pi as a table whose row i is pi[i], pi[i + 1], ... circularly (a view, not a copy)."""
    d = 1 << UNIVERSE_BITS
    rng = np.random.default_rng(seed)
    sigma = rng.permutation(d).astype(np.int32)
    pi = rng.permutation(d).astype(np.uint32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:width - 1]]), width)


def signature(shingles: np.ndarray, width: int = BANDS * BAND_ROWS, seed: int = SEED) -> np.ndarray:
    """The first `width` coordinates of a set of shingle hashes."""
    sigma, shifted = _permutations(seed, width)
    cells = sigma[(shingles & U64((1 << UNIVERSE_BITS) - 1)).astype(np.int64)]
    out = shifted[cells[:512]].min(axis=0)
    for a in range(512, len(cells), 512):
        np.minimum(out, shifted[cells[a:a + 512]].min(axis=0), out=out)
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit of each of SKETCH_BITS coordinates, as longs. Bits of two sets differ with probability (1 - similarity) / 2."""
    bits = mix(signature(shingles, SKETCH_BITS).astype(U64) + np.arange(SKETCH_BITS, dtype=U64)) & U64(1)
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def most_differing_bits(percent: int) -> int:
    """So many bits differ, 4.5 standard deviations over the mean, at the similarity asked for: more mean (almost surely) no link."""
    p = (1 - percent / 100) / 2
    return int(np.ceil(SKETCH_BITS * p + 4.5 * np.sqrt(SKETCH_BITS * p * (1 - p))))


_LANES = np.arange(1, BAND_ROWS + 1, dtype=np.uint64) * U64(0x9FB21C651E98DF25) | U64(1)


def band_keys(sig: np.ndarray) -> np.ndarray:
    per_band = (mix(sig.reshape(BANDS, BAND_ROWS).astype(U64) + U64(1)) * _LANES).sum(axis=1, dtype=U64)
    return mix(per_band + np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: the whole sequence as one where there are fewer words than a shingle has."""
    data, offsets = text_bytes(texts)
    classes = byte_classes()
    for lo, hi in row_groups(offsets):
        words, at, _ = word_hashes(data, offsets[lo:hi + 1], classes)
        runs = shingle_hashes(words, SHINGLE)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= SHINGLE:
                yield np.unique(runs[a:b - SHINGLE + 1])
            elif b > a:
                yield shingle_hashes(words[a:b], b - a)
            else:
                yield words[:0]


def fingerprints(shingles: np.ndarray) -> tuple[int, int]:
    """Two longs that sets share, size beside them, only if they are equal."""
    m = mix(shingles)
    return int(m.sum(dtype=U64).view(np.int64)), int((mix(m + U64(0x51ED27)) ^ m).sum(dtype=U64).view(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, one, two, bands = [], [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            for column, value in zip((one, two), fingerprints(s)):
                column.append(value)
            bands.append(band_keys(signature(s)) if len(s) else None)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum([0 if b is None else BANDS for b in bands])]).astype(np.int32)),
            pa.array(np.concatenate([b for b in bands if b is not None] or [np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists],
            names=["doc_id", "n_shingles", "f1", "f2", "bands"])


def _sets_of(bits: bytes):
    held = np.frombuffer(bits, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            part = pa.RecordBatch.from_arrays(batch.columns, names=["doc_id", "text"]).filter(
                pa.array(in_bits(np.asarray(ids.fill_null(0)), held)) if len(ids) else pa.array([], pa.bool_()))
            part = part.filter(pa.compute.is_valid(part.column(0)))
            sets = list(shingle_sets(part.column(1)))
            kept = [k for k, s in enumerate(sets) if len(s)]  # an empty set links with nothing
            part, sets = part.take(pa.array(kept, pa.int64())), [sets[k] for k in kept]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            bits_at = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (SKETCH_BITS // 64))
            sketches = np.concatenate([sketch(s) for s in sets]) if sets else np.zeros(0, np.int64)
            one, two = zip(*map(fingerprints, sets)) if sets else ((), ())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                 pa.ListArray.from_arrays(bits_at, pa.array(sketches))],
                names=["id", "f1", "f2", "shingles", "sketch"])

    return run


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): smallest id reachable over links (a, b). Each round takes the smallest label beside a node and then the label
    of that label, which halves what is left of a chain; it ends when no label changes."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        beside = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        now = written(labels.join(beside, "id").select("id", F.col("label").alias("before"), F.least("label", "near").alias("label")), f"{name}-{step}")
        if now.where(F.col("label") < F.col("before")).isEmpty():
            return now.select("id", F.col("label").alias("component"))
        up = now.select(F.col("id").alias("label"), F.col("label").alias("up"))
        labels = written(now.join(up, "label").select("id", F.col("up").alias("label")), f"{name}-{step}-short")


def _sets(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, shingles, sketch) for (id, f1, f2) of ids, from one more pass over the texts; of an id with several texts the one meant."""
    bits = membership_bits(ids, "id")
    sets = documents.mapInArrow(_sets_of(bits), "id long, f1 long, f2 long, shingles array<long>, sketch array<long>")
    return written(sets.join(ids, ["id", "f1", "f2"], "left_semi").dropDuplicates(["id"]).drop("f1", "f2"), "sets")


def _far(a: Column, b: Column, percent: int) -> Column:
    """True where two sketches differ in more bits than a link's would."""
    differing = F.lit(0)
    for k in range(SKETCH_BITS // 64):
        differing = differing + F.bit_count(a[k].bitwiseXOR(b[k]))
    return differing > most_differing_bits(percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full shingle sets reach the similarity. Sketches let few others through to the sets."""
    sides = [sets.select(F.col("id").alias(x), F.col("sketch").alias(f"k{x}")) for x in ("a", "b")]
    near = written(pairs.join(sides[0], "a").join(sides[1], "b").where(~_far(F.col("ka"), F.col("kb"), percent)).select("a", "b"), "near")
    held = (near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"))
    na, nb, both = F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    alike = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)  # the smaller set inside the larger one at best
    return written(held.where(alike).where(100 * both >= percent * (na + nb - both)).select("a", "b"), "links")


def _able(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, rep, n): members that may link inside their bucket, of buckets with two or more of them.

    A shingle that no other member of any bucket has is in no intersection. With s shared shingles of n, and a partner of m, the
    intersection is s at most and the union n + m - s at least; m is no less than the smallest set of the bucket, nor than
    percent / 100 of n. Exact: only members without any partner go.
    """
    alone = (sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
             .groupBy("id").agg(F.count("*").alias("alone")))
    sizes = sets.select("id", F.size("shingles").alias("n")).join(alone, "id", "left").select(
        F.col("id").alias("rep"), "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))
    sized = written(members.join(sizes, "rep"), "sized")
    least = written(sized.groupBy("key").agg(F.min("n").alias("least")), "least")
    partner = F.greatest(F.col("least"), percent * F.col("n") / 100)
    fit = written(sized.join(least, "key").where((100 + percent) * F.col("shared") >= percent * (F.col("n") + partner)).select("key", "rep", "n"), "able")
    crowded = written(fit.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "able-keys")
    return written(fit.join(crowded, "key"), "members")


def _leaders(members: DataFrame) -> DataFrame:
    """(key, lead): of each bucket the member that meets most others over all buckets, ties to the smaller id. One order for all buckets,
    so of two members at most one leads the other; few leaders for many buckets mean few pairs of member and leader."""
    crowds = written(members.groupBy("key").agg(F.count("*").alias("c")), "crowds")
    met = written(members.join(crowds, "key").groupBy("rep").agg(F.sum("c").alias("met")), "met")
    first = F.max_by("rep", F.struct("met", -F.col("rep")))
    return written(members.join(met, "rep").groupBy("key").agg(first.alias("lead")), "leads")


def _differences(led: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(lead, rep, w, excess, diff) of the pairs (a: member, b: leader): diff has the shingles of one set alone; a member and its leader
    link where excess <= 0."""
    held = (led.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"))
    added, missing = F.array_except("sa", "sb"), F.array_except("sb", "sa")
    cut = held.select(F.col("b").alias("lead"), F.col("a").alias("rep"), F.size("sb").alias("h"), added.alias("added"), missing.alias("missing"))
    w = 100 * F.size("missing") + percent * F.size("added")
    return cut.select("lead", "rep", w.alias("w"), (w - (100 - percent) * F.col("h")).alias("excess"), F.concat("missing", "added").alias("diff"))


def _across(led: DataFrame, sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of a leader's buckets that may link although they are in different components so far. Exact: no link is left out.

    With h the leader's set, M(x) = h without x, A(x) = x without h and w(x) = 100 |M(x)| + percent |A(x)|, members x and y link exactly
    where (100 + percent) c >= w(x) + w(y) - (100 - percent) |h|, c being how many elements M(x) and M(y), A(x) and A(y) have in
    common. So one that links with the leader has w(x) <= (100 - percent) |h|; where c = 0 both do, and need no pair. For any other x,
    with excess e(x) = w(x) - (100 - percent) |h|, w(y) >= percent c gives 100 c >= e(x). The first common element, rare ones first, then
    has c - 1 others behind it in either difference, which bounds how far elements count. Pairs far from the leader can share many
    elements without a link; those with sketches far apart don't leave the join.
    """
    placed = led.join(comps.select(F.col("id").alias("a"), "component"), "a", "left").select("a", "b", F.coalesce("component", "a").alias("component"))
    spread = written(placed.groupBy("b").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("b"), "spread")
    placed = written(placed.join(spread, "b"), "placed")
    cut = written(_differences(placed.select("a", "b"), sets, percent), "differences")
    outside = cut.where("excess > 0").groupBy("lead").agg(F.min("excess").alias("least"))
    parts = cut.join(outside, "lead").join(placed.select(F.col("b").alias("lead"), F.col("a").alias("rep"), "component"), ["lead", "rep"])
    parts = parts.withColumn("need", F.ceil(F.when(F.col("excess") > 0, F.col("excess") / 100).otherwise((F.col("w") + F.col("least")) / (100 + percent))))
    each = parts.select("lead", "rep", "component", "w", "excess", "need", F.explode("diff").alias("s"))
    # an element counts if it can be common to members of two components of which one doesn't link with the leader
    shared = (each.groupBy("lead", "s").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("excess").alias("most"))
              .where("lo < hi AND most > 0"))
    shared = written(shared.select("lead", "s", "c"), "shared")
    of_member = Window.partitionBy("lead", "rep")
    room = F.count("*").over(of_member) - F.row_number().over(of_member.orderBy("c", "s")) + 1  # this element and those behind it
    early = written(each.join(shared, ["lead", "s"]).withColumn("room", room).where("room >= need").drop("c", "need")
                    .join(sets.select(F.col("id").alias("rep"), "sketch"), "rep"), "early")
    x, y = early.where("excess > 0").alias("x"), early.alias("y")
    # w(x) + w(y) - (100 - percent) |h| = excess(x) + w(y)
    fits = (100 + percent) * F.least("x.room", "y.room") >= F.col("x.excess") + F.col("y.w")
    once = (F.col("y.excess") <= 0) | (F.col("x.rep") > F.col("y.rep"))
    met = x.join(y, (F.col("x.lead") == F.col("y.lead")) & (F.col("x.s") == F.col("y.s")) & (F.col("x.component") != F.col("y.component")) & once & fits
                 & ~_far(F.col("x.sketch"), F.col("y.sketch"), percent))
    return written(met.select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b")).distinct(), "across")


def near_duplicates(documents: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_rows, n_shingles, component_id, n_links, kept), one row for each doc_id.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a set has the distinct 5-word shingles, or the whole sequence if there are
    fewer words. Documents link at 100 * intersection >= percent * union. Texts that are null or without words have an empty set
    and stay alone. n_rows counts the rows of a doc_id; rows that repeat a doc_id are one document, of which only the text with the
    largest set counts (ties by a hash of the set). A null doc_id is a row of its own with a null component, kept, and links with nothing. n_links: classes linked with the document's class
    among the verified pairs. An empty table gives an empty result; other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = written(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "sig")
    keys = ["n_shingles", "f1", "f2"]
    per_doc = sig.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.max(F.struct(*keys)).alias("top"))
    per_doc = written(per_doc.select("doc_id", "n_rows", "top.*"), "documents")
    firsts = written(per_doc.where("n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep")), "firsts")
    classed = sig.select(F.col("doc_id").alias("rep"), *keys, "bands").join(firsts, ["rep", *keys], "left_semi").dropDuplicates(["rep"])
    classed = written(classed.select("rep", "f1", "f2", "bands"), "classes")

    banded = classed.select("rep", F.explode("bands").alias("key"))
    crowded = written(banded.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("key"), "crowded")
    members = written(banded.join(crowded, "key").select("key", "rep").distinct(), "bucketed")
    meant = classed.join(members.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("id"), "f1", "f2")
    sets = _sets(written(meant, "meant"), docs)
    members = _able(members, sets, percent)
    leads = _leaders(members)
    led = members.join(leads, "key").where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    led = written(led, "led")
    links = _verified(led, sets, percent)
    comps = components(links, "led")

    more = _verified(_across(led, sets, comps, percent), sets, percent)
    if not more.isEmpty():
        links = links.unionByName(more)
        comps = components(links, "final")
    links = links.distinct()

    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    classes = comps.withColumnRenamed("id", "rep").join(ends, "rep", "left")
    out = per_doc.join(firsts, keys, "left").join(classes, "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    out = out.select("doc_id", "n_rows", "n_shingles", component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     (F.col("doc_id") == component).alias("kept"))
    nothing = sig.where("doc_id IS NULL").select("doc_id", F.lit(1).cast("long").alias("n_rows"), "n_shingles", F.lit(None).cast("long").alias("component_id"),
                                                 F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return out.unionByName(nothing)


@register("op10_near_duplicates")
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept", "n_links")


def _print_of(texts: pd.Series) -> pd.DataFrame:
    sets = list(shingle_sets(pa.array(texts, pa.string(), from_pandas=True)))
    return pd.DataFrame([(len(s), *fingerprints(s)) for s in sets], columns=["n", "f1", "f2"])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (and of rows that repeat a doc_id) one row stays, with the text that counted.
    Rows with a null doc_id all stay."""
    found = written(near_duplicates(docs).where("doc_id IS NOT NULL AND (NOT kept OR n_rows > 1)").select("doc_id", "kept"), "found")
    gone = written(found.select("doc_id"), "gone")  # a table whose size is known: a small one is sent to the texts, not the texts to it
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = found.where("kept").select("doc_id")
    if again.isEmpty():
        return rest
    print_of = F.pandas_udf(_print_of, "n long, f1 long, f2 long")
    rows = docs.join(again, "doc_id", "left_semi").select(
        F.struct(*docs.columns).alias("row"), F.struct(print_of(F.col("text").cast("string")).alias("p"), F.col("text").alias("t")).alias("by"))
    return rest.unionByName(rows.groupBy("row.doc_id").agg(F.max_by("row", "by").alias("row")).select("row.*"))
