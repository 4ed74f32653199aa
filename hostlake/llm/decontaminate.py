"""Benchmark decontamination by greedy string tiling.

A running hash over words gives every document's seeds (runs of MIN_MATCH words). A fixed-size bitmap of the benchmark's seeds
lets few of them through; an equi-join with the benchmark's own seeds decides. For each document and item the seed matches are
cut into tiles: again and again the longest run of matches whose words are not yet covered is marked, on both sides. An item is
leaked when its tiles cover THRESHOLD of its words, in whatever order the document has its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlake.llm.common import byte_classes, in_bits, membership_bits, register, row_groups, shingle_hashes, table, text_bytes, word_hashes, written

MIN_MATCH = 4
THRESHOLD = 0.5
SEED_BITS = 24


def _classes() -> np.ndarray:
    """Words are runs of letters, digits and bytes of other scripts; anything else only ends them."""
    out = byte_classes(symbols_apart=True)
    out[out == 2] = 0
    return out


def _seeds(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, seed by start word, words) of each text."""
    data, offsets = text_bytes(texts)
    classes = _classes()
    for lo, hi in row_groups(offsets):
        words, at, _ = word_hashes(data, offsets[lo:hi + 1], classes)
        runs = shingle_hashes(words, k).view(np.int64)
        for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()), lo):
            yield row, runs[a:max(a, b - k + 1)], b - a


def _all_seeds(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = np.asarray(batch.column(0)), list(_seeds(batch.column(1), k))
            n = [len(s) for _, s, _ in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, n)), pa.array(np.repeat(np.array([w for _, _, w in parts], np.int32), n)),
                 pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in n] or [np.zeros(0, np.int32)])),
                 pa.array(np.concatenate([s for _, s, _ in parts] or [np.zeros(0, np.int64)]))],
                names=["item_id", "item_words", "item_at", "seed"])

    return run


def _passing_seeds(k: int, bits: bytes):
    held = np.frombuffer(bits, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = batch.column(0), text_bytes(batch.column(1))
            classes = _classes()
            for lo, hi in row_groups(data[1], 1 << 21):
                words, at, _ = word_hashes(data[0], data[1][lo:hi + 1], classes)
                runs = shingle_hashes(words, k).view(np.int64)
                start = np.flatnonzero(in_bits(runs, held, SEED_BITS))
                row = np.searchsorted(at, start, "right") - 1
                inside = start + k <= at[row + 1]
                start, row = start[inside], row[inside]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + lo)), pa.array((start - at[row]).astype(np.int32)), pa.array(runs[start])],
                                                 names=["doc_id", "doc_at", "seed"])

    return run


def tiles(doc_at: np.ndarray, item_at: np.ndarray, item_words: int, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of one document and one item from their matching seeds: (start in document, start in item, words).

    Longest first; equal lengths by start in the document, then in the item. No word of either side is in two tiles.
    """
    order = np.lexsort((doc_at, doc_at - item_at))
    d, i = doc_at[order].astype(np.int64), item_at[order].astype(np.int64)
    new = np.flatnonzero(np.r_[True, (np.diff(d) != 1) | (np.diff(i) != 1)])
    runs = [(int(d[a]), int(i[a]), int(n) + k - 1) for a, n in zip(new, np.diff(np.r_[new, len(d)]))]
    taken_doc: set[int] = set()
    taken_item = np.zeros(item_words, bool)
    out = []
    import heapq

    heap = [(-n, a, b) for a, b, n in runs]
    heapq.heapify(heap)
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [not taken_item[b + x] and a + x not in taken_doc for x in range(n)]
        if all(free):
            out.append((a, b, n))
            taken_item[b:b + n] = True
            taken_doc.update(range(a, a + n))
            continue
        x = 0
        while x < n:  # what is left of the run, in pieces that are still long enough
            if free[x]:
                y = x
                while y < n and free[y]:
                    y += 1
                if y - x >= k:
                    heapq.heappush(heap, (x - y, a + x, b + x))
                x = y
            x += 1
    return out


def _tiled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("item_words").to_pylist()
            covered, found = [], []
            for at, n in zip(batch.column("at"), words):
                flat = at.values
                got = tiles(np.asarray(flat.field(0)), np.asarray(flat.field(1)), n, k)
                covered.append(sum(t[2] for t in got))
                found.append([{"doc_at": a, "item_at": b, "words": m} for a, b, m in sorted(got)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("item_id"), batch.column("item_words"), pa.array(covered, pa.int32()),
                 pa.array(found, pa.list_(pa.struct([("doc_at", pa.int32()), ("item_at", pa.int32()), ("words", pa.int32())])))],
                names=["doc_id", "item_id", "item_words", "covered", "tiles"])

    return run


def leaks(documents: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, item_words, covered, coverage, tiles) of each document and item with coverage >= threshold.

    Words are runs of letters and digits in lower case; symbols only end them. Items or texts that are null, empty or under
    min_match words match nothing. Rows without an id take no part. A repeated doc_id counts as one document (its matches
    are joined), a repeated item_id likewise. Empty tables give an empty result; other columns are ignored.
    """
    lower = F.lower(F.col("text").cast("string")).alias("text")
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), lower)
    seeds = items.mapInArrow(_all_seeds(min_match), "item_id long, item_words int, item_at int, seed long")
    bits = membership_bits(seeds, "seed", SEED_BITS)
    found = (documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), lower)
             .mapInArrow(_passing_seeds(min_match, bits), "doc_id long, doc_at int, seed long"))
    met = (found.join(seeds, "seed").groupBy("doc_id", "item_id")
           .agg(F.max("item_words").alias("item_words"), F.collect_set(F.struct("doc_at", "item_at")).alias("at"))
           # each seed adds at most min_match words: the others can't reach the threshold
           .where(min_match * F.size(F.array_distinct(F.col("at.item_at"))) >= threshold * F.col("item_words")))
    tiled = met.mapInArrow(_tiled(min_match), "doc_id long, item_id long, item_words int, covered int, tiles array<struct<doc_at:int,item_at:int,words:int>>")
    return (tiled.withColumn("coverage", F.col("covered") / F.col("item_words")).where(F.col("coverage") >= threshold)
            .select("doc_id", "item_id", "item_words", "covered", "coverage", "tiles"))


@register("op7_decontaminate")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak an item of the benchmark go."""
    gone = written(leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")  # of known size
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
