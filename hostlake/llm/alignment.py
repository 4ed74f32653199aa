"""Alignment of two tokenizers over a corpus, with an inverted index of linked id pairs.

Both tokenizers cut a text; byte offsets where a token of each ends make the groups, and the two tokens that end there are linked.
The index has, for each pair of ids, bitmaps of documents in chunks of at most 65,536: plane k holds the documents in which bit k of the
pair's number of links is set. Containers are compressed: sorted 16-bit positions where few bits are set, bits where many are. A pair's
documents are the OR of its planes, popcounted; its links are 2 ** k times the popcount of plane k. Chunks have documents of
their own, so sums over chunks are the counts of the whole OR. The counts then go back along the postings, chunk by chunk,
to the documents.

Texts are cut where both tokenizers are known to end a token, and a worker keeps the alignment of short cuts.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlake.llm.common import register, row_groups, table, text_bytes, written
from hostlake.llm.packing import PATTERN
from hostlake.llm.pieces import SPACE, Kept, Pieces, model_bytes, pieces_of

FIRST = "byte_bpe_50k.json"
CHUNK_DOCUMENTS = 1 << 16
CHUNK_POSTINGS = 1 << 21
CACHE_CUTS = 3 << 17
SLICE = 1 << 20
DENSE = 16  # a container with more than one position in so many is kept as bits
#: Characters beside space, line feed and tab that some take for white space: never beside a cut.
_DOUBTFUL = "\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 ᠎ -‏    ⁠　﻿"

#: Letters and digits about which no two versions of Unicode differ.
_LETTER = "[A-Za-z0-9À-ÖØ-öø-ɏ]"

_aligners: dict[tuple[bytes, bytes], "Aligner"] = {}


def first_bytes(path: str | None = None) -> bytes:
    """The byte-level tokenizer's file, read on the driver and sent to the tasks with the code."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(FIRST)
    with open(path, "rb") as f:
        return f.read()


def byte_alphabet() -> dict[str, int]:
    """The byte of each sign in byte-level vocabularies: visible Latin-1 signs stand for themselves, the others follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Aligner(Kept):
    """Cut -> (tokens of A, tokens of B, links, groups, what the tokens spell if that isn't the cut)."""

    def __init__(self, first: bytes, second: Pieces):
        import tiktoken

        super().__init__(self.align, CACHE_CUTS)
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in json.loads(first)["model"]["vocab"].items() if all(c in alphabet for c in t)}
        self.a = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})  # ids ascend in the order of merges
        self.a_bytes = {i: t for t, i in ranks.items()}
        self.b = second
        self.a_size = [len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)]
        self.b_size = list(map(len, second.bytes))
        self.names = list(map(str, range(max(len(self.a_size), len(self.b_size)))))
        if second.cut is None:
            self.cut = self.slice_end = None
        else:
            plain = "".join(c for c in "\n\t" if c not in second.characters)
            g = _DOUBTFUL + "".join(c for c in "\n\t" if c not in plain)
            w, v = f"[ {plain}]", f"[^ {plain}{g}]"
            single = f"[{plain}]|" if plain else ""
            # between a letter or digit and a sign that no piece of B has after one; A never has them in one token
            after = {y for piece in second.id for x, y in zip(piece, piece[1:]) if re.match(_LETTER, x)}
            signs = re.escape("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after))
            before_sign = f" ?{_LETTER}+(?=[{signs}])|" if signs else ""
            self.cut = re.compile(f"{before_sign}(?:{w}{{2,}}{v}*| {v}+|{single} |{v}+|[{g}]+{w}*{v}*)(?:[{g}]+{w}*{v}*)*")
            self.slice_end = re.compile(f"{v}(?= {v})")

    def align(self, cut: str) -> tuple:
        """One cut, which starts with the space in front where it is the first of its text."""
        want = cut.encode()
        a, b = self.a.encode_ordinary(cut), self.b.encode_cut(cut.replace(" ", SPACE)).tolist()
        spelled = b"".join(map(self.a_bytes.__getitem__, a)), b"".join(map(self.b.bytes.__getitem__, b))
        if spelled != (want, want):
            return len(a), len(b), b"", "", spelled
        size_a, size_b, names, links, groups = self.a_size, self.b_size, self.names, [], []
        end_a = end_b = at = 0
        in_a, in_b = [], []
        for x in a:
            end_a += size_a[x]
            in_a.append(names[x])
            while end_b < end_a:
                y = b[at]
                end_b += size_b[y]
                at += 1
                in_b.append(names[y])
            if end_a == end_b:
                links.append(x << 32 | y)
                groups.append(f"{','.join(in_a)}|{','.join(in_b)}")
                in_a, in_b = [], []
        return len(a), len(b), array("q", links).tobytes(), ";".join(groups), None

    def document(self, text: str | None) -> tuple[int, int, np.ndarray, str]:
        """(tokens of A, tokens of B, link codes, groups); nothing if either tokenizer doesn't spell the text."""
        nothing = 0, 0, np.zeros(0, np.int64), ""
        if not text:
            return nothing
        text = " " + text
        n_a = n_b = at = 0
        links, groups = [], []
        while at < len(text):
            if self.cut is None:
                end, found = len(text), [self[text]]
            else:
                stop = self.slice_end.search(text, at + SLICE) if len(text) - at > SLICE else None
                end = stop.end() if stop else len(text)
                cuts = self.cut.findall(text, at, end)
                found = [self[c] for c in cuts]
            a, b, linked, grouped, wrong = zip(*found)
            if any(w is not None for w in wrong):  # both spell bytes in place or not at all: a cut that is wrong makes the text so
                return nothing
            n_a, n_b, at = n_a + sum(a), n_b + sum(b), end
            links.append(b"".join(linked))
            groups.append(";".join(grouped))
        return n_a, n_b, np.frombuffer(b"".join(links), np.int64), ";".join(groups)


def aligner_of(first: bytes, second: bytes) -> Aligner:
    key = first, second
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(first, pieces_of(second))
    return _aligners[key]


# ---- bitmaps of a chunk ----

PLANES = "pairs array<binary>, sizes array<binary>, positions array<binary>, dense array<binary>, bits array<binary>"


def bitmaps(pairs: np.ndarray, places: np.ndarray, times: np.ndarray, documents: int) -> dict[str, list[bytes]]:
    """Planes of a chunk from postings: pair, place of the document, links of the pair in it. (pair, place) is unique."""
    order = np.lexsort((places, pairs))
    pairs, places, times = pairs[order], places[order].astype(np.uint16), times[order]
    out: dict[str, list[bytes]] = {c: [] for c in ("pairs", "sizes", "positions", "dense", "bits")}
    for k in range(int(times.max(initial=0)).bit_length()):
        held = times >> k & 1 == 1
        p, x = pairs[held], places[held]
        keys, sizes = np.unique(p, return_counts=True)
        many = sizes * DENSE > documents
        in_many = np.repeat(many, sizes)
        rows = np.repeat(np.arange(int(many.sum())), sizes[many])
        full = np.zeros((int(many.sum()), -(-documents // 8) * 8), bool)
        full[rows, x[in_many]] = True
        for name, values in (("pairs", keys[~many]), ("sizes", sizes[~many].astype(np.int32)), ("positions", x[~in_many]), ("dense", keys[many]),
                             ("bits", np.packbits(full, axis=1, bitorder="little"))):
            out[name].append(values.tobytes())
    return out


def _plane(row: dict, k: int, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys, sizes, dense = (np.frombuffer(row[c][k], t) for c, t in (("pairs", np.int64), ("sizes", np.int32), ("dense", np.int64)))
    return keys, sizes, np.frombuffer(row["positions"][k], np.uint16), dense, np.frombuffer(row["bits"][k], np.uint8).reshape(len(dense), -(-documents // 8))


def counted(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, documents, links) of a chunk: popcounts of the OR of the planes, and of each plane."""
    n = row["n_documents"]
    planes = [_plane(row, k, n) for k in range(len(row["pairs"]))]
    if not planes:
        return (np.zeros(0, np.int64),) * 3
    every = np.unique(np.concatenate([c for p in planes for c in (p[0], p[3])]))
    links = np.zeros(len(every), np.int64)
    wide = np.unique(np.concatenate([p[3] for p in planes]))  # pairs with bits in some plane
    together = np.zeros((len(wide), -(-n // 8)), np.uint8)
    apart = []
    for k, (keys, sizes, positions, dense, bits) in enumerate(planes):
        links[np.searchsorted(every, keys)] += sizes.astype(np.int64) << k
        links[np.searchsorted(every, dense)] += np.bitwise_count(bits).sum(axis=1, dtype=np.int64) << k
        together[np.searchsorted(wide, dense)] |= bits
        of = np.repeat(np.searchsorted(every, keys), sizes)
        at = np.searchsorted(wide, every[of])
        in_wide = (at < len(wide)) & (wide[np.minimum(at, max(0, len(wide) - 1))] == every[of]) if len(wide) else np.zeros(len(of), bool)
        np.bitwise_or.at(together, (at[in_wide], positions[in_wide] >> 3), np.left_shift(np.uint8(1), (positions[in_wide] & 7).astype(np.uint8)))
        apart.append(of[~in_wide] << 16 | positions[~in_wide].astype(np.int64))
    documents = np.bincount(np.unique(np.concatenate(apart)) >> 16, minlength=len(every))
    documents[np.searchsorted(every, wide)] += np.bitwise_count(together).sum(axis=1, dtype=np.int64)
    return every, documents, links


def returned(row: dict, pairs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each document of a chunk the sum over its links of a value of the link's pair; pairs ascend and cover the chunk's."""
    n = row["n_documents"]
    out = np.zeros(n, np.int64)
    for k in range(len(row["pairs"])):
        keys, sizes, positions, dense, bits = _plane(row, k, n)
        np.add.at(out, positions, np.repeat(values[np.searchsorted(pairs, keys)], sizes) << k)
        for value, line in zip(values[np.searchsorted(pairs, dense)].tolist(), bits):
            out[np.flatnonzero(np.unpackbits(line, count=n, bitorder="little"))] += value << k
    return out


# ---- jobs ----

ROWS = f"chunk long, place int, doc_id long, n_a long, n_b long, n_links long, groups string, n_documents int, {PLANES}"
_SCHEMA = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()),
                     ("groups", pa.string()), ("n_documents", pa.int32()), *((c, pa.list_(pa.binary())) for c in ("pairs", "sizes", "positions", "dense", "bits"))])


def _rows(columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _aligning(first: bytes, second: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(first, second)
        chunk, held, postings, n = TaskContext.get().partitionId() << 32, [], 0, 0

        def flush() -> pa.RecordBatch:
            pairs, times = (np.concatenate([h[x] for h in held] or [np.zeros(0, np.int64)]) for x in (1, 2))
            places = np.repeat([h[0] for h in held], [len(h[1]) for h in held]) if held else pairs
            return _rows({"chunk": [chunk], "n_documents": [n]} | {c: [v] for c, v in bitmaps(pairs, places, times, n).items()})

        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for lo, hi in row_groups(offsets):
                ids, texts = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in (0, 1))
                out: dict[str, list] = {c: [] for c in ("chunk", "place", "doc_id", "n_a", "n_b", "n_links", "groups")}
                for doc, text in zip(ids, texts):
                    a, b, links, groups = aligner.document(text)
                    pairs, times = np.unique(links, return_counts=True)
                    for c, value in zip(out, (chunk, n, doc, a, b, len(links), groups)):
                        out[c].append(value)
                    if len(pairs):
                        held.append((n, pairs, times))
                        postings += len(pairs)
                    n += 1
                    if n == CHUNK_DOCUMENTS or postings >= CHUNK_POSTINGS:
                        yield flush()
                        chunk, held, postings, n = chunk + 1, [], 0, 0
                yield _rows(out)
        if n:
            yield flush()

    return run


def aligned(documents: DataFrame, first: bytes | None = None, second: bytes | None = None, of_groups: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, index), both read from one table that one pass over the texts writes.

    documents: chunk, place, doc_id, n_a, n_b, n_links, groups (`a1,a2|b1;a3|b2,b3`); a column made of groups can be kept in its stead, to
    save space. index: chunk, n_documents and the planes of its pairs.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.mapInArrow(_aligning(first or first_bytes(), second or model_bytes()), ROWS)
    if of_groups is not None:
        rows = rows.withColumn("groups", F.when(F.col("groups") != "", of_groups).otherwise(F.col("groups")))
    rows = written(rows, "aligned")
    return (rows.where("place IS NOT NULL").select("chunk", "place", "doc_id", "n_a", "n_b", "n_links", "groups"),
            rows.where("place IS NULL").select("chunk", "n_documents", "pairs", "sizes", "positions", "dense", "bits"))


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            row = batch.slice(k, 1).to_pylist()[0]
            pairs, documents, links = counted(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row["chunk"], np.int64)), *map(pa.array, (pairs, documents.astype(np.int64), links))],
                                             names=["chunk", "pair", "documents", "links"])


def pair_counts(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by chunk, by pair). By pair: pair, a, b, documents, links, and whether no other pair of that b has more links."""
    by_chunk = written(index.mapInArrow(_counting, "chunk long, pair long, documents long, links long"), "chunk-pairs")
    counts = written(by_chunk.groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links")).select(
        "pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "documents", "links"), "pairs")
    top = counts.groupBy("b").agg(F.max("links").alias("top"))
    return by_chunk, counts.join(top, "b").select("pair", "a", "b", "documents", "links", (F.col("links") == F.col("top")).alias("best"))


def _returning(key, scores: pa.Table, index: pa.Table) -> pa.Table:
    out = {c: np.zeros(0, t) for c, t in (("chunk", np.int64), ("place", np.int32), ("n_best", np.int64), ("count_sum", np.int64))}
    for row in index.to_pylist():  # one: chunk is its key
        pairs, links, best = (scores.column(c).to_numpy() for c in ("pair", "links", "best"))
        order = np.argsort(pairs)
        pairs = pairs[order]
        out = {"chunk": np.full(row["n_documents"], row["chunk"], np.int64), "place": np.arange(row["n_documents"], dtype=np.int32),
               "n_best": returned(row, pairs, best[order].astype(np.int64)), "count_sum": returned(row, pairs, links[order])}
    return pa.table(out)


def align_tokenizers(documents: DataFrame, first: bytes | None = None, second: bytes | None = None, of_groups: Column | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one row for each row of documents.

    A, the byte-level tokenizer, gets a space and the text; B adds that space itself. Neither gets special tokens. Texts that are null, empty or not
    spelled byte for byte by both have no tokens: zeros and an empty groups column. Two tokens, one of each, are linked where they
    end together; a pair's count is how many links of the whole table it has. n_best: links whose pair has the highest count of
    all pairs of its B id, ties included; count_sum: the counts of all links summed. A row that repeats a doc_id, or has none, is a document of its own.
    Other columns are ignored; an empty table gives no rows.
    """
    docs, index = aligned(documents, first, second, of_groups)
    by_chunk, counts = pair_counts(index)
    scores = by_chunk.select("chunk", "pair").join(counts.select("pair", "links", "best"), "pair")
    back = scores.groupBy("chunk").cogroup(index.groupBy("chunk")).applyInArrow(_returning, "chunk long, place int, n_best long, count_sum long")
    n = F.col("n_links")
    return docs.join(back, ["chunk", "place"], "left").select(
        "doc_id", "n_a", "n_b", n.alias("n_groups"), "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups")


@register("op11_align_tokenizers")
def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), of_groups=F.sha2("groups", 256)).withColumnRenamed("groups", "groups_sha256")
