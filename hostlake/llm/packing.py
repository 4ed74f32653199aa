"""Token-ID output: documents as token ids, packed into rows of one length by best-fit-decreasing.

Each task tokenizes its rows and packs them shard by shard (SHARD_TOKENS bound its memory), so nothing is shuffled. Overlong
documents are split into pieces, without loss. Within a shard the longest piece goes first, each into the fullest row that
still has room; a segment tree over room sizes finds that row in logarithmic time.

Tokenizing is byte-level BPE. A text is cut before single spaces between visible characters, where the tokenizer's own pattern
always ends a piece; each distinct cut is encoded once per worker and then looked up by its 64-bit hash and length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlake.llm.common import register, row_groups, span_hashes, table, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that this vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256  # free in the vocabulary
ROW_TOKENS = 2048
SHARD_TOKENS = 1 << 20
CACHE_CUTS = 1 << 18
SLOT_BITS = 21
_SLOT_MASK = np.uint64((1 << SLOT_BITS) - 1)

_encoders: dict[bytes, "Encoder"] = {}


class Encoder:
    """Token ids of many texts at once."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.bpe = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.token_bytes[rank] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of the cuts known, with the place of their ids in `flat`
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)  # number of a key by its low bits; one of those that share them
        self.clashes = np.zeros(0, np.int64)  # numbers of keys that another one pushed out of its slot, by key
        self.at = self.size = self.bytes = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint16)

    @classmethod
    def of(cls, vocabulary: bytes) -> "Encoder":
        key = hashlib.sha1(vocabulary).digest()
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = cls(vocabulary)
        return _encoders[key]

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash among the known keys, -1 for others."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        k = self.slots[(hashes & _SLOT_MASK).astype(np.int64)].astype(np.int64)
        wrong = np.flatnonzero(self.keys[k] != hashes)
        k[wrong] = -1
        if len(wrong) and len(self.clashes):
            sorted_keys = self.keys[self.clashes]
            at = np.minimum(np.searchsorted(sorted_keys, hashes[wrong]), len(sorted_keys) - 1)
            k[wrong] = np.where(sorted_keys[at] == hashes[wrong], self.clashes[at], -1)
        return k

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Encodes cuts that are not known yet."""
        new, first = np.unique(hashes, return_index=True)
        if not len(new):
            return
        # In a row, cuts that begin with the space between visible characters end where they did: they are encoded by one call.
        a, b = starts[first], ends[first]
        plain = (data[a] == 0x20) & _VISIBLE[data[np.minimum(a + 1, len(data) - 1)]] & _VISIBLE[data[b - 1]] & (b - a > 1)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        new, a, b, joined = new[order], a[order], b[order], int(plain.sum())
        length = b - a
        text = data[np.repeat(a[:joined] - (np.cumsum(length[:joined]) - length[:joined]), length[:joined]) + np.arange(int(length[:joined].sum()))]
        together = np.array(self.bpe.encode_ordinary(text.tobytes().decode("utf-8")), np.uint16)
        ends_of = np.cumsum(length[:joined])
        upto = np.searchsorted(np.cumsum(self.token_bytes[together]), ends_of) + 1
        alone = [self.bpe.encode_ordinary(data[x:y].tobytes().decode("utf-8")) for x, y in zip(a[joined:].tolist(), b[joined:].tolist())]
        size = np.concatenate([np.diff(upto, prepend=0), np.array([len(x) for x in alone], np.int64)]).astype(np.int64)
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, together, np.fromiter((i for x in alone for i in x), np.uint16)])
        self.keys = np.concatenate([self.keys, new])
        self.at, self.size, self.bytes = (np.concatenate([x, y.astype(np.int32)]) for x, y in ((self.at, at), (self.size, size), (self.bytes, length)))
        slot = (self.keys & _SLOT_MASK).astype(np.int64)
        self.slots[slot] = np.arange(len(self.keys), dtype=np.int32)
        out = np.flatnonzero(self.slots[slot] != np.arange(len(self.keys)))
        self.clashes = out[np.argsort(self.keys[out])]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        data, offsets = text_bytes(texts)
        for lo, hi in row_groups(offsets):
            a, b = int(offsets[lo]), int(offsets[hi])
            rows, part = offsets[lo:hi + 1] - a, data[a:b]
            starts = _cut_places(part, rows)
            ends = np.append(starts[1:], b - a)
            hashes = span_hashes(part, starts, ends)
            if len(self.keys) > CACHE_CUTS:
                self._forget()
            k = self._numbers(hashes)
            unknown = np.flatnonzero(k < 0)
            if len(unknown):
                self._learn(part, starts[unknown], ends[unknown], hashes[unknown])
                k[unknown] = self._numbers(hashes[unknown])
            if len(k) and not np.array_equal(self.bytes[k], ends - starts):
                raise ValueError("two cuts share a hash")
            size = self.size[k]
            end = np.cumsum(size)
            flat = self.flat[np.repeat(self.at[k] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]
            upto = np.concatenate([[0], end])[np.searchsorted(starts, rows)]
            for x, y in zip(upto[:-1].tolist(), upto[1:].tolist()):
                yield flat[x:y]


_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True


def _cut_places(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Starts of the cuts: of each text that isn't empty, and each single space between visible ASCII or Latin-1 letters."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    space = np.flatnonzero(data[1:-1] == 0x20) + 1 if n > 2 else np.zeros(0, np.int64)
    before, after = data[space - 1], data[space + 1]
    latin = (data[np.maximum(space - 2, 0)] == 0xC3) & (before >= 0xA0) & (before < 0xC0) & (space > 1)
    good = (_VISIBLE[before] | latin) & (_VISIBLE[after] | (after == 0xC3))
    cut = np.zeros(n + 1, bool)
    cut[rows[:-1][np.diff(rows) > 0]] = True
    space = space[good]
    space = space[~cut[space + 1]]  # not the last space of a text
    cut[space] = True
    return np.flatnonzero(cut[:n])


def best_fit_decreasing(lengths: np.ndarray, room: int) -> np.ndarray:
    """Row number of each piece. The longest piece first (ties in given order), into the fullest row that has room for it (ties:
    the row that got to that room last), else into a new row."""
    width = 1 << room.bit_length()
    tree = [0] * (2 * width)  # how many rows have a room within a node's range
    at_room: list[list[int]] = [[] for _ in range(room + 1)]
    out = np.zeros(len(lengths), np.int64)
    rows = 0
    for piece in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        need = int(lengths[piece])
        node = need + width
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):  # up to a right neighbour that has rows
                node >>= 1
            if node > 1:
                node += 1
                while node < width:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
        if node > 1:
            left = node - width
            row = at_room[left].pop()
            _add(tree, node, -1)
        else:
            left, row, rows = room, rows, rows + 1
        out[piece] = row
        left -= need
        at_room[left].append(row)
        _add(tree, left + width, 1)
    return out


def _add(tree: list[int], node: int, by: int) -> None:
    while node:
        tree[node] += by
        node >>= 1


def _pack_shard(ids: list[np.ndarray], docs: list, numbers: list[int], row_tokens: int, dtype, first: int) -> pa.RecordBatch:
    """One row for each packed row of the shard."""
    lengths = np.array([len(x) for x in ids], np.int64)
    row = best_fit_decreasing(lengths, row_tokens)
    order = np.lexsort((np.arange(len(row)), row))
    n = int(row.max()) + 1
    matrix = np.full((n, row_tokens), END_OF_TEXT, dtype)
    used = np.zeros(n, np.int64)
    for p in order.tolist():
        r, a = row[p], used[row[p]]
        matrix[r, a:a + lengths[p]] = ids[p]
        used[r] = a + lengths[p]
    segments = np.bincount(row, minlength=n)
    edges = np.concatenate([[0], np.cumsum(segments)])
    total = np.cumsum(lengths[order])
    base = np.concatenate([[0], total])[edges[:-1]]
    start = total - lengths[order] - np.repeat(base, segments)
    offsets = pa.array(edges.astype(np.int32))
    cumulative = np.insert(total - np.repeat(base, segments), edges[:-1], 0)
    cum_offsets = pa.array((edges + np.arange(n + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(first, first + n, dtype=np.int64)), pa.array(used.astype(np.int32)), pa.array([m.tobytes() for m in matrix], pa.binary()),
         pa.ListArray.from_arrays(cum_offsets, pa.array(cumulative.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(start.astype(np.int32))),
         pa.ListArray.from_arrays(offsets, pa.array([docs[p] for p in order.tolist()], pa.int64())),
         pa.ListArray.from_arrays(offsets, pa.array([numbers[p] for p in order.tolist()], pa.int32()))],
        names=["pack_id", "n_tokens", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "pieces"])


def _packed(vocabulary: bytes, row_tokens: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # a worker that served other steps before
        encoder = Encoder.of(vocabulary)
        first = TaskContext.get().partitionId() << 40
        ids, docs, numbers, held = [], [], [], 0
        end = np.array([END_OF_TEXT], np.uint16)
        for batch in batches:
            for doc, tokens in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                tokens = np.concatenate([tokens, end])
                for k in range(0, len(tokens), row_tokens):
                    ids.append(tokens[k:k + row_tokens])
                    docs.append(doc)
                    numbers.append(k // row_tokens)
                    held += len(ids[-1])
                    if held >= shard_tokens:
                        out = _pack_shard(ids, docs, numbers, row_tokens, np.dtype("<u2"), first)
                        first += out.num_rows
                        ids, docs, numbers, held = [], [], [], 0
                        yield out
        if ids:
            yield _pack_shard(ids, docs, numbers, row_tokens, np.dtype("<u2"), first)

    return run


def pack(documents: DataFrame, vocabulary: str = VOCABULARY, row_tokens: int = ROW_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(pack_id, n_tokens, input_ids, cu_seqlens, position_resets, doc_ids, pieces): one row for each packed row.

    input_ids: row_tokens little-endian 16-bit ids, the unused end filled with END_OF_TEXT; n_tokens of them are used.
    cu_seqlens: 0 and the end of each segment. position_resets: where positions start at 0 again, the start of each segment.
    doc_ids, pieces: each segment's document and the number of its piece. Every row of documents is there once, its text
    followed by END_OF_TEXT; a null or empty text has that token alone, a null doc_id stays null, repeated rows are all there.
    Which documents share a row depends on how the input is partitioned. An empty table gives an empty result.
    """
    with open(vocabulary, "rb") as f:  # a parameter of the driver; under 1 MB, sent with the tasks
        ranks = f.read()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_packed(ranks, row_tokens, shard_tokens), "pack_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, "
                           "position_resets array<int>, doc_ids array<long>, pieces array<int>")


@register("op2_pack_tokens")
def op2_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def to_token_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed rows of the documents."""
    return pack(docs)
