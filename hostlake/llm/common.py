"""Registry of the queries of this subpackage, shared-folder tables, and vectorised hashing of words in Arrow batches.

Texts reach Python as Arrow buffers and are hashed as bytes, without a Python object per row or word. White space and ASCII
letters are single bytes that never occur inside other UTF-8 characters, so byte-wise splitting is exact.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = frozenset(b"\t\n\x0b\x0c\r ")


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}  # this process's folder in tests on a local master


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "folder" not in _own:
        _own["folder"] = tempfile.mkdtemp(prefix="hostlake-llm-")
    return _own["folder"]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---- bytes of a text column ----

def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8, at[-1]) if data is not None and at[-1] else np.zeros(0, np.uint8)
    return bytes_[at[0]:], at - at[0]


def row_groups(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about limit bytes, a longer row alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


# ---- hashes of words ----

def byte_classes(symbols_apart: bool = False) -> np.ndarray:
    """Class of each byte: 0 ends a word, runs of one other class are words. symbols_apart: letters and digits, symbols apart."""
    out = np.ones(256, np.uint8)
    out[list(SPACE)] = 0
    if symbols_apart:
        for b in range(33, 127):
            if not chr(b).isalnum():
                out[b] = 2
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n + 1:
        size = max(n + 1, (1 << 18) + 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            t = np.full(size, base, U64)
            t[0] = 1
            np.cumprod(t, out=t)
            if size > 1 << 22:  # a giant word: not kept
                _powers.pop(key, None)
                _powers["_" + key] = t
            else:
                _powers[key] = t
        if size > 1 << 22:
            return _powers.pop("_up"), _powers.pop("_down")
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _cuts(cls: np.ndarray, lo: int, hi: int, row_starts: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    """Pieces of about step bytes that end before a separator or with a row, so that no word is cut."""
    while lo < hi:
        size = step
        while True:
            end = min(hi, lo + size)
            if end == hi:
                break
            k = int(np.searchsorted(row_starts, end, "right"))
            row = int(row_starts[k - 1]) if k else lo
            gaps = np.flatnonzero(cls[max(lo, row):end] == 0)
            cut = max(row, max(lo, row) + int(gaps[-1]) if len(gaps) else lo)
            if cut > lo:
                end = cut
                break
            size *= 2
        yield lo, end
        lo = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word (ASCII letters in either case alike), the words before each row (n + 1), the class of each word."""
    base, total = int(offsets[0]), int(offsets[-1])
    cls_all = classes[data[base:total]]
    rows = offsets - base
    edges = np.unique(rows)
    found, starts_at, kinds = [], [], []
    for a, b in _cuts(cls_all, 0, total - base, edges, step):
        cls = cls_all[a:b]
        new = np.empty(b - a + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(cls[1:], cls[:-1], out=new[1:-1])
        inside = edges[np.searchsorted(edges, a):np.searchsorted(edges, b)] - a
        new[inside] = True
        word = cls != 0
        s = np.flatnonzero(new[:-1] & word)
        e = np.flatnonzero(new[1:] & word) + 1
        up, down = _power_tables(b - a)
        sums = np.empty(b - a + 1, U64)
        sums[0] = 0
        np.cumsum((LOWER[data[base + a:base + b]].astype(U64) + U64(1)) * up[:b - a], out=sums[1:])
        found.append(mix((sums[e] - sums[s]) * down[s]))
        starts_at.append(s + a)
        kinds.append(cls[s])
    if not found:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64), np.zeros(0, np.uint8)
    starts = np.concatenate(starts_at)
    return np.concatenate(found), np.searchsorted(starts, rows).astype(np.int64), np.concatenate(kinds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Hash of each span of bytes as they are; starts and ends ascend. Works on about step bytes at a time."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + step, "right")))
        hi = int(ends[j - 1])
        up, down = _power_tables(hi - lo)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum((data[lo:hi].astype(U64) + U64(1)) * up[:hi - lo], out=sums[1:])
        s = starts[i:j] - lo
        out[i:j] = mix((sums[ends[i:j] - lo] - sums[s]) * down[s])
        i = j
    return out


_STEP = U64(0xD1342543DE82EF95)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by start; runs over a row's end are for the caller to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= _STEP
        h += words[j:n + j]
    return mix(h + U64(k))


# ---- a fixed-size filter of keys ----

def membership_bits(keys: DataFrame, column: str, log2_bits: int = 23) -> bytes:
    """Bitmap of 2 ** log2_bits bits with the low bits of mixed keys set. Its size is fixed, whatever the number of keys; a full
    one only lets more rows through to the join that decides."""
    b = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << log2_bits))
    packed = (keys.where(F.col(column).isNotNull()).select(b.alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("w"))
              .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").cast("int").bitwiseAND(F.lit(63)))).alias("bits")))
    out = np.zeros(1 << (log2_bits - 6), np.int64)
    for row in packed.collect():  # one row for each word of the bitmap at most
        out[row["w"]] = row["bits"]
    return out.tobytes()


_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxhash64_of_longs(values: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long column (seed 42)."""
    v = values.astype(np.int64).view(U64)
    k = v * _P2
    k = ((k << U64(31)) | (k >> U64(33))) * _P1
    h = (U64(42) + _P5 + U64(8)) ^ k
    h = ((h << U64(27)) | (h >> U64(37))) * _P1 + _P4
    h ^= h >> U64(33)
    h *= _P2
    h ^= h >> U64(29)
    h *= _P3
    return h ^ (h >> U64(32))


def in_bits(values: np.ndarray, bits: np.ndarray, log2_bits: int = 23) -> np.ndarray:
    """True where the bitmap may hold the value."""
    b = xxhash64_of_longs(values) & U64((1 << log2_bits) - 1)
    return (bits[(b >> U64(3)).astype(np.int64)] >> (b & U64(7)).astype(np.uint8)) & 1 == 1
