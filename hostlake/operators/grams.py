"""Short grams of strings as 64-bit hashes: bytes in Arrow buffers, without a Python object per gram.

Strings are compared as UTF-8 bytes, so a string occurs in another one exactly where its bytes do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIZES = (1, 2, 3, 4, 5, 6, 7, 8, 16, 32)
BITS = 26  # of the bitmap of wanted grams: 8 MB, however many there are
_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _packed(data: np.ndarray, size: int, held: dict[int, np.ndarray]) -> np.ndarray:
    """The `size` bytes from each position as one number, beyond eight bytes a hash of them."""
    if size not in held:
        if size == 1:
            held[1] = data.astype(np.uint64)
        else:
            half, n = 1 << (size - 1).bit_length() - 1, max(0, len(data) - size + 1)
            a, b = _packed(data, half, held)[:n], _packed(data, size - half, held)[half:half + n]
            held[size] = a | (b << np.uint64(8 * half)) if size <= 8 else _mix(a) * _K + b
    return held[size]


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values in a row, and n + 1 offsets into them; null counts as empty."""
    column = column.fill_null(b"") if column.null_count else column
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8, at[-1])[at[0]:] if data is not None else np.zeros(0, np.uint8), at - at[0]


def _walk(batch: pa.RecordBatch, wanted: tuple[np.ndarray, list[int]] | None, step: int) -> Iterator[pa.RecordBatch]:
    (data, offsets), lo, n = _strings(batch.column(1)), 0, batch.num_rows
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + step, "right")) - 1))  # whole strings, about `step` bytes
        starts, sizes, part = offsets[lo:hi] - offsets[lo], np.diff(offsets[lo:hi + 1]), data[offsets[lo]:offsets[hi]]
        row, held = np.repeat(np.arange(hi - lo), sizes), {}
        left = np.repeat(starts + sizes, sizes) - np.arange(len(part))
        own = np.asarray(SIZES)[np.maximum(np.searchsorted(SIZES, sizes, "right") - 1, 0)]
        for size in SIZES if wanted is None else wanted[1]:
            m = len(part) - size + 1
            if m <= 0:
                break
            gram = _mix(_packed(part, size, held) + np.uint64(size * int(_K) % (1 << 64)))
            hit = left[:m] >= size
            if wanted is None:
                hit &= own[row[:m]] == size
            else:
                bit = gram >> np.uint64(64 - BITS)
                hit &= (wanted[0][bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)) != 0
            i = np.flatnonzero(hit)
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[i] + lo)), pa.array((i - starts[row[i]] + 1).astype(np.int64)), pa.array(gram[i].view(np.int64)),
                     pa.array(np.full(len(i), size, np.int32))], names=[batch.schema.names[0], "at", "gram", "size"])
        lo = hi


def grams(df: DataFrame, key: str, c: str, wanted: tuple[np.ndarray, list[int]] | None = None, step: int = 1 << 18) -> DataFrame:
    """(key, at, gram, size): grams of c by their first byte, from 1. Without `wanted` those of each string's own size, the largest of
    SIZES that fits; else all that may be wanted ones."""
    held = None if wanted is None else df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _walk(batch, None if held is None else held.value, step)

    kind = dict(df.dtypes)[key]
    return df.selectExpr(f"`{key}`", f"cast(`{c}` AS BINARY) AS _bytes").mapInArrow(run, f"`{key}` {kind}, at LONG, gram LONG, size INT")


def bitmap(df: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Which hashes (by their first bits) and sizes are among the rows (gram, size) of df: a fixed 8 MB."""
    rows = df.selectExpr(f"shiftrightunsigned(gram, {64 - BITS + 6}) AS word", f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - BITS}) & 63 AS INT)) AS bits",
                         "shiftleft(1L, size) AS sizes").groupBy("word").agg({"bits": "bit_or", "sizes": "bit_or"}).toArrow()
    out = np.zeros(1 << BITS - 6, np.uint64)
    word, sizes, bits = (rows.column(c).to_numpy() for c in ("word", "bit_or(sizes)", "bit_or(bits)"))
    out[word] = bits.view(np.uint64)
    used = int(np.bitwise_or.reduce(sizes)) if len(sizes) else 0
    return out, [s for s in SIZES if used >> s & 1]
