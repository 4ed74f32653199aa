"""Resampling towards a target distribution: hashed features, gains in an array, and the highest noisy scores drawn.

Two passes over the texts. The first counts features by bucket in each task; the counts of all tasks are one array of fixed size,
and so are the gains made of them. The second looks every feature's gain up in that array and sums them for each document.

The draw needs the k-th highest of all scores, and only few rows are sorted for it: a quantile sketch proposes nested brackets around
the place, one pass counts exactly what lies above and inside each, and the narrowest bracket that holds the k-th row is
ranked. Rows above it are drawn, rows below are not. The last bracket is the whole range, so one always holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hostlake.llm.common import LOWER, _cuts, register, row_groups, table, text_bytes, written

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
SKETCH = 10_000  # the sketch's ranks are right to one part of this
LONG_WORD = 48  # bytes; longer words are hashed one by one
CHUNK_WORDS = 1 << 16

#: Bytes of words: digits, letters (upper case counts as lower case) and every byte of a character outside ASCII.
_WORD = np.zeros(256, np.uint8)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = 1


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)
_BLANK = np.array([32], np.uint8)


def _extended(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 values continued over one span of bytes each: all spans go forward together, a byte at a time."""
    order = np.argsort(-lengths, kind="stable")
    state, at, left = (crc ^ _ONES)[order], starts[order], lengths[order]
    long = int(np.searchsorted(-left, -LONG_WORD))
    state_long = [zlib.crc32(data[s:s + n].tobytes(), int(c ^ _ONES)) for c, s, n in zip(state[:long], at[:long].tolist(), left[:long].tolist())]
    state, at, left = state[long:].copy(), at[long:], left[long:]
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j))  # spans longer than j
        byte = data[at[:n] + j]
        state[:n] = _CRC[(state[:n] ^ byte) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(crc), np.uint32)
    out[order] = np.concatenate([np.array(state_long, np.uint32), state ^ _ONES])
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words of rows, and how many words lie before each row (n + 1)."""
    base, total = int(offsets[0]), int(offsets[-1])
    cls_all = _WORD[data[base:total]]
    rows = offsets - base
    edges = np.unique(rows)
    starts, lengths = [], []
    for a, b in _cuts(cls_all, 0, total - base, edges, 1 << 18):
        cls = cls_all[a:b]
        new = np.ones(b - a + 1, bool)
        np.not_equal(cls[1:], cls[:-1], out=new[1:-1])
        new[edges[np.searchsorted(edges, a):np.searchsorted(edges, b)] - a] = True
        s = np.flatnonzero(new[:-1] & (cls == 1))
        starts.append(s + a)
        lengths.append(np.flatnonzero(new[1:] & (cls == 1)) + 1 - s)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    s = np.concatenate(starts)
    return s + base, np.concatenate(lengths), np.searchsorted(s, rows).astype(np.int64)


def feature_buckets(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of the rows: first row, buckets of features, the row (from the first) of each feature, words of each row.

    Every row of a part is yielded whole unless it is long; then in several parts, whose words and features add up.
    """
    raw, offsets = text_bytes(texts)
    for lo, hi in row_groups(offsets):
        data = raw[offsets[lo]:offsets[hi]]
        starts, lengths, at = words_of(data, offsets[lo:hi + 1] - offsets[lo])
        row_of = np.repeat(np.arange(hi - lo), np.diff(at))
        for a in range(0, max(1, len(starts)), CHUNK_WORDS):
            b = min(len(starts), a + CHUNK_WORDS)
            found, rows = [], []
            crc = np.zeros(b - a, np.uint32)
            firsts = np.arange(a, b)
            for n in range(longest):  # the run of n + 1 words that starts at each word
                if n:
                    in_row = (firsts + n < len(starts)) & (row_of[np.minimum(firsts + n, len(starts) - 1)] == row_of[firsts]) if len(firsts) else np.zeros(0, bool)
                    firsts, crc = firsts[in_row], crc[in_row]
                    crc = _extended(crc, _BLANK, np.zeros(len(crc), np.int64), np.ones(len(crc), np.int64))
                k = firsts + n
                lower = LOWER[data[starts[k[0]]:starts[k[-1]] + lengths[k[-1]]]] if len(k) else data[:0]
                crc = _extended(crc, lower, starts[k] - (starts[k[0]] if len(k) else 0), lengths[k])
                found.append(crc % np.uint32(buckets))
                rows.append(row_of[firsts])
            yield lo, np.concatenate(found), np.concatenate(rows), np.bincount(row_of[a:b], minlength=hi - lo)


def _counts(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _, _ in feature_buckets(batch.column(0), longest, buckets):
                n += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket; each task sends one row for a bucket at most."""
    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts(longest, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln of how much more frequent a bucket is in the target), smoothed by one for each bucket."""
    s, t, m = have.astype(np.float64), want.astype(np.float64), float(len(have))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + m) / ((s + 1) * (t.sum() + m)))).astype(np.int64)


def _weights(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            features, words, weight = (np.zeros(rows, np.int64) for _ in range(3))
            for lo, found, row, per_row in feature_buckets(batch.column(1), longest, len(gain)):
                hi = lo + len(per_row)
                words[lo:hi] += per_row
                features[lo:hi] += np.bincount(row, minlength=hi - lo)
                np.add.at(weight[lo:hi], row, gain[found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (features, words, weight))],
                                             names=["doc_id", "n_features", "n_words", "weight"])

    return run


def scored(documents: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score): score is the weight plus Gumbel noise that the seed and doc_id fix."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = docs.mapInArrow(_weights(gain, longest), "doc_id long, n_features long, n_words long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """Adds the position (from 1) by score downwards, then doc_id, over all rows.

    Rows are dealt by ranges of that order, so no task holds more than a range, whatever ties there are; what the ranges before
    hold is one row for each range.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    dealt = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("place", place).join(offsets, "part").select(*rows.columns, (F.col("before") + F.col("place")).cast("long").alias("position"))


def bracket_of(rows: DataFrame, k: int, n: int, accuracy: int = SKETCH) -> tuple[int, int, int]:
    """(low, high, above): the k-th highest of n scores lies in low..high, and exactly `above` rows are higher than that."""
    widths = [w / accuracy for w in (2, 8, 64, 512)] + [1.0]
    at = 1 - k / n
    asked = [x for w in widths for x in (max(0.0, at - w), min(1.0, at + w))]
    proposed = rows.agg(F.percentile_approx("score", asked, accuracy).alias("q"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    pairs = list(zip(proposed["q"][0::2], proposed["q"][1::2]))[:-1] + [(proposed["low"], proposed["high"])]
    counts = rows.agg(*[F.count_if(F.col("score") > high).alias(f"above{i}") for i, (_, high) in enumerate(pairs)],
                      *[F.count_if(F.col("score") >= low).alias(f"down{i}") for i, (low, _) in enumerate(pairs)]).first()
    return next((low, high, counts[f"above{i}"]) for i, (low, high) in enumerate(pairs) if counts[f"above{i}"] < k <= counts[f"down{i}"])


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, longest: int = 1,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every row of documents, the drawn ones ranked from 1.

    Texts have A-Z lower-cased; words are runs of digits, a-z and characters outside ASCII; features are runs of 1 to `longest` words
    joined by a space, each with the bucket crc32 mod `buckets`. Of the rows with min_words words or more, floor(percent * n / 100) are drawn: the
    highest scores, ties to the smaller doc_id, a null doc_id last. Null and empty texts have no feature, weight 0 and are drawn only
    if min_words is 0. A row that repeats a doc_id is a document of its own. An empty target or an empty table is no
    error: all gains come from the smoothing, an empty table gives no rows. Other columns are ignored.
    """
    rows = written(scored(documents, target, longest, buckets, seed), "scores")
    able = rows.where(F.col("n_words") >= min_words)
    n = able.count()
    k = percent * n // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    nothing = F.lit(None).cast("long")
    if k == 0:
        return rows.select(*columns, nothing.alias("rank"))
    low, high, above = bracket_of(able, k, n)
    inside = ranked(able.where(F.col("score").between(low, high)), "bracket")
    cut = F.when(F.col("position") <= k - above, F.col("position") + above)
    top = ranked(able.where(F.col("score") > high), "above")
    rest = rows.where((F.col("n_words") < min_words) | (F.col("score") < low))
    return (inside.select(*columns, cut.alias("rank")).unionByName(top.select(*columns, F.col("position").alias("rank")))
            .unionByName(rest.select(*columns, nothing.alias("rank"))))


OP13_SQL = """
WITH RECURSIVE steps(i, v, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
words AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
counted AS (SELECT side, id, w, count(*) AS c FROM words GROUP BY ALL),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(w)), lambda j: ('0x' || substr(hex(encode(w)), 2 * j + 1, 2))::BIGINT)),
    lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM counted), crc),
per AS (SELECT bucket, coalesce(sum(c) FILTER (side = 'd'), 0) AS s, coalesce(sum(c) FILTER (side = 'b'), 0) AS t
  FROM counted JOIN hashed USING (w) GROUP BY bucket),
total AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM per),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS g FROM per, total),
weights AS (SELECT id, sum(c) AS n, sum(c * g) AS weight FROM counted JOIN hashed USING (w) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scores AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights ON doc_id = id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END::BIGINT AS rank
FROM scores LEFT JOIN placed USING (doc_id)
"""


@register("op13_resample", OP13_SQL)
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
