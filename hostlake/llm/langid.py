"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language has a codeword of bits. For each bit one logistic classifier over byte n-grams (1 to 3 bytes; ASCII letters in
lower case, runs of non-letters as one blank) predicts the bit. Decoding sums, for each codeword, the logistic loss of every bit
weighted by the bit's accuracy in training, and takes the codeword of least loss; a small lead over the next one is ambiguous.
Up to five languages have the exhaustive code (every split of the languages is a bit); more have the best of seeded random codes.

Learning uses a bounded sample of whole texts for each language, hashed before it is gathered. The model has 2 ** 15 x bits
weights, whatever the input; scoring needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlake.llm.common import U64, mix, register, row_groups, table, text_bytes

BITS = 15
PER_LANGUAGE = 800
EPOCHS = 4
RATE = 2.0
AMBIGUOUS = 0.2
UNKNOWN = "und"


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """languages x bits of +1 and -1. One language has one bit."""
    if languages <= 5:
        splits = np.arange(1 << max(0, languages - 1))[:-1] if languages > 1 else np.zeros(1, int)
        bits = [[1] + [1 if s >> j & 1 else -1 for j in range(languages - 1)] for s in splits]
        return np.array(bits, np.int8).T.reshape(languages, -1)
    bits = 4 * int(np.ceil(np.log2(languages))) + 3
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = np.where(rng.random((languages, bits)) < 0.5, 1, -1).astype(np.int8)
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2 + np.eye(languages, dtype=int) * bits
        if apart.min() > far:
            best, far = code, int(apart.min())
    return best


_SHOWN = np.arange(256, dtype=np.uint8)
for _b in range(128):
    _SHOWN[_b] = ord(chr(_b).lower()) if chr(_b).isalpha() else 0x20


def ngrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, feature numbers, features before each row) by groups of rows."""
    data, offsets = text_bytes(texts)
    for lo, hi in row_groups(offsets, 1 << 18):
        a, b = int(offsets[lo]), int(offsets[hi])
        rows = offsets[lo:hi + 1] - a
        shown = _SHOWN[data[a:b]]
        first = np.zeros(b - a + 1, bool)
        first[rows] = True
        keep = np.ones(b - a, bool)
        keep[1:] = (shown[1:] != 0x20) | (shown[:-1] != 0x20) | first[1:b - a]  # one blank for many
        text = shown[keep].astype(np.uint32)
        at = np.concatenate([[0], np.cumsum(keep)])[rows]
        n = len(text)
        grams = np.zeros((n, 3), np.uint32)
        grams[:, 0] = text
        grams[1:, 1] = text[:-1] << 8 | text[1:] | 1 << 24
        grams[2:, 2] = text[:-2] << 16 | text[1:-1] << 8 | text[2:] | 2 << 24
        start = at[:-1][at[1:] > at[:-1]]
        grams[start, 1] = grams[start, 0]  # no gram reaches over a text's start
        grams[start, 2] = grams[start, 0]
        second = start[start + 1 < n] + 1
        grams[second, 2] = grams[second, 1]
        h = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        yield lo, hi, h.ravel(), 3 * at


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        index, value = [], []
        for lo, hi, grams, at in ngrams(batch.column(2)):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                i, n = np.unique(grams[a:b], return_counts=True)
                index.append(i.astype(np.int32))
                value.append((n / max(1, b - a)).astype(np.float32))
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in index])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, t))) for x, t in ((index, np.int32), (value, np.float32))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "lang", "index", "value"])


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x bits) and the weight of each bit in decoding: its training accuracy above one half, doubled."""
    w, squares = np.zeros((1 << BITS, code.shape[1]), np.float32), np.full((1 << BITS, 1), 1e-4, np.float32)
    right = np.zeros(code.shape[1])
    for epoch in range(EPOCHS):
        right[:] = 0
        for index, value, k in examples:
            target = code[k]
            f = value @ w[index] * 30
            right += (f * target) > 0
            g = -target / (1 + np.exp(np.clip(target * f, -30, 30))) * 30
            squares[index] += (value[:, None] * 30) ** 2
            w[index] -= RATE * value[:, None] * g[None, :] / 30 / np.sqrt(squares[index])
    weight = np.clip(2 * right / max(1, len(examples)) - 1, 0.05, 1)
    return w * 30, weight


def _trained(languages: list[str]):
    number, code = {x: k for k, x in enumerate(languages)}, codewords(len(languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            index, value = batch.column(2), batch.column(3)
            for k, (doc, lang) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                rows.append((doc or 0, index[k].values.to_numpy(), value[k].values.to_numpy(), number[lang]))
        order = np.argsort(mix(np.array([r[0] for r in rows], np.int64).view(U64)), kind="stable") if rows else []
        w, weight = train([rows[i][1:] for i in order], code)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([weight.tolist()], pa.list_(pa.float64()))], names=["weights", "bits"])

    return run


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """The model of the non-null languages of documents; of each language the per_language texts with the smallest hashes of their
    ids are learnt from. Only texts with a letter count. The languages themselves are gathered: as many as there are lang values."""
    known = documents.where("lang IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                                                       F.col("text").cast("string").alias("text")).where(F.regexp("text", F.lit(r"\p{L}")))
    place = F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), 11) / float(1 << 53)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return {"languages": [], "weights": b"", "bits": []}
    # about twice the sample by the hash alone, so that few rows meet in the window that cuts it exactly
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, 2.0 * (per_language + 20) / counts[lang]))])
    drawn = known.withColumn("place", place).where(F.col("place") <= F.element_at(share, F.col("lang")))
    ids = drawn.select("lang", "doc_id", "place").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))).where(
        F.col("k") <= per_language).groupBy("lang").agg(F.max("place").alias("last"))
    last = {r["lang"]: r["last"] for r in ids.collect()}
    until = F.create_map(*[F.lit(x) for lang in languages for x in (lang, last.get(lang, -1.0))])
    rows = known.withColumn("place", place).where(F.col("place") <= F.element_at(until, F.col("lang"))).select("doc_id", "lang", "text")
    got = (rows.mapInArrow(_hashed, "doc_id long, lang string, index array<int>, value array<float>").repartition(1)
           .mapInArrow(_trained(languages), "weights binary, bits array<double>").first())
    return {"languages": languages, "weights": bytes(got["weights"]), "bits": list(got["bits"])}


def _decoded(model: dict):
    languages = model["languages"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codewords(len(languages)).astype(np.float64) if languages else np.zeros((0, 1))
        bits = code.shape[1]
        w = np.frombuffer(model["weights"], "<f4").reshape(-1, bits) if languages else np.zeros((1 << BITS, 1), np.float32)
        weight = np.array(model["bits"] or [1.0])
        for batch in batches:
            total = np.zeros((batch.num_rows, bits))
            for lo, hi, grams, at in ngrams(batch.column(2)):
                n = np.diff(at)
                full = np.flatnonzero(n)
                if len(full):
                    total[lo + full] = np.add.reduceat(w[grams], at[:-1][full], axis=0) / n[full, None]
            names, scores, unsure = [], [], []
            if languages:
                loss = np.einsum("nkb,b->nk", np.log1p(np.exp(-np.clip(total[:, None, :] * code[None], -30, 30))), weight)
                odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
                share = odds / odds.sum(axis=1, keepdims=True)
                best = share.argmax(axis=1)
                top = np.sort(share, axis=1)
                lead = top[:, -1] - top[:, -2] if len(languages) > 1 else top[:, -1]
            for k, letter in enumerate(batch.column(1).to_pylist()):
                sure = bool(letter) and bool(languages)
                names.append(languages[best[k]] if sure else UNKNOWN)
                scores.append(float(share[k, best[k]]) if sure else 0.0)
                unsure.append(not sure or bool(lead[k] < AMBIGUOUS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())],
                                             names=["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def predict(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous), one row for each row.

    score is the share of the best codeword, 0 to 1; ambiguous: its lead over the next one is under AMBIGUOUS. A null text or one
    without a letter is `und`, score 0, ambiguous; so is every text if no language was learnt.
    """
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp(text, F.lit(r"\p{L}")), F.lit(False)).alias("letter"), text.alias("text"))
    return rows.mapInArrow(_decoded(model), "doc_id long, lang_pred string, score double, ambiguous boolean")


def languages(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous): learnt only from documents whose crc32(doc_id as text) mod 5 is not 0.

    A null doc_id isn't learnt from and counts as held out. Repeated rows are predicted each. Empty tables give an empty result.
    """
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    model = fit(documents.where(rest != 0))
    return predict(documents, model).select("doc_id", F.coalesce(rest == 0, F.lit(True)).alias("held_out"), "lang_pred", "score", "ambiguous")


@register("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
