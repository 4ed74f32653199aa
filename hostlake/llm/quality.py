"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are single words and word pairs (runs of letters or digits, and runs of other symbols, ASCII letters in lower case),
hashed to 2 ** 18 weights and weighted by their share of the text; a bias is always on. A word pair of equal words, next to each
other or one apart, has one shared weight whatever the word, so that repetition is learnt for unseen words too. The model is fitted in one task on a
bounded sample (MAX_TRAIN labelled documents, whole texts, hashed before they are gathered); scoring is a sparse dot product
in every task, with a weight table of fixed size (1 MB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlake.llm.common import U64, byte_classes, register, row_groups, shingle_hashes, table, text_bytes, word_hashes

BITS = 18
MAX_TRAIN = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.1
SCALE = 8.0  # of the shares of a text, beside a bias of 1


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the weight numbers of its words and of its word pairs, repeated as often as they occur."""
    data, offsets = text_bytes(texts)
    classes = byte_classes(symbols_apart=True)
    shift = U64(64 - BITS)
    for lo, hi in row_groups(offsets):
        words, at, _ = word_hashes(data, offsets[lo:hi + 1], classes)
        one = (words >> shift).astype(np.int32)
        two = (shingle_hashes(words, 2) >> shift).astype(np.int32)
        two[words[1:] == words[:-1]] = 0
        apart = words[2:] == words[:-2]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield one[a:b], np.append(two[a:max(a, b - 1)], np.ones(np.count_nonzero(apart[a:max(a, b - 2)]), np.int32))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each labelled text with their values."""
    for batch in batches:
        index, value = [], []
        for one, two in features(batch.column(2)):
            i, n = np.unique(np.concatenate([one, two]), return_counts=True)
            index.append(i)
            value.append((SCALE * n / max(1, n.sum()) ** 0.75).astype(np.float32))
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in index])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, t))) for x, t in ((index, np.int32), (value, np.float32))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "label", "index", "value"])


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the bias) after follow-the-regularised-leader updates over the examples in order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    bias = 1 << BITS
    for _ in range(epochs):
        for index, value, label in examples:
            i = np.append(index, bias)
            x = np.append(value, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    return weights(np.arange(len(z))).astype(np.float32)


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        index, value = batch.column(2), batch.column(3)
        for k, (doc, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            rows.append((doc, index[k].values.to_numpy(), value[k].values.to_numpy(), label))
    rows.sort(key=lambda r: hash((r[0] * 0x9E3779B97F4A7C15) & ((1 << 61) - 1)))  # a fixed mixed order
    w = train([r[1:] for r in rows]) if rows else np.zeros((1 << BITS) + 1, np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["model"])


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> bytes:
    """The model of the labelled documents: 2 ** 18 + 1 float weights, whatever the size of the input.

    Beyond max_train labelled documents, those with the smallest hash of their id are learnt from. Rows without id or label, and
    documents labelled both ways, are left out; without any example every weight is 0.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most"))
    sample = known.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = (texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")  # max_train rows at most
            .mapInArrow(_hashed, "doc_id long, label int, index array<int>, value array<float>"))
    got = rows.repartition(1).mapInArrow(_trained, "model binary").collect()
    return bytes(got[0]["model"]) if got else np.zeros((1 << BITS) + 1, np.float32).tobytes()


def _scored(model: bytes):
    """Scores by the last column: a text, which is left out then, or a row with a field `text`, which stays."""
    w = np.frombuffer(model, np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.empty(batch.num_rows)
            last = batch.column(batch.num_columns - 1)
            for k, (one, two) in enumerate(features(last.field("text") if pa.types.is_struct(last.type) else last)):
                n = len(one) + len(two)
                total[k] = SCALE * (float(w[one].sum(dtype=np.float64)) + float(w[two].sum(dtype=np.float64))) / max(1, n) ** 0.75
            score = 1 / (1 + np.exp(-np.clip(total + float(w[-1]), -35, 35)))
            kept = batch.num_columns - (not pa.types.is_struct(last.type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(score, pa.float64())], names=[*batch.schema.names[:kept], "score"])

    return run


def score(documents: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, score): one row for each row, scored by its whole text; a null or empty text has the score of the bias alone."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scored(model), "doc_id long, score double")


def _remainder(id_column: str, by: int):
    return F.crc32(F.col(id_column).cast("string")) % by


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): labels are learnt only from documents whose crc32(doc_id as text) mod 3 is not 1.

    A null doc_id is scored like any other row and counts as held out (it has no label). An empty table gives an empty result.
    """
    model = fit(documents, labels.where(_remainder("doc_id", 3) != 1))
    held = F.coalesce(_remainder("doc_id", 3) == 1, F.lit(True))
    return score(documents, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score below 0.5 go. The scores travel beside the rows, without a join."""
    model = fit(docs, table(spark, sf_dir, "labels").where(_remainder("doc_id", 3) != 1))
    names = docs.columns
    packed = docs.withColumn("text", F.col("text").cast("string")).select(F.struct(*names).alias("row"))
    schema = T.StructType([*packed.schema.fields, T.StructField("score", T.DoubleType())])
    return packed.mapInArrow(_scored(model), schema).where("score >= 0.5").select("row.*")
