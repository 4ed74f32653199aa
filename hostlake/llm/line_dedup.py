"""Repeated line runs: a suffix array over line-ID sequences by distributed prefix doubling, and the intervals of its suffixes
that share a prefix, at every depth.

Lines that occur once can't be in a repeated run, so documents are cut into segments of repeated lines; segments under MIN_WORDS
words are done. Equal segments keep their first copy, with their number. For the others, ranks of 1, 2, 4, ... lines are named by sorting the
pairs of the ranks before; they order the suffixes of all segments. Doubling stops when no run of so many lines occurs twice in them,
whatever its words.

Suffixes that share their first d lines are one interval of the suffix array with a longest common prefix of d or more. For each
suffix the deepest interval in which it is not the first in the order of (doc_id, text hash, line) is found by halving the depth,
all suffixes at once: its depth is the longest run from there that also begins earlier. Of these runs those are maximal that
the run from the line before doesn't hold. A run counts if it has MIN_WORDS words; the lines of all that count are deleted, and as each has
an earlier copy, one copy of every line stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlake.llm.common import U64, byte_classes, mix, register, row_groups, span_hashes, table, text_bytes, written

MIN_WORDS = 1
NO_ID = -(1 << 63)  # stands for a null doc_id


def _given_id(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text the hashes of its lines and their numbers of words; a null or empty text has no lines."""
    classes = byte_classes()
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        hashes, words, counts = [], [], []
        for lo, hi in row_groups(offsets):
            a, b = int(offsets[lo]), int(offsets[hi])
            part, rows = data[a:b], offsets[lo:hi + 1] - a
            full = np.diff(rows) > 0
            breaks = np.flatnonzero(part == 10)
            starts = np.concatenate([rows[:-1][full], breaks + 1])
            ends = np.concatenate([rows[1:][full], breaks])
            starts, ends = np.sort(starts, kind="stable"), np.sort(ends, kind="stable")
            word = classes[part] != 0
            first = word.copy()
            first[1:] &= ~word[:-1]
            first[rows[:-1][full]] = word[rows[:-1][full]]
            upto = np.concatenate([[0], np.cumsum(first)])
            hashes.append(mix(span_hashes(part, starts, ends) + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64))
            words.append((upto[ends] - upto[starts]).astype(np.int32))
            n = np.zeros(hi - lo, np.int64)
            n[full] = np.add.reduceat(part == 10, rows[:-1][full]) + 1 if full.any() else 0
            counts.append(n)
        at = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts or [np.zeros(0, int)]))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x) if x else np.zeros(0, t))) for x, t in ((hashes, np.int64), (words, np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "th", "lines", "words"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and the places before each segment in the task: one for each line, and one for each segment's end."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = np.diff(np.asarray(batch.column("lines").offsets)) + 1
        local = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(local.astype(np.int64))],
                                         names=[*batch.schema.names, "part", "local"])


def _segments(docs: DataFrame, min_words: int) -> DataFrame:
    """(at, doc_id, th, first_line, lines, words) of runs of repeated lines; `at` numbers lines in the order of documents; a
    number between two segments is no line."""
    each = docs.select("doc_id", "th", F.posexplode(F.arrays_zip("lines", "words")).alias("line", "x")).select(
        "doc_id", "th", "line", F.col("x.lines").alias("h"), F.col("x.words").alias("w"))
    repeated = written(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-lines")
    held = each.join(repeated, "h")
    island = F.col("line") - F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("line"))
    runs = (held.withColumn("island", island).groupBy("doc_id", "th", "island")
            .agg(F.array_sort(F.collect_list(F.struct("line", "h", "w"))).alias("x"), F.sum("w").alias("total")).where(F.col("total") >= min_words))
    runs = runs.select("doc_id", "th", F.col("x.line")[0].alias("first_line"), F.col("x.h").alias("lines"), F.col("x.w").alias("words"))
    schema = written(runs, "runs")
    ordered = schema.repartitionByRange("doc_id", "th", "first_line").sortWithinPartitions("doc_id", "th", "first_line")
    ordered = written(ordered.mapInArrow(_numbered, "doc_id long, th long, first_line int, lines array<long>, words array<int>, part int, local long"), "segments")
    size = ordered.groupBy("part").agg(F.sum(F.size("lines") + 1).alias("n"))
    base = size.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row for each task
    return ordered.join(base, "part").withColumn("at", F.col("base") + F.col("local")).drop("part", "local", "base")


def _ranks(segments: DataFrame) -> list[DataFrame]:
    """(pos, rank) for runs of 1, 2, 4, ... lines, up to the longest that occurs twice: where they begin and their ranks, of runs that
    occur more than once. Ranks are those of all suffixes in the order of so many lines, equal for equal ones; a suffix that ends
    before ranks before longer ones."""
    out, step, last = [], 0, segments.select("at", F.col("lines").alias("r"))
    while True:
        shifted = F.transform("r", lambda _, i: F.coalesce(F.get("r", i + step), F.lit(-1))) if step else F.transform("r", lambda _: F.lit(0).cast("long"))
        whole = F.transform("r", lambda _, i: i + (2 * step or 1) <= F.size("r"))  # here, so that no row keeps its whole segment
        pairs = last.select("at", F.posexplode(F.arrays_zip(F.col("r").alias("a"), shifted.alias("b"), whole.alias("whole"))).alias("i", "x"))
        pairs = pairs.select("at", "i", "x.a", "x.b", "x.whole")
        names = pairs.groupBy("a", "b").agg((F.max("whole") & (F.count("*") > 1)).alias("shared")).orderBy("a", "b")
        names = written(names.select("a", "b", "shared", F.monotonically_increasing_id().alias("rank")), "ranks")
        if names.where("shared").isEmpty():
            return out
        ranked = pairs.join(names, ["a", "b"]).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("i", "rank", "shared"))).alias("x"))
        ranked = written(ranked.select("at", F.col("x.rank").alias("r"), F.col("x.shared").alias("shared")), "suffix-ranks")
        places = ranked.select("at", F.posexplode(F.arrays_zip("r", "shared")).alias("i", "x")).where("x.shared")
        out.append(places.select((F.col("at") + F.col("i")).alias("pos"), F.col("x.r").alias("rank")))
        step, last = 2 * step or 1, ranked.select("at", "r")


def _places(segments: DataFrame) -> DataFrame:
    """(pos, at, start, doc_id, th, line, weight): a row for each line of the segments."""
    start = F.explode(F.sequence(F.lit(0), F.size("lines") - 1)).alias("start")
    each = segments.select("at", "doc_id", "th", "first_line", "weight", start)
    return each.select((F.col("at") + F.col("start")).alias("pos"), "at", "start", "doc_id", "th", (F.col("first_line") + F.col("start")).alias("line"), "weight")


def _earlier_runs(places: DataFrame, ranks: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(pos, length, first) of the longest run from each line that also begins earlier, and (length, first, copies) of these runs: where
    each begins first, and how often it occurs.

    A row of `held` stands for suffixes that share more lines than are in question any more: the first of them, their number, and the
    interval it is in, named by its length and the first suffix there. Each step splits the intervals by the next 2 ** k lines. Suffixes with
    an equal one before them go on in the deeper interval; the first of the equal ones stays for all of them, and in the deeper
    interval it only stands for itself. It is dropped when nothing is left that it could be met by (`most`, a bound of the rows of its interval, is 1).
    """
    shared = places.join(ranks[0].select("pos"), "pos", "left_semi") if ranks else places  # other lines begin no repeated run
    held = shared.select("pos", F.lit(0).alias("length"), F.lit(-1).cast("long").alias("first"), F.col("weight").alias("copies"), F.lit(1 << 62).alias("most"))
    for k, rank in reversed([*enumerate(ranks)]):
        next_lines = rank.withColumnRenamed("pos", "next")
        met = written(held.withColumn("next", F.col("pos") + F.col("length")).join(next_lines, "next", "left").drop("next"), "intervals")
        alike = written(met.where("rank is not null").groupBy("length", "first", "rank").agg(
            F.min("pos").alias("pos"), F.sum("copies").alias("copies"), F.count("*").alias("n"), F.min("most").alias("most")), "alike")
        deeper = met.drop("most").join(alike.where("n > 1").select("length", "first", "rank", F.col("pos").alias("begin"), "n"), ["length", "first", "rank"])
        deeper = deeper.select("pos", (F.col("length") + (1 << k)).alias("length"), F.col("begin").alias("first"), "copies", F.col("n").alias("most"))
        stay = alike.select("pos", "length", "first", "copies", (F.col("most") - F.col("n") + 1).alias("most")).where("pos != first or most > 1")
        held = written(met.where("rank is null").drop("rank").unionByName(stay).unionByName(deeper), "held")
    held = held.where("length > 0")
    return held.where("pos != first").select("pos", "length", "first"), held.groupBy("length", "first").agg(F.sum("copies").alias("copies"))


def shortest_runs(words: np.ndarray, min_words: int) -> np.ndarray:
    """For each line the lines of the shortest run from it that has min_words words, 0 if there is none."""
    upto = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(upto, upto[:-1] + min_words)
    return np.where(end < len(upto), end - np.arange(len(words)), 0)


def _maximal_runs(min_words: int):
    """Of a segment's (start, length, first), those that no other holds and that have min_words words, with their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for at, words, runs in zip(batch.column("at").to_pylist(), batch.column("words"), batch.column("runs")):
                w = words.values.to_numpy()
                start, length, first = (runs.values.field(c).to_numpy() for c in range(3))
                need = shortest_runs(w, min_words)[start]
                end = start + length
                keep = (need > 0) & (length >= need)
                keep[1:] &= end[1:] > np.maximum.accumulate(end)[:-1]
                start, length, first, end = start[keep], length[keep], first[keep], end[keep]
                upto = np.concatenate([[0], np.cumsum(w, dtype=np.int64)])
                for column, v in zip(out, (np.full(len(start), at), start, length, upto[end] - upto[start], first)):
                    column.append(v)
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int32, np.int32, np.int64, np.int64))],
                                             names=["at", "start", "length", "words", "first"])

    return run


def repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, n_lines, gone, runs): for each document its number of lines, the numbers (from 0) of those to delete, and
    the maximal runs that hold them, by line: (line, lines, words, copies, first_doc_id, first_text_hash, first_line), of how many lines and words
    each is, how often it occurs in all documents, and where first.

    Lines are what `\\n` separates; runs are compared as they are, words are `[^\\x20\\x09-\\x0D]+`. A line goes if it is in a run of
    min_words words or more that also begins earlier, in the order of doc_id, the text's hash and the line. Runs may overlap, also with
    their earlier copy. Null and empty texts have no lines. Rows that repeat doc_id and text are one document, of which one row is
    returned; a null doc_id comes first in the order. An empty table gives an empty result; other columns are ignored.
    """
    text = F.col("text").cast("string")
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    docs = docs.mapInArrow(_lines, "doc_id long, th long, lines array<long>, words array<int>")
    docs = written(docs.groupBy("doc_id", "th").agg(F.first("lines").alias("lines"), F.first("words").alias("words")), "lines")
    segments = written(_segments(docs, min_words).withColumn("content", F.xxhash64("lines")).withColumn("n", F.size("lines")), "numbered")
    firsts = written(segments.groupBy("content", "n").agg(F.min("at").alias("at"), F.count("*").alias("weight")), "first-segments")
    reps = written(segments.join(firsts.select("at", "weight"), "at"), "representatives")
    places = _places(reps)
    earlier, intervals = _earlier_runs(places, _ranks(reps))
    found = places.select("pos", "at", "start").join(earlier, "pos").groupBy("at").agg(F.array_sort(F.collect_list(F.struct("start", "length", "first"))).alias("runs"))
    found = written(reps.select("at", "words").join(found, "at").mapInArrow(_maximal_runs(min_words), "at long, start int, length int, words long, first long"), "maximal-runs")
    inner = found.join(reps.select("at", "doc_id", "th", "first_line"), "at").select(
        "doc_id", "th", (F.col("first_line") + F.col("start")).alias("line"), "length", "words", "first")
    whole = firsts.where("weight > 1").join(found.where("start = 0").select("at", F.col("length").alias("n"), "first"), ["at", "n"], "left")
    whole = written(whole.select("content", F.col("n").alias("length"), F.coalesce("first", "at").alias("first")), "whole-segments")
    copies = segments.join(firsts.select("at"), "at", "left_anti").select(
        "doc_id", "th", F.col("first_line").alias("line"), F.col("n").alias("length"), F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w).alias("words"), "content")
    copies = copies.join(whole, ["content", "length"]).drop("content")
    alone = firsts.select(F.col("n").alias("length"), F.col("at").alias("first"), "weight")  # a segment that no other one holds
    runs = inner.unionByName(copies)
    kinds = runs.select("length", "first").distinct().join(intervals, ["length", "first"], "left").join(alone, ["length", "first"], "left").join(
        places.select(F.col("pos").alias("first"), F.col("doc_id").alias("first_doc"), F.col("th").alias("first_th"), F.col("line").alias("first_line")), "first")
    kinds = written(kinds.select("length", "first", F.coalesce("copies", "weight").alias("copies"), "first_doc", "first_th", "first_line"), "kinds-of-runs")
    at_first = F.struct(F.col("line"), F.col("length").alias("lines"), F.col("words"), F.col("copies"), _given_id("first_doc").alias("first_doc_id"),
                        F.col("first_th").alias("first_text_hash"), F.col("first_line"))
    runs = runs.join(kinds, ["length", "first"]).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(at_first)).alias("runs"))
    out = docs.select("doc_id", "th", F.size("lines").alias("n_lines")).join(runs, ["doc_id", "th"], "left")
    new = F.transform("runs", lambda x, i: F.sequence(
        F.greatest(x["line"], F.when(i > 0, F.get("runs", i - 1)["line"] + F.get("runs", i - 1)["lines"])), x["line"] + x["lines"] - 1))
    return out.select(_given_id("doc_id").alias("doc_id"), F.col("th").alias("text_hash"), "n_lines", F.coalesce(F.flatten(new), F.array().cast("array<int>")).alias("gone"),
                      F.coalesce("runs", F.array().cast(out.schema["runs"].dataType)).alias("runs"))


def without_repeats(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """documents with the repeated lines taken out of `text`; all other columns as they are. Null and empty texts stay."""
    cut = repeated_lines(documents, min_words).where(F.size("gone") > 0).select(
        F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), F.col("gone").alias("cut_lines"))
    row, text = F.struct(*documents.columns).alias("row"), F.col("row.text").cast("string")
    met = documents.select(row).join(cut, F.col("row.doc_id").cast("long").eqNullSafe(F.col("cut_id")) & (F.xxhash64(text) == F.col("cut_hash")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("cut_lines", i)), "\n")
    names = [F.when(F.col("cut_lines").isNull(), F.col("row.text")).otherwise(kept).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns]
    return met.select(*names)


def _run_text(r: Column) -> Column:
    """line+lines:words:copies@first document/first line"""
    first_id = F.coalesce(r["first_doc_id"].cast("string"), F.lit("null"))
    return F.concat(r["line"], F.lit("+"), r["lines"], F.lit(":"), r["words"], F.lit(":"), r["copies"], F.lit("@"), first_id, F.lit("/"), r["first_line"])


@register("op9_line_runs")
def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", F.size("gone").alias("n_deleted"), F.array_join("gone", ",").alias("deleted"), F.array_join(F.transform("runs", _run_text), ",").alias("runs"))
