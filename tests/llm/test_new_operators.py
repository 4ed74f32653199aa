"""Resampling, pieces and tokenizer alignment against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hostlake.llm import alignment, pieces, resample

ODD = [None, "", " ", "   ", "\n\n", "a", "été, 日本 \x00 <s> <unk> <0x41> <|endoftext|>", "▁a ▁▁", "don't 's  x\r\ny;\r", "word " * 3000, "x" * 5000, "ab" * 700 + "é" * 9,
       "\U0001F600 é \x85 \x1c!\xa0 　", "the same text, twice", "the same text, twice"]


def documents(spark, texts, shift=0):
    rows = [(k + shift if k % 7 else None if k == 7 else k, t, 1, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(rows[1][0], "a repeated id", 2, "y")], "doc_id LONG, text STRING, score INT, rank STRING")


def letters(rng, n):
    parts = ["a", "in", "the", " ", "  ", "\n", "\t", "er", "é", "日", "▁", ",", ".", "'s", "0", "7", "Th", "\r", "ing", "ﬁ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def drawn(docs, target, percent, min_words, longest, buckets, seed):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        w = word.findall((text or "").translate(low))
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)

    s, t = (Counter(b for text in side for b in features(text)[0]) for side in ([x for _, x in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in docs:
        f, words = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    k = percent * len(able) // 100
    return sorted(map(repr, [(*r[:4], i + 1) for i, r in enumerate(able[:k])] + [(*r[:4], None) for r in able[k:]] + [(*r[:4], None) for r in out if r[4] < min_words]))


@pytest.mark.parametrize("percent,min_words,longest,buckets", [(10, 20, 1, 10000), (50, 0, 1, 7), (100, 1, 2, 500), (0, 1, 1, 10), (33, 2, 3, 1000)])
def test_resample(spark, percent, min_words, longest, buckets):
    rng = random.Random(3)
    docs = documents(spark, ODD + ["Word wórd " * rng.randint(1, 30) + t for t in letters(rng, 80)])
    target = spark.createDataFrame([("the word in Thing",), (None,), ("the x" * 50,)], "text STRING")
    got = resample.resample(docs, target, percent, min_words, longest, buckets).collect()
    want = drawn([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], percent, min_words, longest, buckets, resample.SEED)
    assert sorted(repr(tuple(r)) for r in got) == want


def test_resample_of_nothing(spark):
    docs, none = documents(spark, ODD), spark.createDataFrame([], "text STRING")
    assert resample.resample(docs.limit(0), none).collect() == [] and resample.resample(docs, none).count() == len(ODD) + 1


def test_bracket_holds_the_place(spark):
    """Ties over most of the table, and a sketch so rough that brackets must widen."""
    scores = [5] * 900 + list(range(-40, 60))
    rows = spark.createDataFrame([(k, s, 1, 1) for k, s in enumerate(scores)], "doc_id LONG, score LONG, n_features LONG, weight LONG")
    for k in (1, 40, 54, 55, 500, 954, 955, 1000):
        low, high, above = resample.bracket_of(rows, k, 1000, accuracy=20)
        assert above == sum(s > high for s in scores) < k <= sum(s >= low for s in scores)
    order = [r["doc_id"] for r in resample.ranked(rows, "t").orderBy("position").collect()]
    assert order == sorted(range(1000), key=lambda k: (-scores[k], k))


def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    rng, p = random.Random(5), pieces.pieces_of(pieces.model_bytes())
    vocabulary = list(p.id)
    texts = ODD + letters(rng, 800) + ["".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 8))) for _ in range(3000)] + [c * n for c in "a▁ é" for n in range(1, 40)]
    docs = documents(spark, texts)
    got = pieces.decode_ids(pieces.encode_texts(docs)).collect()
    given = docs.collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in given]
    for r, g in zip(got, given):
        ids = library.encode(g["text"] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids) and r["text"] == library.decode(ids), g["text"]
    for _ in range(2000):  # ids that no text has
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, len(p.text) - 1)]) for _ in range(rng.randint(0, 8))]
        assert p.decode(np.array(ids, "<u4")).decode() == library.decode(ids), ids
    assert pieces.encode_texts(docs.limit(0)).collect() == []


def by_libraries(text, first, second, spelled):
    """Tokens, links and groups of one text with both libraries, over all pairs of ends."""
    a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
    sides = [[spelled[0][i] for i in a], [spelled[1][i] for i in b]]
    if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
        return 0, 0, [], ""
    ends = [np.cumsum(list(map(len, s))).tolist() for s in sides]
    at, groups, links = [0, 0], [], []
    for end in sorted(set(ends[0]) & set(ends[1])):
        to = [e.index(end) + 1 for e in ends]
        groups.append("|".join(",".join(map(str, ids[f:t])) for ids, f, t in zip((a, b), at, to)))
        links.append((a[to[0] - 1], b[to[1] - 1]))
        at = to
    return len(a), len(b), links, ";".join(groups)


@pytest.mark.parametrize("parts", [1, 6])
def test_alignment_equals_the_libraries(spark, parts):
    """In one chunk, and in one for each of six tasks."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_str(alignment.first_bytes().decode()), sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    first.encode_special_tokens = True
    aligner = alignment.aligner_of(alignment.first_bytes(), pieces.model_bytes())
    spelled = aligner.a_bytes, [bytes([int(t[3:5], 16)]) if second.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(map(second.id_to_piece, range(second.get_piece_size())))]
    docs = documents(spark, [t[:300] if t else t for t in ODD] + letters(random.Random(9), 300)).coalesce(parts)
    given = docs.collect()
    found = [by_libraries(r["text"], first, second, spelled) for r in given]
    counts = Counter(link for f in found for link in f[2])
    top = {b: max(n for (_, y), n in counts.items() if y == b) for _, b in counts}
    want = [(r["doc_id"], f[0], f[1], len(f[2]), len(f[2]), sum(counts[x] == top[x[1]] for x in f[2]), sum(counts[x] for x in f[2]), f[3]) for r, f in zip(given, found)]
    assert sorted(repr(tuple(r)) for r in alignment.align_tokenizers(docs).collect()) == sorted(map(repr, want))
    assert alignment.align_tokenizers(docs.limit(0)).collect() == []
    _, pairs = alignment.pair_counts(alignment.aligned(docs)[1])
    have = {(r["a"], r["b"]): (r["documents"], r["links"], r["best"]) for r in pairs.collect()}
    held = Counter(x for f in found for x in set(f[2]))
    assert have == {x: (held[x], n, n == top[x[1]]) for x, n in counts.items()}


def test_bitmaps_of_a_chunk():
    """Few and many documents of a pair, many links of one pair in one document."""
    rng = np.random.default_rng(4)
    pairs, places = np.divmod(np.unique(rng.integers(0, 60 * 500, 9000)), 500)
    keep = places % (1 + pairs) == 0
    pairs, places = pairs[keep] * 1_000_003, places[keep]
    times = rng.integers(1, 40, len(pairs))
    row = alignment.bitmaps(pairs, places, times, 500) | {"n_documents": 500}
    assert any(map(len, row["dense"])) and any(map(len, row["pairs"]))
    every, documents_, links = alignment.counted(row)
    assert documents_.tolist() == [int((pairs == p).sum()) for p in every] and links.tolist() == [int(times[pairs == p].sum()) for p in every]
    back = alignment.returned(row, every, links)
    assert back.tolist() == [int(sum(t * links[np.searchsorted(every, p)] for p, t in zip(pairs[places == d], times[places == d]))) for d in range(500)]
    assert alignment.counted(alignment.bitmaps(pairs[:0], places[:0], times[:0], 3) | {"n_documents": 3})[0].tolist() == []
