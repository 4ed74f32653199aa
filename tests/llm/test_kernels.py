"""Hashing of words and lines, packing, tiling, codes, ZIP parsing and graphs against plain Python."""

import io
import itertools
import random
import re
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from hostlake.llm import decontaminate, langid, line_dedup, near_dedup, packing, quality, vector_search, warc_zip
from hostlake.llm.common import byte_classes, row_groups, shingle_hashes, text_bytes, word_hashes, xxhash64_of_longs

TEXTS = ["", None, "one", "Ä ß ñ  x\ty\nz", "The THE the", " lead and trail ", "a" * 5000 + " b", "x y " * 3000, "tok\x0bsep\x0cmore", "日本 語", "x y x y"]


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0d]+", text or "")]


@pytest.mark.parametrize("step", [64, 1 << 18])
def test_word_hashes_are_those_of_the_words(step):
    data, offsets = text_bytes(pa.array(TEXTS))
    seen = {}
    for lo, hi in row_groups(offsets, 1 << 12):
        hashes, at, _ = word_hashes(data, offsets[lo:hi + 1], byte_classes(), step)
        for row in range(lo, hi):
            got, want = hashes[at[row - lo]:at[row - lo + 1]].tolist(), words_of(TEXTS[row])
            assert len(got) == len(want)
            for h, w in zip(got, want):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sliced_arrays_and_shingles():
    assert [len(s) for s in near_dedup.shingle_sets(pa.array(["x", "a b", "a b c d e f", None, "r r r r r r r"]).slice(1))] == [1, 2, 0, 1]
    assert len(shingle_hashes(np.zeros(3, np.uint64), 5)) == 0


def test_bits_use_sparks_hash(spark):
    from pyspark.sql import functions as F

    ids = [0, 1, -5, 1 << 40, -(1 << 63), (1 << 63) - 1]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(F.xxhash64("i")).collect()]
    assert xxhash64_of_longs(np.array(ids)).view(np.int64).tolist() == got


def test_circulant_coordinates():
    sigma, shifted = near_dedup._permutations(near_dedup.SEED)
    pi, d = shifted[:, 0], len(sigma)
    s = np.array([3, 99, 12345678901234567], np.uint64)
    cells = [int(sigma[int(x) % d]) for x in s]
    want = [min(int(pi[(c + k) % d]) for c in cells) for k in range(128)]
    assert near_dedup.signature(s).tolist() == want
    assert sorted(sigma.tolist()) == list(range(d)) and len(set(pi.tolist())) == d


def test_tokens_and_pieces_round_trip():
    encoder = packing.Encoder(open(packing.VOCABULARY, "rb").read())
    texts = TEXTS + ["it's 's 5 a", "a \n b", "\x85 a", "ÿ ÿ", "× ×", " x ", "b", "a  b  ", "x  y"]
    for _ in range(2):  # the second time from the cache
        got = list(encoder.encode(pa.array(texts)))
        assert [g.tolist() for g in got] == [encoder.bpe.encode_ordinary(t or "") for t in texts]


def test_best_fit_decreasing_is_the_plain_one():
    rng = random.Random(1)
    for _ in range(200):
        room = rng.choice([5, 16, 33])
        lengths = [rng.randint(1, room) for _ in range(rng.randint(1, 60))]
        left, stamp, want = [], [], [0] * len(lengths)
        for clock, p in enumerate(sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)), 1):
            fits = [(left[r], -stamp[r], r) for r in range(len(left)) if left[r] >= lengths[p]]
            if fits:
                r = min(fits)[2]
            else:
                left.append(room)
                stamp.append(0)
                r = len(left) - 1
            left[r] -= lengths[p]
            stamp[r], want[p] = clock, r
        assert packing.best_fit_decreasing(np.array(lengths), room).tolist() == want


def greedy_tiles(doc, item, k):
    taken_d, taken_i, out = set(), set(), []
    while True:
        best = None
        for a, b in itertools.product(range(len(doc)), range(len(item))):
            n = 0
            while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and a + n not in taken_d and b + n not in taken_i:
                n += 1
            if n >= k and (best is None or (-n, a, b) < best):
                best = (-n, a, b)
        if best is None:
            return out
        n, a, b = -best[0], best[1], best[2]
        taken_d.update(range(a, a + n))
        taken_i.update(range(b, b + n))
        out.append((a, b, n))


def test_tiles_are_greedy():
    rng = random.Random(3)
    for _ in range(150):
        doc, item, k = [rng.randint(0, 3) for _ in range(rng.randint(0, 25))], [rng.randint(0, 3) for _ in range(rng.randint(2, 14))], 2
        at = [(a, b) for a in range(len(doc) - k + 1) for b in range(len(item) - k + 1) if doc[a:a + k] == item[b:b + k]]
        if at:
            d, i = (np.array(x) for x in zip(*at))
            assert decontaminate.tiles(d, i, len(item), k) == greedy_tiles(doc, item, k)


def test_codewords_keep_languages_apart():
    for n in (2, 3, 4, 5, 9, 40):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n
        assert min((np.count_nonzero(code[a] != code[b]) for a, b in itertools.combinations(range(n), 2))) >= (1 if n == 2 else 2)


def test_shortest_runs():
    assert line_dedup.shortest_runs(np.array([3, 0, 8, 10, 1]), 10).tolist() == [3, 3, 2, 1, 0]


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_members(zip64):
    data = warc_zip.zip_stored([("a.txt", b"hello"), ("dir/é", b""), (warc_zip.INDEX, b"x" * 1000)], zip64)
    ours = warc_zip.stored_members(warc_zip.Ranges(data))
    theirs = zipfile.ZipFile(io.BytesIO(data))
    assert theirs.testzip() is None and set(ours) == set(theirs.namelist())
    assert all(data[a:a + n] == theirs.read(name) for name, (a, n) in ours.items())


def test_zip_of_another_writer():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        f.writestr("q.txt", "plain")
        f.writestr("d.txt", "def" * 99, compress_type=zipfile.ZIP_DEFLATED)
        f.comment = b"PK\x05\x06 comment"
    data = out.getvalue()
    members = warc_zip.stored_members(warc_zip.Ranges(data))
    assert list(members) == ["q.txt"] and data[members["q.txt"][0]:][:5] == b"plain"
    with pytest.raises(ValueError):
        warc_zip.stored_members(warc_zip.Ranges(b"no archive"))
    with pytest.raises(ValueError):
        warc_zip.Ranges(b"abc").read(2, 5)


def test_small_graphs_reach_every_node():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 33, 70, 300):
        x = rng.normal(size=(n, 8))
        graph = vector_search.build(x)
        asked = np.concatenate([x[:3], np.zeros((min(n, 3), 1))], axis=1).astype(np.float32)
        found = graph.search(asked, 400)
        assert all(set(r[r >= 0]) == set(range(n)) for r in found)


def test_training_separates_and_repeats_nothing_random():
    rng = np.random.default_rng(2)
    examples = [(np.unique(np.concatenate([rng.integers(10, 500, 20), [1 + k % 2]])).astype(np.int32), None, k % 2) for k in range(200)]
    examples = [(i, np.full(len(i), 0.5, np.float32), y) for i, _, y in examples]
    w = quality.train(examples)
    assert np.array_equal(w, quality.train(examples)) and w[2] > 0 > w[1]
