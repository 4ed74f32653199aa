"""Exact SentencePiece encoding of merge-type models by backtracking, and decoding.

The model merges characters pair by pair, the best-scored piece first, the leftmost among equals. An encoding of that kind can be
checked locally: a row of pieces is the encoding if each two neighbours, merged anew alone, stay these two pieces. So the encoder goes
forward with the longest piece at each place, which an Aho-Corasick automaton finds, falls back to the next shorter one
where neighbours don't fit, and steps back where none does. A bit for each place remembers that nothing fits from there, so that no place
is tried twice.

Texts are first cut where no piece of the vocabulary reaches across: before a space, and around white space that no piece has.
A worker keeps the ids of short cuts.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlake.llm.common import register, row_groups, table, text_bytes

MODEL = "piece_bpe_32k.model"
SPACE = "▁"  # fixed value: the sign for a space
UNKNOWN_TEXT = " ⁇ "  # fixed value: what the unknown id decodes to
SLICE = 1 << 20
CACHE_CUTS = 1 << 18
CACHED_LENGTH = 64

_models: dict[bytes, "Pieces"] = {}


def pieces_of(model: bytes) -> "Pieces":
    """The model of these bytes, built once in a worker."""
    if model not in _models:
        _models.clear()
        _models[model] = Pieces(model)
    return _models[model]


def model_bytes(path: str | None = None) -> bytes:
    """The vocabulary file, read on the driver and sent to the tasks with the code."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


class Kept(dict):
    """Answers for short cuts, in two generations: when the younger is full it becomes the older, so that frequent cuts stay."""

    def __init__(self, answer, limit: int = CACHE_CUTS):
        self.answer, self.limit, self.older = answer, limit, {}

    def __missing__(self, cut: str):
        out = self.older.get(cut)
        if out is None:
            out = self.answer(cut)
        if len(cut) <= CACHED_LENGTH:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[cut] = out
        return out


class Pieces:
    """A vocabulary with scores, and the checks that make its encoding."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_proto=model)
        if read.normalize(" a  ﬁ\t ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}ﬁ\t{SPACE}":
            raise ValueError("a model that only marks spaces and adds one in front is needed")
        n = read.get_piece_size()
        self.text = [read.id_to_piece(i) for i in range(n)]
        self.bos, self.eos, self.unknown = read.bos_id(), read.eos_id(), read.unk_id()
        self.control = frozenset(i for i in range(n) if read.is_control(i))
        self.byte_of = {i: int(self.text[i][3:5], 16) for i in range(n) if read.is_byte(i)}
        if len(self.byte_of) != 256 or any(read.is_unused(i) for i in range(n)):
            raise ValueError("a model with all byte pieces and without unused ones is needed")
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.id = {self.text[i]: i for i in range(n) if not (i in self.control or i in self.byte_of or i == self.unknown)}
        self.score = [read.get_score(i) for i in range(n)]
        self.length = array("i", map(len, self.text))
        self.widest = max(map(len, self.id))
        self.characters = {c for piece in self.id for c in piece}
        self.search = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.search.add_word(piece, i)
        self.search.make_automaton()
        # what each id decodes to; byte pieces to their byte
        self.bytes = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.control else UNKNOWN_TEXT.encode() if i == self.unknown
                      else self.text[i].replace(SPACE, " ").encode() for i in range(n)]
        self._shorter: dict[int, int] = {}
        self._alone: dict[int, bool] = {}
        self._fits: dict[int, bool] = {}
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.id):  # a piece goes over a word's end: no cuts
            self.cut = self.slice_end = None
        else:
            apart = "".join(c for c in "\n\t\r\x0b\x0c" if c not in self.characters)
            self.cut = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + (f"|[{apart}]" if apart else ""))
            self.slice_end = re.compile(f"[^{SPACE}](?={SPACE})")
        self.cuts = Kept(self._packed)

    # ---- the model's own rule, for short strings ----

    def merged(self, text: str) -> list[str]:
        """Characters merged pair by pair: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def alone(self, i: int) -> bool:
        """Whether a piece's own text merges to that piece."""
        ok = self._alone.get(i)
        if ok is None:
            ok = self._alone[i] = self.merged(self.text[i]) == [self.text[i]]
        return ok

    def fits(self, a: int, b: int) -> bool:
        """Whether piece b, and a and b side by side, merged anew, stay what they are; a is -1 at the start."""
        if len(self._fits) >= 4 * CACHE_CUTS:
            self._fits.clear()
        parts = [self.text[a], self.text[b]] if a >= 0 else [self.text[b]]
        ok = self._fits[a << 32 | b] = self.alone(b) and self.merged("".join(parts)) == parts
        return ok

    def shorter(self, i: int) -> int:
        """The longest piece that a piece starts with, other than itself; -1 without one."""
        j = self._shorter.get(i)
        if j is None:
            text = self.text[i]
            j = self._shorter[i] = next((self.id[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.id), -1)
        return j

    # ---- backtracking ----

    def _known(self, text: str) -> array:
        """Ids of a text whose characters are all pieces."""
        n, length, search, widest, fits = len(text), self.length, self.search, self.widest, self._fits
        failed = None
        out = array("i")
        pos, last, i = 0, -1, -1
        while pos < n:
            if i == -1:
                i = next(search.iter_long(text[pos:pos + widest]))[1]
            while i >= 0:
                key = last << 32 | i
                ok = fits.get(key)
                if ok is None:
                    ok = self.fits(last, i)
                if ok:
                    end = pos + length[i]
                    if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                        break
                i = self.shorter(i)
            if i >= 0:
                out.append(i)
                pos, last, i = end, i, -1
            else:  # no piece goes on from here
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                last = out.pop()
                pos -= length[last]
                i, last = self.shorter(last), out[-1] if out else -1
                if i < 0:
                    i = -2
        return out

    def encode_cut(self, cut: str) -> array:
        """Ids of a part of a text that no piece crosses the ends of. Characters without a piece become their bytes."""
        if self.characters.issuperset(cut):
            return self._known(cut)
        out, start = array("i"), 0
        for k, c in enumerate(cut):
            if c not in self.characters:
                out.extend(self._known(cut[start:k]))
                out.extend(self.byte_id[b] for b in c.encode())
                start = k + 1
        out.extend(self._known(cut[start:]))
        return out

    def _packed(self, cut: str) -> bytes:
        """Ids of a cut as little-endian 32-bit numbers."""
        ids = self.encode_cut(cut)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, without control ids."""
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        if self.cut is None:
            return self.cuts[marked]
        out, at = [], 0
        while at < len(marked):
            stop = self.slice_end.search(marked, at + SLICE) if len(marked) - at > SLICE else None
            end = stop.end() if stop else len(marked)
            out.append(b"".join([self.cuts[c] for c in self.cut.findall(marked, at, end)]))
            at = end
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids: control ids vanish, the space in front goes, broken bytes become U+FFFD each."""
        parts = [b"".join(map(self.bytes.__getitem__, ids[a:a + SLICE].tolist())) for a in range(0, len(ids), SLICE)]
        out = b"".join(parts)
        try:
            out.decode()
            whole = not np.isin(ids[1:-1], list(self.control)).any()  # a control id ends a run of bytes
        except UnicodeDecodeError:
            whole = False
        if not whole:
            out = self._mended(ids)
        first = next((int(i) for i in ids if int(i) not in self.control), None)
        spaced = first is not None and self.text[first].startswith(SPACE) and first not in self.byte_of
        return out[1:] if spaced else out

    def _mended(self, ids: np.ndarray) -> bytes:
        out, run = [], bytearray()
        for i in [*ids.tolist(), None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        run[:n].decode()
                    except UnicodeDecodeError:
                        continue
                    break
                else:
                    n = 0
                out.append(bytes(run[:n]) if n else "�".encode())
                del run[:n or 1]
            if i is not None:
                out.append(self.bytes[i])
        return b"".join(out)


# ---- jobs ----

def _encoding(model: bytes, ends: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        before, after = (np.array([i], "<u4").tobytes() if ends else b"" for i in (pieces.bos, pieces.eos))
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for lo, hi in row_groups(offsets):
                ids = [before + pieces.encode(t or "") + after for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                                                 names=["doc_id", "n_tokens", "ids"])

    return run


def encode_texts(documents: DataFrame, model: bytes | None = None, ends: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row: ids are little-endian unsigned 32-bit numbers, with begin and end ids if `ends`.

    A null text counts as empty, and an empty one has only its begin and end ids. Every row gives one row, also if a doc_id
    repeats or is null. Other columns are ignored; an empty table gives none.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encoding(model or model_bytes(), ends), "doc_id long, n_tokens long, ids binary")


def _decoding(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            column = batch.column(2)
            _, offsets = text_bytes(column.fill_null(b""))
            for lo, hi in row_groups(offsets):
                part = batch.slice(lo, hi - lo)
                texts = [pieces.decode(np.frombuffer(x or b"", "<u4")) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return run


def decode_ids(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """Adds the decoded text to rows of (doc_id, n_tokens, ids)."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decoding(model or model_bytes()), "doc_id long, n_tokens long, ids binary, text string")


@register("op12_pieces")
def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = model_bytes()
    found = decode_ids(encode_texts(table(spark, sf_dir, "documents"), model), model)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
