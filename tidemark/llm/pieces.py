"""SentencePiece models on the tokenizers library.

A ``.model`` file is read with a small protobuf reader and rebuilt: normaliser, the blank marker, piece scores
(or the merges that they imply) and byte fallback. If no piece has a blank marker after another
character, no piece crosses the start of a run of blanks, and a text may be encoded chunk by
chunk; a task then encodes each distinct chunk once, in multithreaded batches.

Parity is verified against the original library with the untouched model file: it normalises every whole text, which
must give what the rebuilt normaliser gave, and every distinct chunk must get the same pieces. A
text of which either fails is encoded anew by that library, whole; all others have the rebuilt model's pieces.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from tidemark.llm.rows import released

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
HELD = 1 << 16  # distinct chunks whose pieces a task keeps, in each of two generations
BLOCK = 1 << 13  # chunks in one batch of the library
SHORT = 256  # longer chunks are not kept
SLICE = 1 << 20  # characters of texts that are split at once


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message."""
    at, size = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < size:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        elif kind in (1, 5):
            width = 8 if kind == 1 else 4
            value, at = data[at: at + width], at + width
        elif kind == 2:
            length = varint()
            value, at = data[at: at + length], at + length
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


@dataclass
class PieceModel:
    """What encoding needs of a model file; the defaults are those of the format."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_mark: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    single_blanks: bool = True
    unknown_surface: str = " ⁇ "

    @staticmethod
    def parse(data: bytes) -> PieceModel:
        m = PieceModel([], [], [])
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                m.pieces.append(piece)
                m.scores.append(score)
                m.types.append(kind)
            elif number == 2:
                for n, v in fields(value):
                    if n == 3:
                        m.kind = v
                    elif n == 35:
                        m.byte_fallback = bool(v)
                    elif n == 24:
                        m.suffix_mark = bool(v)
                    elif n == 44:
                        m.unknown_surface = v.decode()
            elif number == 3:
                for n, v in fields(value):
                    if n == 2:
                        m.charsmap = v
                    elif n == 3:
                        m.dummy_prefix = bool(v)
                    elif n == 4:
                        m.single_blanks = bool(v)
        if m.kind not in (UNIGRAM, BPE) or m.suffix_mark or UNKNOWN not in m.types:
            raise ValueError("only unigram and BPE models with a leading blank marker are rebuilt")
        return m

    @property
    def unknown(self) -> int:
        return self.types.index(UNKNOWN)

    @property
    def splits(self) -> bool:
        """Whether no piece crosses the start of a run of blanks."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, t in zip(self.pieces, self.types)
                       if t in (NORMAL, USER))

    def normaliser(self) -> normalizers.Normalizer | None:
        steps: list = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.single_blanks:
            steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Replace(Regex("^ | $"), "")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        steps.append(normalizers.Replace(" ", MARK))
        return normalizers.Sequence(steps)

    def backend(self) -> Tokenizer:
        """The piece model alone: it takes normalised text."""
        ids = {p: k for k, p in enumerate(self.pieces)}
        if self.kind == UNIGRAM:
            model = models.Unigram(list(zip(self.pieces, self.scores)), self.unknown, self.byte_fallback)
        else:
            usable = {p for p, t in zip(self.pieces, self.types) if t in (NORMAL, USER)}
            merges = []
            for piece in usable:
                for k in range(1, len(piece)):
                    left, right = piece[:k], piece[k:]
                    if left in usable and right in usable:
                        merges.append((-self.scores[ids[piece]], ids[piece], ids[left], ids[right], left, right))
            model = models.BPE(ids, [m[-2:] for m in sorted(merges)], unk_token=self.pieces[self.unknown],
                               fuse_unk=True, byte_fallback=self.byte_fallback)
        return Tokenizer(model)

    def tokenizer(self) -> Tokenizer:
        """The whole model, from text to pieces and back."""
        tok = self.backend()
        tok.normalizer = self.normaliser()
        if self.splits:
            tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+"), "merged_with_next")
        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        tok.decoder = decoders.Sequence([*steps, decoders.Strip(" ", 1, 0)] if self.dummy_prefix else steps)
        return tok


class Encoder:
    """Chunk-wise encoding in one Python worker."""

    def __init__(self, data: bytes, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = PieceModel.parse(data)
        self.backend = self.model.backend()
        self.plain = not self.model.charsmap and not self.model.single_blanks
        self.normaliser = self.model.normaliser()
        self.chunk = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if self.model.splits else r"(?s).+")
        self.original = sentencepiece.SentencePieceProcessor()
        self.original.LoadFromSerializedProto(data)
        # the same on chunks, which are normalised already
        self.on_chunks = sentencepiece.SentencePieceProcessor()
        self.on_chunks.LoadFromSerializedProto(_without_normaliser(data))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd: set[str] = set()  # kept chunks without parity

    def normalised(self, text: str) -> str:
        if not self.plain:
            return self.normaliser.normalize_str(text)
        marked = text.replace(" ", MARK)
        return MARK + marked if marked and self.model.dummy_prefix else marked

    def _encode(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        ours = self.backend.encode_batch_fast(chunks, add_special_tokens=False)
        theirs = self.on_chunks.encode(chunks, num_threads=1)
        for c, a, b in zip(chunks, ours, theirs):
            if a.ids != b:
                self.odd.add(c)
            yield c, array("i", a.ids).tobytes()

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bool]]:
        """Piece ids of each text, and whether both libraries agree; where not, they are the original's."""
        plain = [self.normalised(t or "") for t in texts]
        theirs = self.original.normalize([t or "" for t in texts])
        split = [self.chunk.findall(t) for t in plain]
        distinct = set().union(*split)
        known = self.young
        for c in distinct - known.keys() & self.old.keys():
            known[c] = self.old[c]
        new = list(distinct - known.keys())
        for k in range(0, len(new), BLOCK):
            known.update(self._encode(new[k: k + BLOCK]))
        ids = [np.frombuffer(b"".join([known[c] for c in chunks]), np.int32) for chunks in split]
        parity = [a == b and self.odd.isdisjoint(chunks) for a, b, chunks in zip(plain, theirs, split)]
        for k, same in enumerate(parity):
            if not same:
                ids[k] = np.array(self.original.encode(texts[k] or ""), np.int32)
        if len(known) > HELD:
            # chunks that come again move to the next generation, the others are dropped
            self.old, self.young = {c: v for c, v in known.items() if len(c) <= SHORT}, {}
            self.odd &= self.old.keys()
        return ids, parity

    def forget(self) -> None:
        """Drop kept chunks, so that a worker that goes on to other tasks holds the model alone."""
        self.young, self.old, self.odd = {}, {}, set()


def _without_normaliser(data: bytes) -> bytes:
    """The model file with a normaliser that changes nothing."""
    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    spec = b"\x0a\x08identity" + b"\x18\x00" + b"\x20\x00" + b"\x28\x00"
    out = []
    for number, value in fields(data):
        if number == 3:
            continue
        body = value if isinstance(value, bytes) else varint(value)
        out.append(varint(number << 3 | 2) + varint(len(body)) + body)
    out.append(b"\x1a" + varint(len(spec)) + spec)
    return b"".join(out)


@cache
def _encoder(data: bytes, threads: int) -> Encoder:
    return Encoder(data, threads)


def read_model(spark, path: str) -> bytes:
    """The bytes of a model file; a path with a scheme is read by Spark."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    with open(path, "rb") as f:
        return f.read()


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    values, at, size = [], 0, 0
    for k, t in enumerate(texts):
        text = t.as_py()
        values.append(text)
        size += len(text or "")
        if size > SLICE or k == len(texts) - 1:
            yield at, values
            values, at, size = [], k + 1, 0


class Decoder:
    """Bytes of every piece, side by side."""

    def __init__(self, data: bytes):
        model = PieceModel.parse(data)
        self.strip = model.dummy_prefix or model.single_blanks
        surface = []
        for piece, kind in zip(model.pieces, model.types):
            if kind == CONTROL:
                surface.append(b"")
            elif kind == UNKNOWN:
                surface.append(model.unknown_surface.encode())
            elif kind == BYTE:
                surface.append(bytes([int(piece[3:5], 16)]))
            else:
                surface.append(piece.replace(MARK, " ").encode())
        self.size = np.array([len(s) for s in surface], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(surface), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        size = self.size[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        text = self.data[at].tobytes().decode(errors="replace")
        return text[1:] if self.strip and text.startswith(" ") else text


@cache
def _decoder(data: bytes) -> Decoder:
    return Decoder(data)


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def encode(docs: DataFrame, model: bytes, text: str = "text", out: str = "ids", threads: int = 2,
           restored: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (piece numbers) and ``parity``; batches are encoded by ``threads`` threads.

    ``parity`` tells whether the rebuilt model gave the original library's normalised text and pieces; where it did
    not, and only there, ``ids`` are the original's. With ``restored``, that column tells whether decoding the pieces gives
    the text again. Null and empty texts have no pieces, are at parity and restored. All columns
    and rows are kept; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, threads)
        decoder = _decoder(shared.value) if restored else None
        for batch in batches:
            for begin, texts in _runs(batch.column(at)):
                ids, parity = encoder.encode(texts)
                part = batch.slice(begin, len(texts))
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                more = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())), pa.array(parity)]
                if restored:
                    more.append(pa.array([decoder.decode(i) == (t or "") for i, t in zip(ids, texts)]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *more], names=[*batch.schema.names, out, "parity", "restored"][: len(part.columns) + len(more)])
        encoder.forget()

    return docs.mapInArrow(lambda it: released(run(it)), _schema(docs, f"`{out}` array<int>", "parity boolean",
                                        *(["restored boolean"] if restored else [])))


def decode(docs: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of its piece numbers. Null lists give the empty text; broken byte runs a replacement sign."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(shared.value)
        for batch in batches:
            lists = batch.column(at)
            values = np.asarray(lists.values)
            offsets = np.asarray(lists.offsets)
            empty = np.asarray(lists.is_null())
            texts = ["" if e else decoder.decode(values[a:b])
                     for e, a, b in zip(empty, offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, out])

    return docs.mapInArrow(run, _schema(docs, f"`{out}` string"))


def digest_of(ids: Column) -> Column:
    """SHA-256 of the numbers as text, joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
