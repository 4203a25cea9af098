"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read here (no generated classes); normaliser, marker
of white space, scores (unigram) or merges by score (BPE) and byte fallback are
rebuilt as a tokenizer, whose ids are what is returned. Texts are cut before each
run of markers, across which no piece of such a vocabulary reaches. Distinct chunks
are encoded in multithreaded batches (words that begin with one marker in blocks,
as each begins with the one id that has a marker) and kept in a bounded cache.

Parity: the sentencepiece library encodes every block too, and the ids are decoded
again; where either differs, the block is taken chunk by chunk, and of a chunk on
which the libraries differ the row says so and takes the library's ids.

A vocabulary with a piece that does reach across a marker is encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from . import common

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: No id is this large.
FLAG = 0xFFFFFFF0
#: Words that are encoded as one string.
BLOCK = 256
SPACE = re.compile(f"(?<=[^ {MARK}]) ")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; fixed-width and nested values as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


class ModelFile:
    """The parts of a sentencepiece model that encoding needs."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk = UNIGRAM, False, 0
        self.charsmap, self.dummy_prefix, self.squeeze = b"", True, True
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(fields(value))
                self.kind, self.byte_fallback, self.unk = own.get(3, UNIGRAM), bool(own.get(35, 0)), own.get(40, 0)
            elif number == 3:
                own = dict(fields(value))
                self.charsmap = own.get(2, b"")
                self.dummy_prefix, self.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that make a piece, best score first."""
        usable = {p: (s, k) for k, (p, s, t) in enumerate(self.pieces) if t in (NORMAL, USER)}
        found = [(-s, k, cut, p) for p, (s, k) in usable.items() for cut in range(1, len(p)) if p[:cut] in usable and p[cut:] in usable]
        return [(p[:cut], p[cut:]) for _, _, cut, p in sorted(found)]

    def tokenizer(self) -> Tokenizer:
        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk, self.byte_fallback)
        elif self.kind == BPE:
            model = models.BPE({p: k for k, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are known")
        out = Tokenizer(model)
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        return out

    def normalizer(self) -> normalizers.Normalizer:
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        return normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])


class PieceCodec:
    def __init__(self, data: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # a task owns one core or a few
        self.file = ModelFile(data)
        self.tokenizer, self.library = self.file.tokenizer(), sentencepiece.SentencePieceProcessor(model_proto=data)
        self.plain = not self.file.charsmap and not self.file.squeeze
        self.normalizer = self.file.normalizer()
        # pieces of markers alone may reach over one another, but not from a word to the next
        self.cuts = not any(MARK in p.lstrip(MARK) for p, _, _ in self.file.pieces)
        self.chunk = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.is_byte = np.array([t == BYTE for _, _, t in self.file.pieces])
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.file.pieces])
        # words that single spaces part need no normaliser and can be encoded in blocks
        self.blocks = self.plain and self.cuts and self.file.dummy_prefix and self.file.byte_fallback
        self.chunks, self.words = common.ChunkCache(self._encode, 50_000), common.ChunkCache(self._encode_words, 150_000)

    def normalise(self, text: str, first: bool = True) -> str:
        text = text.replace(" ", MARK) if self.plain else self.normalizer.normalize_str(text)
        return MARK + text if text and first and self.file.dummy_prefix else text

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """The ids; where ids of both libraries differ (1) or do not decode to the chunk (2), FLAG and these numbers come first."""
        ours = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        first = MARK if self.file.dummy_prefix else ""
        theirs = self.library.encode([c.removeprefix(first) for c in chunks])
        # the library gives an empty text no marker, so a marker by itself is its piece
        theirs = [b if c != first else [self.library.piece_to_id(MARK)] for b, c in zip(theirs, chunks)]
        ids = [a if a == b else b for a, b in zip(ours, theirs)]
        texts = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        out = []
        for a, b, i, t, c in zip(ours, theirs, ids, texts, chunks):
            flags = (a != b) | (t != c.replace(MARK, " ")) << 1
            out.append(array("I", [FLAG + flags, *i] if flags else i).tobytes())
        return out

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """The same for words without markers, each of which gets one."""
        texts = b" ".join(words).decode("utf-8", "replace").split(" ")
        blocks = [texts[k : k + BLOCK] for k in range(0, len(texts), BLOCK)]
        ours = self.tokenizer.encode_batch_fast([MARK + MARK.join(b) for b in blocks], add_special_tokens=False)
        theirs = self.library.encode([" ".join(b) for b in blocks])
        back = self.tokenizer.decode_batch([o.ids for o in ours], skip_special_tokens=False)
        out: list[bytes] = []
        for block, own, other, text in zip(blocks, ours, theirs, back):
            ids = np.array(own.ids, "<u4")
            starts = np.flatnonzero(self.begins[ids])
            if own.ids == other and len(starts) == len(block) and text == " " + " ".join(block):
                blob, at = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                out += [blob[a:b] for a, b in zip(at, at[1:])]
            else:
                out += self._encode([MARK + x for x in block])
        return out

    def _ids(self, column: pa.Array, first: bool) -> list[tuple[bytes, int, bool]]:
        column = pc.fill_null(column.cast(pa.string()), "")
        plain = np.zeros(len(column), bool)
        if self.blocks and first:
            odd = [pc.match_substring(column, x) for x in (MARK, "  ")] + [pc.starts_with(column, " "), pc.ends_with(column, " "), pc.equal(column, "")]
            plain = ~np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in odd])
        out: list = [None] * len(column)
        if plain.any():
            words, codes, sizes = common.runs(column.filter(pa.array(plain)), " ")
            self._rows(np.flatnonzero(plain), *common.gathered(self.words.values(words), codes, sizes, "<u4"), out)
        if not plain.all():
            texts = [self.normalise(t, first) for t in column.filter(pa.array(~plain)).to_pylist()]
            chunks = [self.chunk.findall(t) if self.cuts else [x for x in [t] if x] for t in texts]
            values = self.chunks.values([c for x in chunks for c in x])
            self._rows(np.flatnonzero(~plain), *common.gathered(values, np.arange(len(values)), np.array([len(x) for x in chunks], np.int64), "<u4"), out)
        return out

    @staticmethod
    def _rows(places: np.ndarray, ids: np.ndarray, sizes: np.ndarray, out: list) -> None:
        marked, ends = (ids >= FLAG).any(), np.cumsum(sizes).tolist()
        for place, a, b in zip(places.tolist(), [0, *ends], ends):
            own, flags = ids[a:b], 0
            differ = 0
            if marked and (at := own >= FLAG).any():
                flags = own[at] - FLAG
                own, differ, flags = own[~at], int((flags & 1).sum()), int((flags & 2).any())
            out[place] = (own.tobytes(), differ, not flags)

    def encode(self, texts: pa.Array) -> list[tuple[bytes, int, bool]]:
        """Ids (little-endian unsigned 32 bits), chunks on which the libraries differ, and whether the ids decode to the normalised text.

        A long text comes as a column by itself; it is taken in parts if spaces part its chunks.
        """
        if not (self.cuts and self.plain):
            return self._ids(texts, True)
        found = [self._ids(part, k == 0) for k, part in enumerate(common.texts_by_parts(texts, SPACE))]
        return found[0] if len(found) == 1 else [(b"".join(x[0][0] for x in found), sum(x[0][1] for x in found), all(x[0][2] for x in found))]

    def decode(self, ids: list[list[int]]) -> list[str]:
        texts = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [t.removeprefix(" ") for t in texts] if self.file.dummy_prefix else texts


@lru_cache(maxsize=2)
def piece_codec(path: str) -> PieceCodec:
    with open(path, "rb") as f:
        return PieceCodec(f.read())


def _encode(path: str, with_ids: bool):
    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(path)
        for batch in common.slices(rows):
            found = codec.encode(batch.column(1))
            ids = [np.frombuffer(f[0], "<u4") for f in found]
            columns = [pa.array([len(i) for i in ids], pa.int64()), pa.array([int(codec.is_byte[i].sum()) for i in ids], pa.int64()), pa.array([zlib.crc32(f[0]) for f in found], pa.int64()), pa.array([f[1] == 0 for f in found], pa.bool_()), pa.array([f[2] for f in found], pa.bool_())]
            more = [pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))] if with_ids else []
            yield pa.record_batch([batch.column(0), *columns, *more], names=["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "parity", "decodes", *["ids"] * with_ids])
        codec.chunks.clear()
        codec.words.clear()

    return batches


def encode(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, n_byte_pieces, ids_crc32, parity, decodes, and the ids.

    ``parity``: the rebuilt tokenizer gave the sentencepiece library's ids.
    ``decodes``: the ids decode to the normalised text.

    * null and empty texts: no ids. Null doc_id, repeated ids and rows: each row gets its row.
    * empty table: empty result. Extra columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_encode(model_path, with_ids), "doc_id bigint, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, parity boolean, decodes boolean" + (", ids array<int>" if with_ids else ""))


def _decode(path: str):
    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(path)
        for whole in rows:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = codec.decode([x or [] for x in batch.column(1).to_pylist()])
                yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return batches


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids. Null ids decode to an empty text."""
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(model_path), "doc_id bigint, text string")
