"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read here, and an equal tokenizer is built with
the tokenizers library: the normaliser, the metaspace marker with its dummy
prefix, unigram scores or BPE merges by score, and byte fallback.  Batches are
encoded by its ``encode_batch``, in a Spark task on the one thread that the task has:
threads of its own would hold some 40 MB more in each worker.

Parity: every whole text is also encoded with the sentencepiece library, only to
compare; ``n_differ`` counts the ids of the text that differ.  Texts are cut before a new line and before
a space that follows another character.  No piece has a new line, or the marker
after another character, and then no merge crosses such a place; a model that has such a piece, or is not BPE, or
changes texts, is encoded by whole texts instead.

Decoding maps ids to the bytes of their pieces, markers to spaces, and drops the
dummy prefix.  It gives the text back, except that a U+2581 of the text itself
comes back as a space.

Defined results: a null or empty text has no ids.  Repeated rows get equal
results; a null doc_id stays null.  A very long text is encoded whole.  Columns
other than doc_id and text are never read.  An empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textnum as tn
from .common import docs_of, kept, lists, map_arrow, small_batches
from .segments import SegmentEncoder, ragged, spans

MARK = "▁"
#: Bytes of text that a worker encodes at once (arrays of eight bytes for each of them), and of an Arrow batch.
AT_ONCE, BATCH = 1 << 18, "2m"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the format


def _fields(data: bytes):
    """(field number, value) of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.raw = raw
        self.is_bpe = trainer.get(3, 1) == 2
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk_id = next((k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)
        self.charsmap = normalizer.get(2, b"")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))

    @property
    def by_segments(self) -> bool:
        """Whether texts can be cut before new lines, and spaces that follow another character."""
        inner = any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))
        return self.is_bpe and self.dummy_prefix and not self.charsmap and not self.squeeze and not inner and not any("\n" in p for p, _, _ in self.pieces) and not any(p[2] == USER for p in self.pieces)

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        vocab = {p: k for k, (p, _, _) in enumerate(self.pieces)}
        if self.is_bpe:
            merges = []
            usable = {p for p, _, kind in self.pieces if kind in (NORMAL, USER)}
            for k, (p, score, kind) in enumerate(self.pieces):
                if kind == NORMAL and len(p) > 1:
                    merges += [(-score, k, i, p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
            merges = [(left, right) for _, _, _, left, right in sorted(merges)]
            model = models.BPE(vocab, merges, unk_token=self.pieces[self.unk_id][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk_id, byte_fallback=self.byte_fallback)
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(MARK)] if self.dummy_prefix else []
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
        return out

    def piece_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces' decoded bytes, with start and length of each."""
        parts = []
        for p, _, kind in self.pieces:
            parts.append(bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode())
        size = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


class Codec:
    """Encoder and decoder of a worker."""

    def __init__(self, raw: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = Model(raw)
        self.by_segments = self.model.by_segments
        self.mark = next((k for k, (p, _, _) in enumerate(self.model.pieces) if p == MARK), 0)
        self.tokenizer = self.model.tokenizer()
        self.reference = SentencePieceProcessor(model_proto=raw)
        self.table, self.start, self.size = self.model.piece_bytes()
        self.segments = SegmentEncoder(self._encode, np.uint16 if len(self.model.pieces) <= 1 << 16 else np.uint32)

    def _encode(self, segments: list[bytes]) -> list[list[int]]:
        # the dummy prefix stands for the space that a segment begins with, and goes where it begins with a new line
        cut = self.by_segments
        texts = [(s[1:] if cut and s[:1] == b" " else s).decode() for s in segments]
        out = []
        for s, mine in zip(segments, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            out.append(mine.ids if not cut or s[:1] != b"\n" else mine.ids[1:])
            if cut and s == b" ":
                out[-1] = [self.mark]
        return out

    def encode(self, texts: tn.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        d = texts.data
        cut = np.zeros(len(d), bool)
        if self.by_segments:
            cut[1:] = ((d[1:] == 32) & (d[:-1] != 32) & (d[:-1] != 0x81)) | (d[1:] == 10)
        start, end, doc = spans(texts, cut)
        if not self.by_segments:
            return self.segments(texts, start, end, doc)
        # a text's own first space is not the dummy prefix, which is put before it
        first = np.zeros(len(d), bool)
        first[texts.offsets[:-1][texts.offsets[:-1] < len(d)]] = True
        odd = np.flatnonzero(first[start] & ((d[start] == 32) | (d[start] == 10)))
        if len(odd):
            return self._with_leading_space(texts, start, end, doc, set(odd.tolist()))
        return self.segments(texts, start, end, doc)

    def _with_leading_space(self, texts, start, end, doc, odd):
        raw = bytearray()
        s, e = [], []
        for k, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            s.append(len(raw))
            raw += (b" " if k in odd else b"") + texts.data[a:b].tobytes()
            e.append(len(raw))
        other = tn.Texts(np.frombuffer(bytes(raw), np.uint8), texts.offsets)
        return self.segments(other, np.array(s), np.array(e), doc)

    def differ(self, texts: tn.Texts, ids: np.ndarray, cut: np.ndarray) -> list[int]:
        """How many ids of each whole text differ from those of the sentencepiece library, by place; extra ones count too."""
        out = []
        for k, want in enumerate(self.reference.encode([texts.text(k).decode() for k in range(len(texts))], num_threads=1)):
            mine, want = ids[cut[k] : cut[k + 1]], np.array(want, ids.dtype)
            n = min(len(mine), len(want))
            out.append(int((mine[:n] != want[:n]).sum()) + max(len(mine), len(want)) - n)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of one document's ids."""
        out = self.table[ragged(self.start[ids], self.size[ids])].tobytes()
        return out[1:] if self.model.dummy_prefix and out[:1] == b" " else out


def encode_rows(batches: Iterable[pa.RecordBatch], codec: Codec) -> Iterator[dict]:
    """The columns of :func:`encode`, from ``doc_id, text``; for a task, on its one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    for batch, texts in tn.chunks(batches, size=AT_ONCE):
        ids, count = codec.encode(texts)
        cut = np.r_[0, np.cumsum(count)]
        raw = ids.astype("<u4")
        crc, same = [], []
        for k in range(len(texts)):
            mine = raw[cut[k] : cut[k + 1]]
            crc.append(zlib.crc32(mine.tobytes()))
            same.append(codec.decode(mine) == texts.text(k).replace(MARK.encode(), b" "))
        yield {"doc_id": batch.column("doc_id").cast("int64"), "ids": lists(cut, ids.astype(np.int32), pa.int32()), "n_tokens": count, "ids_crc32": crc, "round_trip": same, "n_differ": codec.differ(texts, raw, cut)}


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, n_tokens, ids_crc32, round_trip, n_differ`` of each row; no shuffle.

    ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit integers;
    ``round_trip`` says whether decoding gives the text back; ``n_differ`` counts the
    ids that differ from the sentencepiece library's of the whole text.
    """
    spark = docs.sparkSession
    small_batches(spark, BATCH)
    with open(model_path, "rb") as f:
        handle = spark.sparkContext.broadcast(f.read())

    def run(batches):
        yield from encode_rows(batches, kept(("sentencepiece", zlib.crc32(handle.value)), lambda: Codec(handle.value)))

    return map_arrow(docs_of(docs, "doc_id", "text"), run, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean, n_differ long", keeps=True)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    spark = encoded.sparkSession
    with open(model_path, "rb") as f:
        handle = spark.sparkContext.broadcast(f.read())

    def run(batches):
        codec = Codec(handle.value)
        for batch in batches:
            yield {"doc_id": batch.column("doc_id").cast("int64"), "text": [codec.decode(np.array(x or [], np.int64)).decode(errors="replace") for x in batch.column("ids").to_pylist()]}

    return map_arrow(docs_of(encoded, "doc_id", "ids"), run, "doc_id long, text string")
