"""Token ids in binary files with a shared zstandard dictionary.

File: the magic ``MLTK0001``; the dictionary's SHA-256 (32 bytes); the frames,
one per document, each the zstandard compression of its ids as little-endian
unsigned 32-bit integers; an index of (doc_id, offset, frame bytes, ids) as four
little-endian signed 64-bit integers per document; the number of documents and
the offset of the index (8 bytes each).  The dictionary is a file of its own,
named by its hash, and is trained on a bounded sample of id arrays.

Texts are encoded and compressed where they are read; the frames are dealt out by
ranges of doc_id, sorted, and written to one file for each range.  A file gets its
name from the task's attempt, and only the attempts whose rows Spark commits are
listed in the saved index, so a lost executor leaves at worst a file that nobody
reads.

Defined results: a null or empty text has only the end id.  Rows with the same
doc_id (a null one comes first) are in one file, ordered by number of ids and then
by frame; repeated rows keep a frame each.  A very long text is encoded whole, as a
chunk of its own.  Columns other than doc_id and text are never read.  An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum as tn
from .common import Workspace, docs_of, kept, map_arrow, small_batches
from .segments import SegmentEncoder, spans

MAGIC = b"MLTK0001"
#: The dictionary is trained on at most so many documents, a block of at most so many ids of each.
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES = 1000, 500, 64 << 10
#: Bytes of a file that one task reads back.
READ_BYTES = 16 << 20
LEVEL = 1
#: Bytes that may begin a white-space character other than ASCII.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


#: Marks before which a word always ends.
_MARK = np.zeros(256, bool)
_MARK[list(b",.;:!?|#%&$*")] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def file_system(path: str):
    """pyarrow file system and path in it of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _cuts(texts: tn.Texts) -> np.ndarray:
    """A single space or new line between two characters that are certainly not white space starts a segment; so does a mark after a letter.

    The byte-level pattern takes such a space into the following token, and such a
    new line as a token of its own.
    """
    d = texts.data
    cut = np.zeros(len(d), bool)
    if len(d) > 4:
        solid = ~_SPACE[d] & ~_WIDE[d]
        near = np.zeros(len(d), bool)  # a wide character may end just before
        for k in (1, 2, 3):
            near[k:] |= _WIDE[d[:-k]]
        here = (d[1:-1] == 32) | (d[1:-1] == 10)
        cut[1:-1] = here & solid[:-2] & solid[2:] & ~near[1:-1]
        # a word ends before such a mark: after an ASCII letter, or a letter of U+00C0-U+00FF
        latin = np.zeros(len(d), bool)
        latin[1:] = (d[:-1] == 0xC3) & (d[1:] != 0x97) & (d[1:] != 0xB7)
        cut[1:] |= _MARK[d[1:]] & (_ASCII_LETTER[d] | latin)[:-1]
    return cut


def _tokenizer(raw: str, plain_specials: bool):
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(raw)
    if plain_specials:
        out.encode_special_tokens = True
    return out


class ByteBpe:
    """Encoder of a worker for a byte-level BPE tokenizer file; no segment ends in or next to an added token's literal."""

    def __init__(self, raw: str, plain_specials: bool):
        self.tokenizer = _tokenizer(raw, plain_specials)
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self.segments = SegmentEncoder(lambda parts: [x.ids for x in self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)])

    def encode(self, texts: tn.Texts) -> tuple[np.ndarray, np.ndarray]:
        cut, raw = _cuts(texts), texts.data.tobytes()
        for literal in self.added:
            at = raw.find(literal)
            while at >= 0:
                cut[max(0, at - 1) : at + len(literal) + 1] = False
                at = raw.find(literal, at + 1)
        return self.segments(texts, *spans(texts, cut))


def _sample(docs: DataFrame, handle, plain_specials: bool) -> list[bytes]:
    """Blocks of ids for the dictionary: one of each of the documents with the smallest hashes of doc_id.

    A block of up to SAMPLE_IDS ids begins at a hashed place of the whole text.  Only
    hashes of doc_id and the blocks come to the driver.
    """
    marked = docs.withColumn("h", F.xxhash64("doc_id"))
    few = marked.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS)  # at most SAMPLE_DOCS longs are broadcast

    def run(batches):
        tokenizer = _tokenizer(handle.value, plain_specials)
        seen = set()
        for batch in batches:
            h, text = batch.column("h").to_pylist(), batch.column("text").to_pylist()
            new = [k for k in range(len(h)) if (h[k], text[k]) not in seen]
            seen.update((h[k], text[k]) for k in new)
            out = []
            for k, x in zip(new, tokenizer.encode_batch_fast([text[k] or "" for k in new], add_special_tokens=False), strict=True):
                at = zlib.crc32(struct.pack("<q", h[k])) % max(1, len(x.ids) - SAMPLE_IDS + 1)
                out.append(np.array(x.ids[at : at + SAMPLE_IDS], "<u4").tobytes())
            yield {"h": [h[k] for k in new], "block": out}

    blocks = map_arrow(marked.join(F.broadcast(few), "h", "left_semi").select("h", "text"), run, "h long, block binary")
    rows = blocks.groupBy("h").agg(F.min("block").alias("block")).collect()  # SAMPLE_DOCS blocks of 4 * SAMPLE_IDS bytes at most
    return [bytes(r.block) for r in sorted(rows, key=lambda r: r.h) if r.block]


def train_dictionary(blocks: list[bytes]) -> bytes:
    """A zstandard dictionary from serialized id arrays."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too few samples: raw content serves as dictionary
        return (b"".join(blocks)[:DICT_BYTES] or b"\0" * 8) + b"\0" * 8


def range_bounds(docs: DataFrame) -> np.ndarray:
    """Smallest doc_id of each file but the first; as many files as the input has partitions.

    Only doc_id is read and shuffled; a number for each file comes to the driver.
    """
    n = docs.rdd.getNumPartitions()
    if n < 2:
        return np.empty(0, np.int64)
    ids = docs.select("doc_id").where("doc_id is not null").repartitionByRange(n, "doc_id")
    least = ids.groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("x")).toPandas()["x"].to_numpy(np.int64)
    return np.sort(least)[1:]


def write(docs: DataFrame, tokenizer_path: str, end_id: int, work: Workspace, plain_specials: bool = True) -> DataFrame:
    """Write the token files; a saved index ``file, doc_id, place, offset, size, n_tokens, part``.

    Texts are encoded and compressed where they are read; only the frames are
    dealt out by ranges of doc_id.
    """
    spark = docs.sparkSession
    with open(tokenizer_path) as f:
        tokenizer = f.read()
    raw = spark.sparkContext.broadcast(tokenizer)
    dictionary = train_dictionary(_sample(docs, raw, plain_specials))
    digest = hashlib.sha256(dictionary).digest()
    base = work.path("tokens")
    fs, root = file_system(base)
    fs.create_dir(root)
    with fs.open_output_stream(f"{root}/{digest.hex()}.dict") as f:
        f.write(dictionary)
    bounds = range_bounds(docs)
    handle = spark.sparkContext.broadcast((dictionary, bounds))

    def encode(batches):
        import zstandard

        dictionary, bounds = handle.value
        bpe = kept(("bpe", plain_specials, zlib.crc32(raw.value.encode())), lambda: ByteBpe(raw.value, plain_specials))
        table = zstandard.ZstdCompressionDict(dictionary)
        table.precompute_compress(level=LEVEL)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=table, write_content_size=True)
        for batch, texts in tn.chunks(batches):
            ids, count = bpe.encode(texts)
            cut = np.cumsum(count)
            ids = np.insert(ids, cut, np.uint32(end_id)).astype("<u4")
            cut = np.r_[0, cut + np.arange(1, len(cut) + 1)].tolist()
            doc_id = batch.column("doc_id")
            part = np.searchsorted(bounds, doc_id.fill_null(np.iinfo(np.int64).min).to_numpy(), "right")
            frames = [squeeze.compress(ids[a:b].data) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield {"part": part.astype(np.int32), "doc_id": doc_id, "n_tokens": count + 1, "frame": frames}

    def store(batches):
        fs, root = file_system(base)
        part, out = None, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "frame")]
            rows = []
            for p, d, n, frame in zip(*cols, strict=True):
                if p != part:
                    if out is not None:
                        _finish(out, index, at)
                    part, index, at = p, [], len(MAGIC) + len(digest)
                    name = f"part-{p:05d}-{TaskContext.get().taskAttemptId()}.mltk"
                    out = fs.open_output_stream(f"{root}/{name}")
                    out.write(MAGIC + digest)
                out.write(frame)
                rows.append((name, d, len(index), at, len(frame), n, p))
                index.append((-1 if d is None else d, at, len(frame), n))
                at += len(frame)
            if rows:
                yield dict(zip(("file", "doc_id", "place", "offset", "size", "n_tokens", "part"), map(list, zip(*rows, strict=True)), strict=True))
        if out is not None:
            _finish(out, index, at)

    rows = map_arrow(docs, encode, "part int, doc_id long, n_tokens long, frame binary", keeps=True)
    rows = rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id", "n_tokens", "frame")
    index = work.save(map_arrow(rows, store, "file string, doc_id long, place long, offset long, size long, n_tokens long, part int"), "index")
    index._tokens_at = base
    return index


def _finish(out, index: list[tuple[int, int, int, int]], at: int) -> None:
    out.write(np.array(index, "<i8").tobytes() + struct.pack("<qq", len(index), at))
    out.close()


def read(spark: SparkSession, base: str, index: DataFrame, max_gap: int = 1 << 16, max_range: int = 4 << 20) -> DataFrame:
    """``doc_id, part, place, n_tokens, ids_crc32`` of the indexed documents, from the files.

    Neighbouring frames are fetched by one range read.  Each file's dictionary hash
    and each frame's own place in the index are checked.
    """

    def run(batches):
        import zstandard

        fs, root = file_system(base)
        name = f = expand = None
        for batch in batches:
            rows = batch.to_pylist()
            k = 0
            while k < len(rows):
                if rows[k]["file"] != name:
                    name = rows[k]["file"]
                    f = fs.open_input_file(f"{root}/{name}")
                    head = f.read_at(len(MAGIC) + 32, 0)
                    if head[: len(MAGIC)] != MAGIC:
                        raise ValueError(f"{name} is not a token file")
                    with fs.open_input_stream(f"{root}/{head[len(MAGIC) :].hex()}.dict") as d:
                        dictionary = d.read()
                    if hashlib.sha256(dictionary).digest() != head[len(MAGIC) :]:
                        raise ValueError(f"the dictionary of {name} has changed")
                    expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
                lo, hi, j = rows[k]["offset"], rows[k]["offset"] + rows[k]["size"], k + 1
                while j < len(rows) and rows[j]["file"] == name and 0 <= rows[j]["offset"] - hi <= max_gap and rows[j]["offset"] + rows[j]["size"] - lo <= max_range:
                    hi = rows[j]["offset"] + rows[j]["size"]
                    j += 1
                block = f.read_at(hi - lo, lo)
                out = {c: [r[c] for r in rows[k:j]] for c in ("doc_id", "part", "place")} | {"n_tokens": [], "ids_crc32": []}
                for r in rows[k:j]:  # one document's ids at a time
                    ids = expand.decompress(block[r["offset"] - lo : r["offset"] - lo + r["size"]])
                    out["n_tokens"].append(len(ids) // 4)
                    out["ids_crc32"].append(zlib.crc32(ids))
                yield out
                k = j

    total = index.agg(F.sum("size")).first()[0] or 0
    rows = index.withColumn("stretch", F.floor(F.col("offset") / READ_BYTES)).repartition(1 + 2 * total // READ_BYTES, "file", "stretch").sortWithinPartitions("file", "offset").drop("stretch")
    return map_arrow(rows, run, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, plain_specials: bool = True) -> DataFrame:
    """Write, read back and describe: ``doc_id, start, n_tokens, ids_crc32``.

    Without ``plain_specials`` the literal of a special token in a text is that
    token, as the tokenizer file says; with it the literal is encoded as text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast(T.LongType()))
    work = Workspace(spark, "tokens")
    index = write(docs, tokenizer_path, end_id, work, plain_specials)
    back = work.save(read(spark, index._tokens_at, index), "back")
    # positions: sums per stretch of a file, then over the (few) stretches, then inside a stretch
    step = 4096
    back = back.withColumn("step", F.floor(F.col("place") / step))
    totals = back.groupBy("part", "step").agg(F.sum("n_tokens").alias("n"))
    files = totals.groupBy("part").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    files = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    totals = totals.select("part", "step", (F.sum("n").over(Window.partitionBy("part").orderBy("step")) - F.col("n")).alias("inner"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part", "step").orderBy("place")) - F.col("n_tokens")
    out = back.withColumn("inside", inside).join(totals, ["part", "step"]).join(files, "part")
    return out.select("doc_id", (F.col("before") + F.col("inner") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
