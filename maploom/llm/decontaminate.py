"""Benchmark decontamination: size-partitioned MinHash containment search.

Benchmark items are partitioned by the size of their shingle sets (powers of
two).  An item's sketch is its MinHash signature of ``k`` values, the ``k`` least
hashes of its ``n`` shingles, with ``k = n - ceil(0.75 n) + 1``: a document that
holds at least 75 % of the shingles lacks fewer than ``k`` of them, so it holds a
value of the sketch, however long it is.  A partition's items therefore have
sketches of about equal length, and no item is missed.  A document and an item
that share a sketch value are a candidate, which exact shingle containment in the
whole document settles.

Shingles are five lower-cased (A-Z) words; an item of fewer words is one shingle
of that many words, looked for in documents' word runs of that length.

A benchmark of bounded size is broadcast and searched where texts are read.  For a
larger one, fixed-size bitmaps of the sketches and of all shingles pick the hashes
of the texts that may matter, in one pass; these are joined with the items.

Defined results: items or texts that are null, empty or without words match
nothing.  Rows are judged one by one, by their texts, whatever their doc_id:
repeated documents give repeated rows, equal items a row each, a null doc_id stays
null.  Texts and items are read whole, however long.  Other columns never matter;
an empty table of documents or items gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import Bloom, docs_of, forget, lists, map_arrow, small_batches
from .line_dedup import is_in

WORDS, PERCENT = 5, 75
#: Most benchmark words that are broadcast (about 16 bytes each); more are joined.
BROADCAST_WORDS = 2_000_000
#: Bits of the bitmaps for a larger benchmark, as a power of two.
LOG2_BITS = 26


def item_set(text: str | None) -> tuple[int, np.ndarray]:
    """Words in a shingle, and the sorted distinct shingle hashes of an item."""
    raw = (text or "").encode()
    texts = tn.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).lower()
    start, end, doc = texts.runs()
    size = min(WORDS, len(start))
    if not size:
        return 0, np.empty(0, tn.U64)
    return size, np.unique(tn.windows(texts.span_hash(start, end), doc, 1, size)[0])


def sketch(h: np.ndarray) -> np.ndarray:
    """The least hashes of a sorted set, of which a text with 75 % of the set has one at least."""
    return h[: len(h) - -(-PERCENT * len(h) // 100) + 1]


def size_class(n: int) -> int:
    return max(0, int(n - 1).bit_length())


class Index:
    """Items by shingle length and size class, with sketches and sorted sets."""

    def __init__(self, items: list[tuple[int, str]]):
        self.groups: dict[int, dict] = {}
        for item_id, text in items:
            size, h = item_set(text)
            if not size:
                continue
            by_class = self.groups.setdefault(size, {}).setdefault(size_class(len(h)), {"tokens": [], "owner": [], "items": []})
            s = sketch(h)
            by_class["tokens"].append(s)
            by_class["owner"].append(np.full(len(s), len(by_class["items"])))
            by_class["items"].append((item_id, h))
        for group in self.groups.values():
            for c in group.values():
                tokens, owner = np.concatenate(c["tokens"]), np.concatenate(c["owner"])
                order = np.argsort(tokens, kind="stable")
                c["tokens"], c["owner"] = tokens[order], owner[order]

    def search(self, texts: tn.Texts):
        """(document's place in the chunk, item, its shingles, those in the document) of each match."""
        for h, cut, owner, group in _hashes(texts, self.groups):
            for table in group.values():
                hits = np.flatnonzero(is_in(h, table["tokens"]))
                if len(hits):
                    yield from self._settle(h, cut, owner, hits, table)

    @staticmethod
    def _settle(h, cut, owner, hits, table):
        for d in np.unique(owner[hits]):
            own = np.unique(h[cut[d] : cut[d + 1]])
            met = np.unique(h[hits[owner[hits] == d]])
            lo, hi = np.searchsorted(table["tokens"], met), np.searchsorted(table["tokens"], met, "right")
            found = np.unique(np.concatenate([table["owner"][i:j] for i, j in zip(lo, hi, strict=True)]))
            for k in found.tolist():
                item_id, s = table["items"][k]
                shared = int(is_in(s, own).sum())
                if 100 * shared >= PERCENT * len(s):
                    yield int(d), item_id, len(s), shared


def _hashes(texts: tn.Texts, groups):
    """For each shingle length: hashes, the documents' cuts, the document of each hash, and the entry of ``groups``."""
    low = texts.lower()
    start, end, doc = low.runs()
    words, n = low.span_hash(start, end), len(texts)
    for size, group in groups.items():
        h, owner, _ = tn.windows(words, doc, n, size)
        yield h, np.searchsorted(owner, np.arange(n + 1)), owner, group


COLUMNS = "doc_id long, item_id long, n_item long, n_shared long"


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared``: items of which at least 75 % of the shingles are in a document.

    A benchmark of up to ``broadcast_words`` words is broadcast and searched
    without a shuffle; a larger one is joined with what its bitmaps let pass.
    """
    docs = docs_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    items = _items(benchmark)
    if not _fits(items, broadcast_words):
        found = _joined(docs, items)
        return docs.select("doc_id", F.xxhash64("text").alias("mark")).join(found, "mark").select("doc_id", "item_id", "n_item", "n_shared")
    handle = _sent(items)

    def run(batches):
        index = Index(handle.value)
        for batch, texts in tn.chunks(batches):
            ids = batch.column("doc_id").to_pylist()
            rows = list(index.search(texts))
            if rows:
                yield {"doc_id": [ids[r[0]] for r in rows], "item_id": [r[1] for r in rows], "n_item": [r[2] for r in rows], "n_shared": [r[3] for r in rows]}

    return map_arrow(docs, run, COLUMNS)


def _items(benchmark: DataFrame) -> DataFrame:
    small_batches(benchmark.sparkSession)
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")


def _fits(items: DataFrame, words: int) -> bool:
    """Whether the items have at most so many words; a word has two characters at least, with its separator."""
    return (items.agg(F.sum(F.length("text"))).first()[0] or 0) <= 2 * words


def _sent(items: DataFrame):
    return items.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()])


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``mark, item_id, n_item, n_shared`` for a benchmark of any size; ``mark`` is the hash of a text."""

    def cut(batches):
        for batch in batches:
            sets = [item_set(t) for t in batch.column("text").to_pylist()]
            some = [k for k, (size, _) in enumerate(sets) if size]
            if some:
                h = [sets[k][1] for k in some]
                ends = np.r_[0, np.cumsum([len(x) for x in h])]
                yield {"row": batch.column("row").take(pa.array(some)), "item_id": batch.column("item_id").take(pa.array(some)), "size": [sets[k][0] for k in some], "n_sketch": [len(sketch(x)) for x in h], "h": lists(ends, np.concatenate(h).view(np.int64), pa.int64())}

    # equal items with equal ids are rows of their own
    marked = items.groupBy("item_id", "text").agg(F.count("*").alias("copies")).withColumn("row", F.xxhash64("item_id", "text"))
    sets = map_arrow(marked.select("row", "item_id", "text"), cut, "row long, item_id long, size int, n_sketch int, h array<long>")
    tokens = sets.select("row", "item_id", "size", F.size("h").cast("long").alias("n_item"), "n_sketch", F.posexplode("h").alias("place", "h"))
    sizes = [r["size"] for r in sets.select("size").distinct().collect()]  # WORDS numbers at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], "mark long, item_id long, n_item long, n_shared long")
    blooms = [Bloom.of(x.select("h"), "h", LOG2_BITS) for x in (tokens.where("place < n_sketch"), tokens)]
    handle = docs.sparkSession.sparkContext.broadcast([b.words.tobytes() for b in blooms])

    def run(batches):
        some, all_ = (Bloom(np.frombuffer(x, np.uint32), LOG2_BITS) for x in handle.value)
        for batch, texts in tn.chunks(batches):
            for h, _, owner, size in _hashes(texts, {s: s for s in sizes}):
                candidate = np.zeros(len(texts), bool)
                candidate[owner[some.has(h.view(np.int64))]] = True
                at = np.flatnonzero(candidate[owner])
                at = at[all_.has(h[at].view(np.int64))]
                if len(at):
                    marks, h_at = batch.column("mark").to_numpy()[owner[at]], h[at].view(np.int64)
                    yield {"mark": marks, "size": np.full(len(at), size, np.int32), "h": h_at}

    hits = map_arrow(docs.select(F.xxhash64("text").alias("mark"), "text"), run, "mark long, size int, h long").distinct()
    found = hits.join(tokens, ["size", "h"]).groupBy("mark", "row", "item_id", "n_item").agg(F.count("*").alias("n_shared")).where(100 * F.col("n_shared") >= PERCENT * F.col("n_item"))
    copies = marked.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return found.join(copies, "row").select("mark", "item_id", "n_item", "n_shared")


def clean(docs: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; each row by its own text, whatever its doc_id."""
    items = _items(benchmark)
    if not _fits(items, broadcast_words):
        gone = _joined(docs.select("text"), items).select(F.col("mark").alias("_mark")).distinct()
        return docs.withColumn("_mark", F.xxhash64("text")).join(gone, "_mark", "left_anti").select(*[docs[c] for c in docs.columns])
    handle = _sent(items)

    def run(batches):
        forget()
        index = Index(handle.value)
        with np.errstate(over="ignore"):
            for batch, texts in tn.chunks(batches):
                keep = np.ones(len(texts), bool)
                keep[[r[0] for r in index.search(texts)]] = False
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
