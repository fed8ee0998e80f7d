"""Substring deduplication by paragraph MinHash banding.

A paragraph is a line of at least ``MIN_WORDS`` words.  Its MinHash signature of
``BANDS * ROWS`` values is cut into bands; at a Jaccard similarity of 0.75 two
paragraphs share a band with probability 1 - (1 - 0.75**ROWS)**BANDS = 0.9987.
Paragraphs that share a band meet its first member, and then, in bands that still
hold several components, the members of other components; bitmap bounds and the
exact Jaccard similarity of their sets of five-word shingles settle each pair.
Components of the links, and paragraphs with equal keys, are clusters; a cluster
keeps its first paragraph by (doc_id, position) and loses the others.

A passage inside longer lines, or wrapped otherwise, is not a paragraph of its own.
With ``passages`` the words of each text are also cut into pieces where the words
themselves say (:class:`Pieces`), whatever the lines; a run of pieces that occur
elsewhere too, of ``PASSAGE`` words or more, is a shared passage.  The document with
the least doc_id keeps a piece.  Passages of 51 random words are found with
probability 0.99; shorter lines than MIN_WORDS and runs than PASSAGE are the work
of line and document deduplication.

Defined results: a null or empty text has no paragraphs.  Rows with the same doc_id
are the same document: the first paragraph stays in all of them.  A row without a
doc_id loses what other documents keep, and keeps what only such rows have.  Texts
are read whole, however long.  Columns other than doc_id and text are never read.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import Workspace, docs_of, lists, map_arrow, small_batches
from .jaccard_join import band, blooms, link_sets, marked_only, need_blooms, needed, width
from .line_dedup import Lines, _rebuild, is_in
from .segments import ragged

MIN_WORDS, BANDS, ROWS, SHINGLE = 16, 8, 2, 5
#: Neighbours on either side that a piece's first word is compared with, most words of a piece, fewest of a passage.
RADIUS, LONGEST, PASSAGE = 4, 64, 16
#: Most duplicated keys that are broadcast (16 or 24 bytes each); more are joined.
BROADCAST_KEYS = 3_000_000
_SEEDS = tn.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=tn.U64)) | tn.U64(1)


class Paragraphs:
    """The paragraphs of a chunk: line number in the chunk, key, and their shingles."""

    def __init__(self, texts: tn.Texts):
        self.lines = x = Lines(texts)
        low = texts.lower()
        self.at = np.flatnonzero(x.n_words >= MIN_WORDS)
        self.doc, self.key = x.doc[self.at], x.key[self.at]
        self.pos = self.at - x.cut[self.doc]
        start, end, _ = low.runs()
        line = np.searchsorted(x.start, start, "right") - 1  # a word never lies in the empty line that ends a text
        long = x.n_words[line] >= MIN_WORDS if len(line) else np.empty(0, bool)
        self.h, owner, _ = tn.windows(low.span_hash(start[long], end[long]), line[long], 0, SHINGLE)
        self.first = np.searchsorted(owner, self.at)

    def bands(self) -> np.ndarray:
        out = np.zeros((len(self.at), BANDS), tn.U64)
        for b in range(BANDS if len(self.at) else 0):
            for r in range(ROWS):
                k = 2 * (b * ROWS + r)
                least = np.minimum.reduceat((self.h ^ _SEEDS[k]) * _SEEDS[k + 1], self.first)
                out[:, b] = tn.mix(out[:, b] + least + tn.U64(b + 1))
        return out.view(np.int64)

    def bitmaps(self, which: np.ndarray) -> tuple[list[int], list[bytes]]:
        """Distinct shingles and parity bitmap of the given paragraphs."""
        stop = np.r_[self.first[1:], len(self.h)]
        size = stop[which] - self.first[which]
        owner, h = np.repeat(np.arange(len(which)), size), self.h[ragged(self.first[which], size)]
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        once = np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])][: len(h)]
        owner, h = owner[once], h[once]
        n = np.bincount(owner, minlength=len(which))
        bits = width(band(n))
        out: list[bytes] = [b""] * len(which)
        for w in np.unique(bits).tolist():
            rows = np.flatnonzero(bits == w)
            place = np.full(len(which), -1)
            place[rows] = np.arange(len(rows))
            mine = place[owner] >= 0
            odd = np.bincount(place[owner[mine]] * w + (h[mine] & tn.U64(w - 1)).astype(np.int64), minlength=len(rows) * w) & 1
            packed = np.packbits(odd.astype(np.uint8).reshape(len(rows), w), axis=1, bitorder="little")
            for k, r in enumerate(rows.tolist()):
                out[r] = packed[k].tobytes()
        return n.tolist(), out

    def shingles(self, k: int) -> np.ndarray:
        stop = self.first[k + 1] if k + 1 < len(self.first) else len(self.h)
        return np.unique(self.h[self.first[k] : stop])


class Pieces:
    """Content-defined pieces of a chunk's texts: runs of words that end where the words themselves say.

    A word begins a piece if the hash of it and its successor is the least among
    those of its ``RADIUS`` neighbours on either side, so equal passages are cut at
    equal places wherever they begin and however their lines are wrapped.  Longer
    runs are cut after every ``LONGEST`` words.  The pieces cover all words.
    """

    def __init__(self, texts: tn.Texts):
        low = texts.lower()
        self.start, self.end, self.word_doc = start, end, doc = low.runs()
        n, n_docs = len(start), len(texts)
        words, top = low.span_hash(start, end), tn.U64(2**64 - 1)
        mark = np.full(n + 2 * RADIUS, top)
        if n > 1:
            pair = tn.mix(words[:-1] + tn.mix(words[1:]))
            mark[RADIUS : RADIUS + n - 1] = np.where(doc[1:] == doc[:-1], pair, top)
        own = mark[RADIUS : RADIUS + n]
        cut = own < top
        for k in range(1, RADIUS + 1):
            cut &= (own < mark[RADIUS - k : RADIUS - k + n]) & (own <= mark[RADIUS + k : RADIUS + k + n])
        edge = np.searchsorted(doc, np.arange(n_docs + 1))
        at = np.arange(n)
        cut &= (at - edge[doc] > RADIUS) & (edge[doc + 1] - at > RADIUS)
        cut[edge[:-1][edge[:-1] < edge[1:]]] = True
        first = np.flatnonzero(cut)
        more = (np.diff(np.r_[first, n]) - 1) // LONGEST
        self.first = np.repeat(first, more + 1) + LONGEST * ragged(np.zeros(len(first), np.int64), more + 1)
        self.n = np.diff(np.r_[self.first, n])
        self.doc = doc[self.first]
        total = np.r_[tn.U64(0), np.cumsum(tn.mix(words + tn.U64(SHINGLE)) * tn._powers(tn._P, n), dtype=tn.U64)]
        self.key = tn.mix((total[self.first + self.n] - total[self.first]) * tn._powers(tn._PINV, n + 1)[self.first] ^ self.n.astype(tn.U64)).view(np.int64)

    def runs(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word, and the word after the last, of each run of marked pieces of a document with PASSAGE words or more."""
        edge = np.r_[True, (self.doc[1:] != self.doc[:-1]) | (which[1:] != which[:-1])][: len(which)]
        lo = np.flatnonzero(edge)
        ends = np.r_[self.first[1:], len(self.start)]
        hi = np.r_[lo[1:], len(which)] - 1
        long = which[lo] & (ends[hi] - self.first[lo] >= PASSAGE) if len(lo) else np.empty(0, bool)
        return self.first[lo[long]], ends[hi[long]]


def _spread(values: list, where: np.ndarray, other) -> list:
    """``values`` at the true places, ``other`` elsewhere."""
    it = iter(values)
    return [next(it) if w else other for w in where.tolist()]


def paragraph_features(docs: DataFrame) -> DataFrame:
    """For each chunk's distinct paragraphs: sid (the key), occurrences, first place; bands and bitmap once per task."""

    def run(batches):
        seen: set[int] = set()
        for batch, texts in tn.chunks(batches):
            p = Paragraphs(texts)
            if not len(p.at):
                continue
            ids = batch.column("doc_id").to_numpy()[p.doc]
            order = np.lexsort((p.pos, ids, p.key))
            key = p.key[order]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            first = order[new]
            if len(seen) > 300_000:
                seen.clear()
            fresh = np.array([k not in seen for k in key[new].tolist()])
            seen.update(key[new].tolist())
            n, maps = p.bitmaps(first[fresh])
            n, maps = _spread(n, fresh, 0), _spread(maps, fresh, None)
            cut = np.r_[0, np.cumsum(fresh)] * BANDS
            yield {"sid": key[new], "occurrences": np.diff(np.r_[new, len(key)]), "doc_id": ids[first], "pos": p.pos[first], "n": n, "token": lists(cut, p.bands()[first[fresh]].ravel(), pa.int64()), "salt": lists(cut, np.zeros(cut[-1], np.int16), pa.int16()), "bits": maps}

    return map_arrow(docs.where("doc_id is not null"), run, "sid long, occurrences long, doc_id long, pos long, n long, token array<long>, salt array<short>, bits binary")


def shared_pieces(docs: DataFrame) -> DataFrame:
    """``key, keep_doc`` of the pieces that occur twice or more; the least doc_id keeps them."""

    def run(batches):
        for batch, texts in tn.chunks(batches):
            x = Pieces(texts)
            if len(x.key):
                doc_id = batch.column("doc_id").to_numpy()[x.doc]
                order = np.lexsort((doc_id, x.key))
                key, doc_id = x.key[order], doc_id[order]
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                yield {"key": key[new], "n": np.diff(np.r_[new, len(key)]), "doc_id": doc_id[new]}

    rows = map_arrow(docs.where("doc_id is not null"), run, "key long, n int, doc_id long")
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("doc_id").alias("keep_doc")).where("n > 1").select("key", "keep_doc")


def paragraph_arrays(docs: DataFrame, need: DataFrame) -> DataFrame:
    """``sid, hashes``: the sorted shingle hashes of the paragraphs ``need(sid, mark)``; ``mark`` hashes the id of a document with it."""
    handle = docs.sparkSession.sparkContext.broadcast(need_blooms(need))

    def run(batches):
        table, marks = blooms(handle.value)
        seen = set()
        for _, texts in tn.chunks(marked_only(batches, marks)):
            p = Paragraphs(texts)
            keys, arrays = [], []
            for k in np.flatnonzero(table.has(p.key)) if len(p.key) else ():
                key = int(p.key[k])
                if key not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(key)
                    keys.append(key)
                    arrays.append(p.shingles(k).tobytes())
            if keys:
                yield {"sid": keys, "hashes": arrays}

    return map_arrow(docs.withColumn("mark", F.xxhash64("doc_id")), run, "sid long, hashes binary").join(need, "sid", "left_semi").dropDuplicates(["sid"])


def clusters(docs: DataFrame, work: Workspace) -> DataFrame:
    """``key, keep_doc, keep_pos`` of every paragraph key whose cluster occurs twice or more."""
    features = work.save(paragraph_features(docs), "features")
    places = work.save(features.groupBy(F.col("sid").alias("key")).agg(F.sum("occurrences").alias("n"), F.min(F.struct("doc_id", "pos")).alias("place")), "places")
    comp = link_sets(work, features, lambda pairs: paragraph_arrays(docs, needed(work, pairs, places.select(F.col("key").alias("sid"), F.xxhash64("place.doc_id").alias("mark")))))
    named = places.join(comp.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = work.save(named.where("n > 1 or component <> key").unionByName(named.where("n = 1 and component = key").join(comp.select("component").distinct(), "component", "left_semi").select(named.columns)), "named")
    whole = named.groupBy("component").agg(F.sum("n").alias("all"), F.min("place").alias("first")).where("all > 1")
    return named.join(whole, "component").select("key", F.col("first.doc_id").alias("keep_doc"), F.col("first.pos").alias("keep_pos"))


COLUMNS = "doc_id long, text string, n_paragraphs long, n_shared long, n_removed long, removed_of array<long>, kept_sha256 string"
_NO_ID = np.iinfo(np.int64).min


def _without(texts: tn.Texts, x: Lines, drop: np.ndarray, p: Pieces, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    """Each text without the dropped lines and without the words lo .. hi-1 of each passage; lines of which no word is left go."""
    delta = np.zeros(len(p.start) + 1, np.int64)
    np.add.at(delta, lo, 1)
    np.add.at(delta, hi, -1)
    left = np.r_[0, np.cumsum(np.cumsum(delta)[:-1] == 0)]
    line_lo, line_hi = np.searchsorted(p.start, x.start), np.searchsorted(p.start, x.end)
    drop = drop | (x.full & (left[line_hi] == left[line_lo]))
    # a passage's bytes go up to the next word, or to the end of the line
    line = np.searchsorted(x.start, p.start[hi - 1], "right") - 1
    stop = np.minimum(np.r_[p.start, len(texts.data)][hi], x.end[line])
    edge = np.zeros(len(texts.data) + 1, np.int64)
    np.add.at(edge, p.start[lo], 1)
    np.add.at(edge, stop, -1)
    stays = np.cumsum(edge)[:-1] == 0
    touched = np.zeros(len(texts), bool)
    touched[x.doc[drop]] = touched[p.word_doc[lo]] = True
    out = []
    for k in range(len(texts)):
        rows = [i for i in range(x.cut[k], x.cut[k + 1]) if not drop[i]] if touched[k] else None
        out.append(texts.text(k) if rows is None else b"\n".join(texts.data[a:b][stays[a:b]].tobytes() for a, b in zip(x.start[rows].tolist(), x.end[rows].tolist(), strict=True)))
    return out


def paragraph_dedup(docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS, passages: bool = False) -> DataFrame:
    """``doc_id, text, n_paragraphs, n_shared, n_removed, removed_of, kept_sha256`` of each row.

    ``n_shared`` counts the paragraphs of a cluster, ``n_removed`` those that go;
    ``removed_of`` lists the documents that keep them.  With ``passages``, runs of
    shared pieces that reach beyond such paragraphs count and go too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    work = Workspace(spark, "paragraphs")
    dup = clusters(docs, work)
    if passages:  # a piece's place in its document is told by the text: the first stays
        dup = dup.unionByName(shared_pieces(docs).withColumn("keep_pos", F.lit(None).cast("long")))
    dup = work.save(dup, "duplicates")

    def found(key, doc, ids, pos, table):
        """Which keys are shared, which of these go, and whose they are; without positions, the first in a document stays."""
        keys, keep_doc, *keep_pos = table
        shared = is_in(key, keys)
        if not len(keys):
            return shared, shared, np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        if keep_pos:
            other = keep_pos[0][at] != pos
        else:
            other = np.ones(len(key), bool)
            other[np.unique(tn.mix(key.view(tn.U64) + doc.astype(tn.U64) * tn.U64(tn._P)), return_index=True)[1]] = False
        return shared, shared & ((keep_doc[at] != ids) | other), keep_doc[at]

    def reduce(batch, texts, tables):
        p = Paragraphs(texts)
        n, x = len(texts), p.lines
        ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
        shared, gone, of = found(p.key, p.doc, ids[p.doc], p.pos, tables[0])
        drop, is_shared = np.zeros(len(x.key), bool), np.zeros(len(x.key), bool)
        drop[p.at[gone]], is_shared[p.at[shared]] = True, True
        n_shared, owner, of = np.bincount(p.doc[shared], minlength=n), p.doc[gone], of[gone]
        if passages:
            y = Pieces(texts)
            line = np.searchsorted(x.start, y.start, "right") - 1
            also, goes, whose = found(y.key, y.doc, ids[y.doc], None, tables[1])

            def beyond(which, lines):
                """The passages with a word outside the marked lines."""
                lo, hi = y.runs(which)
                outside = np.r_[0, np.cumsum(~lines[line])]
                some = outside[hi] > outside[lo]
                return lo[some], hi[some]

            n_shared = n_shared + np.bincount(y.word_doc[beyond(also, is_shared)[0]], minlength=n)
            lo, hi = beyond(goes, drop)
            inside = ragged(np.searchsorted(y.first, lo), np.searchsorted(y.first, hi) - np.searchsorted(y.first, lo))
            owner, of = np.r_[owner, y.doc[inside]], np.r_[of, whose[inside]]
            kept = _without(texts, x, drop, y, lo, hi)
            n_drop = np.bincount(x.doc[drop], minlength=n) + np.bincount(y.word_doc[lo], minlength=n)
        else:
            kept, n_drop = _rebuild(texts, x, drop)
        pairs = np.unique(np.stack([owner, of]), axis=1) if len(owner) else np.empty((2, 0), np.int64)
        cut = np.searchsorted(pairs[0], np.arange(n + 1))
        kept = [str(b, "utf-8") for b in kept]
        return {"doc_id": batch.column("doc_id"), "text": kept, "n_paragraphs": np.bincount(p.doc, minlength=n), "n_shared": n_shared, "n_removed": n_drop, "removed_of": lists(cut, pairs[1], pa.int64()), "kept_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in kept]}

    if dup.count() <= broadcast_keys:
        tables = []
        for kind, names in (("keep_pos is not null", ("key", "keep_doc", "keep_pos")), ("keep_pos is null", ("key", "keep_doc"))):
            rows = dup.where(kind).select(*names).toArrow()
            order = np.argsort(rows["key"].to_numpy())
            tables.append(tuple(rows[c].to_numpy()[order] for c in names))
            del rows
        handle = spark.sparkContext.broadcast(tables)
        work.clear()

        def run(batches):
            for batch, texts in tn.chunks(batches):
                yield reduce(batch, texts, handle.value)

        return map_arrow(docs, run, COLUMNS)

    def list_keys(batches):
        for batch, texts in tn.chunks(batches):
            x = [Paragraphs(texts)] + ([Pieces(texts)] if passages else [])
            doc, key = np.concatenate([p.doc for p in x]), np.concatenate([p.key for p in x])
            order = np.argsort(doc, kind="stable")
            yield {"mark": batch.column("mark"), "keys": lists(np.searchsorted(doc[order], np.arange(len(texts) + 1)), key[order], pa.int64())}

    def run_joined(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                rows = sorted((tuple(r[c] for c in ("key", "keep_doc", "keep_pos")) for r in one.column("gone")[0].as_py() or []), key=lambda r: r[0])
                tables = [tuple(np.array([r[i] for r in rows if (r[2] is None) == piece], np.int64) for i in range(3 - piece)) for piece in (0, 1)]
                yield reduce(one, tn.Texts.of(one.column("text")), tables)

    # rows with equal texts have equal keys, so the text's hash is a mark that no null disturbs
    marked = docs.withColumn("mark", F.xxhash64("text"))
    own = map_arrow(marked.select("mark", "text"), list_keys, "mark long, keys array<long>")
    own = own.distinct().select("mark", F.explode(F.array_distinct("keys")).alias("key"))
    gone = own.join(dup, "key").groupBy("mark").agg(F.collect_list(F.struct("key", "keep_doc", "keep_pos")).alias("gone"))
    return map_arrow(marked.join(gone, "mark", "left").drop("mark"), run_joined, COLUMNS)
