"""Line deduplication over levelled sorted runs of line hashes.

A run is a saved table of (line key, documents that have it), bucketed and sorted
by key.  Each batch of documents is merge-anti-joined with the runs: the lines that
no earlier batch had become its own run of level 0, the others a tally.  When a
level has ``fanout`` runs they are merged into one run of the next level, so a key
is rewritten only once per level.  A key's documents are those of its run and of
the tallies; most keys are in one batch only and are never counted again.

A line's key is the 64-bit hash of the line without ``[\\x20\\x09-\\x0D]`` at both
ends and with A-Z lower-cased.

Defined results: a null or empty text is one empty line, which is never dropped.
Each row is a document, also if rows share a doc_id, are repeated, or have none.
Texts are read whole, however long.  Only the named columns are read; others,
whatever their names, never matter.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import Workspace, docs_of, lists, map_arrow, small_batches

#: Most frequent keys that are broadcast (8 bytes each); beyond it they are joined.
BROADCAST_KEYS = 1_000_000
BATCHES, FANOUT = 4, 2


class Lines:
    """The \\n-separated lines of a chunk of texts: document, span and key."""

    def __init__(self, texts: tn.Texts):
        n = len(texts)
        at = np.flatnonzero(texts.data == 10)
        at_doc = np.searchsorted(texts.offsets, at, "right") - 1
        start = np.concatenate([texts.offsets[:-1], at + 1])
        doc = np.concatenate([np.arange(n), at_doc])
        order = np.lexsort((start, doc))
        self.start, self.doc = start[order], doc[order]
        last = np.r_[self.doc[1:] != self.doc[:-1], True] if n else np.empty(0, bool)
        self.end = np.where(last, texts.offsets[self.doc + 1], np.r_[self.start[1:], 0] - 1)
        word, word_end, _ = texts.runs()
        lo = np.searchsorted(word, self.start)
        hi = np.searchsorted(word, self.end)
        self.n_words = hi - lo
        self.full = self.n_words > 0
        self.key = np.zeros(len(self.start), tn.U64)
        self.key[self.full] = texts.lower().span_hash(word[lo[self.full]], word_end[hi[self.full] - 1])
        self.key = self.key.view(np.int64)
        self.cut = np.searchsorted(self.doc, np.arange(n + 1))


def line_keys(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``batch, key, docs``: for each task's texts, how many documents have a line."""

    def run(parts):
        for batch, texts in tn.chunks(parts):
            x = Lines(texts)
            ids = batch.column("part").to_numpy()[x.doc[x.full]]
            rows = np.unique(np.stack([x.doc[x.full], x.key[x.full], ids]), axis=1)[1:]
            if rows.shape[1]:
                keys, count = np.unique(rows[::-1], axis=1, return_counts=True)
                yield {"batch": keys[0], "key": keys[1], "docs": count}

    rows = docs.select("text", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(batches)).alias("part"))
    return map_arrow(rows, run, "batch long, key long, docs long")


class LineRuns:
    """Levelled sorted runs of ``key, docs`` in a workspace.

    A key is in one run only, that of the batch that had it first; later sightings
    are tallies.  Runs are bucketed and sorted by key, so joins of a batch with them
    merge without another shuffle of the runs.
    """

    def __init__(self, work: Workspace, fanout: int = FANOUT):
        self.work, self.fanout, self.levels, self.tallies = work, fanout, {}, []
        self.buckets = int(work.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        return self.work.bucketed(rows, name, "key", self.buckets)

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join a batch's ``key, docs`` with the runs and add its own run; full levels are compacted."""
        own = self._write(batch.groupBy("key").agg(F.sum("docs").alias("docs")), "batch")
        run = own
        if any(self.levels.values()):
            run = self._write(self.unseen(own), "run-0")
            self.tallies.append(self.work.save(own.join(run.select("key").hint("merge"), "key", "left_anti"), "tally"))
            self.work.drop(own)
        level = 0
        while True:
            have = self.levels.setdefault(level, [])
            have.append(run)
            if len(have) < self.fanout:
                return
            level += 1
            run = self._write(self._union(have).repartition(self.buckets, "key"), f"run-{level}")
            self.work.drop(*have)
            have.clear()

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` whose key no run has (merge anti-join)."""
        for have in self.levels.values():
            for run in have:
                batch = batch.join(run.select("key").hint("merge"), "key", "left_anti")
        return batch

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys found in at least ``min_docs`` documents of all batches; only keys of several batches are counted again."""
        runs = [r for have in self.levels.values() for r in have]
        out = self._union(runs).where(F.col("docs") >= min_docs).select("key")
        if not self.tallies:
            return out
        again = self._union(self.tallies).groupBy("key").agg(F.sum("docs").alias("again"))
        again = self.work.save(again, "again")
        both = self._union([r.join(again.hint("merge"), "key") for r in runs])
        return out.union(both.where((F.col("docs") < min_docs) & (F.col("docs") + F.col("again") >= min_docs)).select("key"))


def _rebuild(texts: tn.Texts, x: Lines, drop: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Each text without its dropped lines, and how many those were."""
    n_drop = np.bincount(x.doc[drop], minlength=len(texts)).astype(np.int64)
    raw, out = texts.data.tobytes(), []
    for k in range(len(texts)):
        if n_drop[k]:
            out.append(b"\n".join(raw[x.start[i] : x.end[i]] for i in range(x.cut[k], x.cut[k + 1]) if not drop[i]))
        else:
            out.append(raw[texts.offsets[k] : texts.offsets[k + 1]])
    return out, n_drop


def _output(batch, names, texts, x, drop):
    kept, n_drop = _rebuild(texts, x, drop)
    kept = [str(b, "utf-8") for b in kept]
    cols = {c: pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in names}
    return cols | {"n_lines": np.diff(x.cut), "n_dropped": n_drop, "kept_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in kept]}


def line_dedup(docs: DataFrame, min_docs: int = 10, columns: tuple[str, ...] = ("doc_id", "text"), broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``columns`` of each row with ``text`` reduced, ``n_lines, n_dropped, kept_sha256``.

    Lines whose key is found in at least ``min_docs`` documents go from all of
    them.  Up to ``broadcast_keys`` such keys are broadcast; more are joined with
    each text's keys and then with the documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs_of(docs, *columns)
    work = Workspace(spark, "lines")
    keys = work.save(line_keys(docs), "keys")
    runs = LineRuns(work)
    for k in range(BATCHES):
        runs.add(keys.where(F.col("batch") == k).select("key", "docs"))
    hot = work.save(runs.frequent(min_docs), "hot")
    work.drop(keys, *[r for have in runs.levels.values() for r in have])
    kinds = {f.name: f.dataType.simpleString().replace("bigint", "long") for f in docs.schema.fields}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", n_lines long, n_dropped long, kept_sha256 string"
    if hot.count() <= broadcast_keys:
        found = np.sort(hot.toPandas()["key"].to_numpy(np.int64))
        handle = spark.sparkContext.broadcast(found)
        work.clear()

        def run(batches):
            table = handle.value
            for batch, texts in tn.chunks(batches):
                x = Lines(texts)
                yield _output(batch, columns, texts, x, x.full & is_in(x.key, table))

        return map_arrow(docs, run, ddl)

    def list_keys(batches):
        for batch, texts in tn.chunks(batches):
            x = Lines(texts)
            key = np.where(x.full, x.key, 0)
            yield {"mark": batch.column("mark"), "keys": lists(x.cut, key, pa.int64())}

    def run_joined(batches):
        for batch, texts in tn.chunks(batches):
            x = Lines(texts)
            drop = np.zeros(len(x.key), bool)
            for k, gone in enumerate(batch.column("gone").to_pylist()):
                if gone:
                    part = slice(x.cut[k], x.cut[k + 1])
                    drop[part] = x.full[part] & np.isin(x.key[part], np.array(gone, np.int64))
            yield _output(batch, columns, texts, x, drop)

    # equal texts have equal lines, so the text's hash is a mark that no null disturbs
    marked = docs.withColumn("mark", F.xxhash64("text"))
    own = map_arrow(marked.select("mark", "text"), list_keys, "mark long, keys array<long>")
    own = own.distinct().select("mark", F.explode(F.array_distinct("keys")).alias("key"))
    gone = own.join(hot, "key").groupBy("mark").agg(F.collect_list("key").alias("gone"))
    return map_arrow(marked.join(gone, "mark", "left").drop("mark"), run_joined, ddl)


def is_in(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(table):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return table[at] == keys
