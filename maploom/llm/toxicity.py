"""Toxicity scores of deobfuscated text.

A noisy channel writes words with look-alike characters, letters spaced out or
repeated.  Suspicious tokens become a lattice of what each character may stand
for; a Viterbi decoder finds the likeliest letters under a trigram character
language model, counted over all texts.  Characters set apart by blanks (runs of
``SPACED`` or more words of one character, repeated or not, one of them a letter)
are a lattice too, decoded as one word and with optional word boundaries.  Tokens
without any letter are numbers or marks and stay as they are.  The
words of a text, restored and as they are, are features of a logistic regression
fitted on labelled documents.

The model is fitted on at most ``TRAIN_DOCS`` labelled rows (those with the
smallest hash of doc_id), none of them held out: rows whose crc32 of doc_id as
text is 2 modulo 4 are never used for learning.  Labels, lang, source and doc_id
never enter a score.  Of several labels for a document the largest counts.

Defined results: a null or empty text has the score of the intercept.  Repeated
texts get equal scores; a null doc_id is not held out.  If all labels are 1 every
score is 1; if all are 0, or there are none, every score is 0.  Texts are read
whole, however long.  Columns other than doc_id and text (of labels: doc_id and
toxic) are never read.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import Workspace, docs_of, kept, lists, map_arrow, small_batches
from .line_dedup import is_in

TRAIN_DOCS, FEATURES, THRESHOLD = 20_000, 4096, 0.3

# The letters that a character may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h", "%": "x",
}
SUBSTITUTE, REPEAT, SEPARATOR = 1.0, 0.4, 0.8  # channel costs in nats
SPACED = 3

_LETTER = np.zeros(256, np.int64)
_LETTER[97:123] = np.arange(1, 27)
_LETTER[65:91] = np.arange(1, 27)
_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in LOOKALIKE]] = True
_ODD[[ord(c) for c in "._-~"]] = True
_WORDY = np.zeros(256, bool)  # bytes that a trimmed word may begin and end with
_WORDY[128:] = True
_WORDY[48:58] = True
_WORDY[65:91] = True
_WORDY[97:123] = True


def letter_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams (26 letters and a boundary) over all texts; 27**3 numbers at any input size."""

    def count(batches):
        total = np.zeros(27**3, np.int64)
        for _, texts in tn.chunks(batches):
            c = _LETTER[texts.data]
            if len(c) > 2:
                total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield {"gram": at, "n": total[at]}

    rows = map_arrow(docs.select("text"), count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(27**3, np.int64)
    out[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


class Decoder:
    """Viterbi decoding of tokens to letters."""

    def __init__(self, trigrams: np.ndarray):
        n = trigrams.reshape(27, 27, 27) + 0.5
        self.cost = -np.log(n / n.sum(axis=2, keepdims=True))
        self.known: dict[str, str] = {}

    def __call__(self, token: str, spaced: bool = False) -> str:
        """The likeliest letters; of a spaced token with blanks between words."""
        if len(token) > 40:  # rarely met again
            return self._decode(token, spaced)
        out = self.known.get((token, spaced))
        if out is None:
            if len(self.known) > 100_000:
                self.known.clear()
            out = self.known[token, spaced] = self._decode(token, spaced)
        return out

    def _decode(self, token: str, spaced: bool) -> str:
        cost, states, before, done = self.cost, {(0, 0): (0.0, "")}, "", []
        for at, ch in enumerate(token.lower(), 1):
            if "a" <= ch <= "z":
                options = [(ch, ord(ch) - 96, 0.0)]
            elif ch.isalnum() and ch not in LOOKALIKE:  # a letter outside the model stands for itself
                options = [(ch, 0, 0.0)]
            else:
                options = [(x, ord(x) - 96, SUBSTITUTE + (1.0 if len(LOOKALIKE[ch]) > 2 else 0.0)) for x in LOOKALIKE.get(ch, "")]
            skip = REPEAT if ch == before else SEPARATOR if not ch.isalnum() else None
            if spaced:
                for (a, b), (c, s) in list(states.items()):
                    total = c + cost[a, b, 0]
                    if b and total < states.get((b, 0), (np.inf,))[0]:
                        states[b, 0] = (total, s + " ")
            following: dict = {}
            for (a, b), (c, s) in states.items():
                if skip is not None and (c + skip) < following.get((a, b), (np.inf,))[0]:
                    following[a, b] = (c + skip, s)
                for x, k, extra in options:
                    total = c + extra + cost[a, b, k]
                    if total < following.get((b, k), (np.inf,))[0]:
                        following[b, k] = (total, s + x)
            states, before = following, ch
            if at % 32 == 0:  # what all paths share is settled
                least, most = min(s for _, s in states.values()), max(s for _, s in states.values())
                n = next((k for k, x in enumerate(least) if x != most[k]), len(least))
                done.append(least[:n])
                states = {k: (c, s[n:]) for k, (c, s) in states.items()}
        return "".join(done) + min((c + cost[a, b, 0], s) for (a, b), (c, s) in states.items())[1]


def word_features(texts: tn.Texts, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature hash) of the distinct words, word beginnings and restored words."""
    low = texts.lower()
    d = low.data
    start, end, doc = low.runs()
    n_odd, n_letter = np.r_[0, np.cumsum(_ODD[d])], np.r_[0, np.cumsum(_LETTER[d] > 0)]
    triple = np.zeros(len(d) + 1, np.int64)
    if len(d) > 2:
        triple[1:-2] = (d[2:] == d[1:-1]) & (d[1:-1] == d[:-2]) & (_LETTER[d[2:]] > 0)
    triple = np.cumsum(triple)
    left, right = start.copy(), end.copy()
    moved = len(left) > 0
    while moved:  # trim other characters from both ends
        a = (left < right) & ~_WORDY[d[np.minimum(left, len(d) - 1)]]
        b = (left < right) & ~a & ~_WORDY[d[right - 1]]
        left += a
        right -= b
        moved = bool(a.any() or b.any())
    some = left < right
    feats, owners = [low.span_hash(left[some], right[some])], [doc[some]]
    for size in (5, 7):  # beginnings of words
        long = right - left > size
        feats.append(low.span_hash(left[long], left[long] + size) + tn.U64(size))
        owners.append(doc[long])
    letters = n_letter[end] - n_letter[start]
    inner = n_odd[np.maximum(right, left)] - n_odd[left]
    whole = n_odd[end] - n_odd[start]
    odd = (letters > 0) & ((inner > 0) | (whole > 0) | (triple[end] - triple[start] > 0))
    restored, owner = [], []
    raw = d.tobytes()
    for k in np.flatnonzero(odd).tolist():
        restored.append(decoder(raw[start[k] : end[k]].decode()))
        owner.append(doc[k])
    # words of one character, repeated or not: a trimmed letter or digit, or a whole mark
    a, b = np.where(some, left, start), np.where(some, right, end)
    change = np.r_[0, np.cumsum(d[1:] != d[:-1]), 0][: len(d) + 1]
    single = (change[b - 1] == change[a]) & ((_LETTER[d[a]] > 0) | _ODD[d[a]])
    joined = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
    first = np.flatnonzero(single & ~np.r_[False, joined][: len(single)])
    last = np.flatnonzero(single & ~np.r_[joined, False][: len(single)]) + 1
    n_single = np.r_[0, np.cumsum(single & (_LETTER[d[a]] > 0))]
    long = (last - first >= SPACED) & (n_single[last] > n_single[first])
    for lo, hi in zip(first[long].tolist(), last[long].tolist(), strict=True):
        token = b"".join(raw[x:y] for x, y in zip(a[lo:hi].tolist(), b[lo:hi].tolist(), strict=True)).decode()
        words = {token, decoder(token), *decoder(token, spaced=True).split()}
        restored += sorted(words)
        owner += [doc[lo]] * len(words)
    if restored:
        parts = [r.encode() for r in restored]
        cut = np.r_[0, np.cumsum([len(p) for p in parts])]
        other = tn.Texts(np.frombuffer(b"".join(parts), np.uint8), cut)
        full = np.flatnonzero(np.diff(cut) > 0)
        feats.append(other.span_hash(cut[full], cut[full + 1]))
        owners.append(np.array(owner, np.int64)[full])
    return np.concatenate(owners), np.concatenate(feats)


def _decoder(handle) -> Decoder:
    raw = handle.value
    return kept(("trigrams", hash(raw)), lambda: Decoder(np.frombuffer(raw, np.int64)))


def is_held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text is 2 modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of at most TRAIN_DOCS labelled documents that are not held out."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    labels = labels.where(~F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    return docs.join(F.broadcast(labels), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, trigrams, work: Workspace) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes, their weights and the intercept."""
    none = np.empty(0, np.int64), np.empty(0)
    train = work.save(training_rows(docs, labels), "train")

    def list_features(batches):
        for batch, texts in tn.chunks(batches):
            owner, feats = word_features(texts, _decoder(trigrams))
            pairs = np.unique(np.stack([owner, feats.view(np.int64)]), axis=1)
            yield {"toxic": batch.column("toxic").cast("int32"), "feature": lists(np.searchsorted(pairs[0], np.arange(len(texts) + 1)), pairs[1], pa.int64())}

    rows = work.save(map_arrow(train, list_features, "toxic int, feature array<long>", keeps=True), "train-features")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    positive, negative = n.get(1, 0), n.get(0, 0)
    if not positive or not negative:
        return *none, 50.0 if positive else -50.0
    counts = rows.select("toxic", F.explode("feature").alias("f")).groupBy("f").agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).where("n >= 3")
    rate = positive / (positive + negative)
    gain = F.abs(F.col("p") - F.col("n") * rate) / F.sqrt(F.col("n") * F.lit(rate * (1 - rate)))
    top = counts.orderBy(gain.desc(), "f").limit(FEATURES).select("f").toPandas()["f"].to_numpy(np.int64)
    table = np.sort(top)
    handle = docs.sparkSession.sparkContext.broadcast(table)

    def pick(batches):
        for b in batches:
            f = b.column("feature")
            values, cut = f.flatten().to_numpy(), np.r_[0, np.cumsum(f.value_lengths().to_numpy())]
            hit = is_in(values, handle.value)
            cut = np.r_[0, np.cumsum(hit)][cut]
            yield {"toxic": b.column("toxic"), "at": lists(cut, np.searchsorted(handle.value, values[hit]).astype(np.int32), pa.int32())}

    data = map_arrow(rows, pick, "toxic int, at array<int>").toPandas()
    y = data["toxic"].to_numpy(np.float64)
    size = np.array([len(x) for x in data["at"]])
    col = np.concatenate([np.asarray(x, np.int64) for x in data["at"]]) if size.sum() else np.empty(0, np.int64)
    return table, *_logistic(np.repeat(np.arange(len(y)), size), col, y, len(table))


def _logistic(row, col, y, n_features, l2=1.0, steps=200):
    """L2-regularised logistic regression by Adam on the whole batch."""
    w, b = np.zeros(n_features), np.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(y)) + b, -50, 50)))
        g = np.r_[np.bincount(col, (p - y)[row], n_features) + l2 * w, (p - y).sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return np.round(w, 9), float(round(b, 9))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs_of(docs, "doc_id", "text")
    work = Workspace(spark, "toxicity")
    trigrams = spark.sparkContext.broadcast(letter_trigrams(docs).tobytes())
    table, weights, intercept = fit(docs, labels, trigrams, work)
    handle = spark.sparkContext.broadcast((table, weights, intercept))
    work.clear()

    def run(batches):
        table, weights, intercept = handle.value
        for batch, texts in tn.chunks(batches):
            owner, feats = word_features(texts, _decoder(trigrams))
            feats = feats.view(np.int64)
            hit = is_in(feats, table)
            z = np.full(len(texts), intercept)
            if hit.any():
                pairs = np.unique(np.stack([owner[hit], np.searchsorted(table, feats[hit])]), axis=1)
                z += np.bincount(pairs[0], weights[pairs[1]], minlength=len(texts))
            score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield {"doc_id": batch.column("doc_id"), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

    scored = map_arrow(docs.withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, score double, predicted int", keeps=True)
    return scored.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
