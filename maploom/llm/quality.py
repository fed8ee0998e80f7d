"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths find the n-grams that occur
twice or more in a text; the share of a text's characters (code points inside
words) that lie in such n-grams, or in lines that occurred before, decides.

Defined results: a null or empty text has no words, fails the base rule and is
not kept.  Rows are judged one by one, so ties and repeated rows get equal
results, a null doc_id stays null, and an empty table gives no rows.  Texts are
read whole, however long.  :func:`quality` reads doc_id and text only;
:func:`keep_good` keeps all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import textnum as tn
from .common import docs_of, forget, map_arrow, small_batches

#: n-gram length: largest share (percent) of characters inside duplicated n-grams.
COVERAGE = {5: 45, 6: 42, 7: 39, 8: 36, 9: 33, 10: 30}
#: Largest share (percent) of characters inside lines that occurred before.
LINE_COVERAGE = 30
BASE_WORDS, BASE_REPEAT, BASE_WINDOW = 20, 30, 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, dup_line_chars long, dup_gram_chars array<long>, kept boolean"


def _per_doc(doc: np.ndarray, n_docs: int, weight=None) -> np.ndarray:
    return np.bincount(doc, weight, minlength=n_docs).astype(np.int64)


def _twice(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which entries have an equal hash elsewhere in the same document."""
    key = tn.mix(h + doc.astype(tn.U64) * tn.U64(0xA24BAED4963EE407))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def measure(texts: tn.Texts) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk."""
    n = len(texts)
    start, end, doc = texts.runs()
    words = texts.span_hash(start, end)
    points = np.r_[0, np.cumsum((texts.data & 0xC0) != 0x80)]
    chars = points[end] - points[start]
    symbol_at = np.flatnonzero(_SYMBOL[texts.data])
    out = {"n_words": _per_doc(doc, n), "word_chars": _per_doc(doc, n, chars), "n_symbols": _per_doc(np.searchsorted(texts.offsets, symbol_at, "right") - 1, n)}

    lo, hi, line_doc = texts.runs(_NEWLINE)
    first_word = np.searchsorted(start, lo)
    last_word = np.searchsorted(start, hi)
    full = last_word > first_word
    lo, hi, line_doc, first_word, last_word = lo[full], hi[full], line_doc[full], first_word[full], last_word[full]
    key = tn.mix(texts.span_hash(lo, hi) + line_doc.astype(tn.U64) * tn.U64(0xA24BAED4963EE407))
    _, first = np.unique(key, return_index=True)  # the first of equal lines, as the sort is stable
    again = np.ones(len(key), bool)
    again[first] = False
    char_sum = np.r_[0, np.cumsum(chars)]
    line_chars = char_sum[last_word] - char_sum[first_word]
    out["n_dup_lines"] = _per_doc(line_doc[again], n)
    out["dup_line_chars"] = _per_doc(line_doc[again], n, line_chars[again])

    grams, may = [], None
    for size in sorted({*COVERAGE, BASE_WINDOW}):
        h, owner, at = tn.windows(words, doc, n, size)
        if may is not None:  # a longer n-gram can only repeat where its shorter head does
            pick = may[at]
            h, owner, at = h[pick], owner[pick], at[pick]
        twice = _twice(owner, h)
        may = np.zeros(len(words) + 1, bool)
        may[at[twice]] = True
        delta = np.zeros(len(words) + 1, np.int64)
        np.add.at(delta, at[twice], 1)
        np.add.at(delta, at[twice] + size, -1)
        inside = np.cumsum(delta)[:-1] > 0
        if size == BASE_WINDOW:
            out["n_repeat_words"] = _per_doc(doc[inside], n)
        if size in COVERAGE:
            grams.append(_per_doc(doc[inside], n, chars[inside]))
    out["base_failed"] = (out["n_words"] < BASE_WORDS) | (100 * out["n_repeat_words"] > BASE_REPEAT * out["n_words"])
    grams = np.stack(grams, axis=1)
    limits = np.array([COVERAGE[k] for k in sorted(COVERAGE)])
    fine = (100 * grams <= limits * out["word_chars"][:, None]).all(axis=1) & (100 * out["dup_line_chars"] <= LINE_COVERAGE * out["word_chars"])
    return out | {"dup_gram_chars": grams, "kept": ~out["base_failed"] & fine}


def quality(docs: DataFrame) -> DataFrame:
    """The counts and verdict of each row of ``docs(doc_id, text)``; no shuffle.

    ``dup_gram_chars`` has an entry for each length of :data:`COVERAGE`.
    """

    def run(batches):
        for batch, texts in tn.chunks(batches):
            m = measure(texts)
            yield {"doc_id": batch.column("doc_id").cast("int64")} | {k: m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "dup_line_chars")} | {"dup_gram_chars": list(m["dup_gram_chars"]), "kept": m["kept"]}

    small_batches(docs.sparkSession)
    return map_arrow(docs_of(docs, "doc_id", "text"), run, COLUMNS)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns; order of columns unchanged."""

    def run(batches):
        forget()
        with np.errstate(over="ignore"):
            for batch, texts in tn.chunks(batches):
                yield batch.filter(_mask(measure(texts)["kept"]))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def _mask(keep: np.ndarray):
    import pyarrow as pa

    return pa.array(keep, pa.bool_())
