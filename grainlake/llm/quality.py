"""Quality rules: a hashed n-gram log-likelihood ratio behind plain repetition rules.

Every text is a bag of hashed word unigrams and bigrams.  The ratio compares a
multinomial of a trusted target (labelled rows) with one of the raw corpus (all
rows), per n-gram; a document is kept from a fixed threshold on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Words, chunks, keep_rows, materialise, mix64, text_bytes

BUCKETS = 1 << 16
#: The threshold lies on or between multiples of 1 / GRID, so that the labelled rows are summed by Spark before it is chosen.
GRID = 1 << 14
#: Where no row is labelled 0, this share of the trusted rows falls below the threshold.
LOST = 0.002
SYMBOLS = b"#*$%&|<>"


def _ngrams(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs, and the number of each document's buckets before it."""
    n = np.diff(w.offsets)
    first = np.ones(len(h), bool)
    first[w.offsets[:-1][n > 0]] = False
    pair = np.zeros(len(h), np.uint64)
    pair[1:] = mix64(h[:-1] * np.uint64(3) + h[1:])
    buckets = np.empty(2 * len(h), np.int64)
    buckets[0::2] = h & np.uint64(BUCKETS - 1)
    buckets[1::2] = pair & np.uint64(BUCKETS - 1)
    keep = np.ones(2 * len(h), bool)
    keep[1::2] = first
    each = np.where(n > 0, 2 * n - 1, 0)
    return buckets[keep], np.r_[0, np.cumsum(each)]


def ngram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(bucket, n)``: hashed n-gram counts over all texts, summed within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in chunks(batches, "text"):
            w = Words(b.column(0))
            total += np.bincount(_ngrams(w, w.hashes())[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


@dataclass
class QualityModel:
    ratio: np.ndarray
    threshold: float


def _repeated(w: Words, h: np.ndarray) -> np.ndarray:
    """Per document, its words inside three-word windows that occur twice or more."""
    n = len(h)
    if n < 3:
        return np.zeros(len(w.offsets) - 1, np.int64)
    doc = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
    at = np.flatnonzero(doc[2:] == doc[:-2])
    key = mix64(mix64(mix64(h[at] + doc[at].astype(np.uint64)) + h[at + 1]) + h[at + 2])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int32)
    edge[at[twice]] += 1
    edge[at[twice] + 3] -= 1
    covered = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
    return covered[w.offsets[1:]] - covered[w.offsets[:-1]]


def _duplicate_lines(texts: list) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    strip = SPACE.decode()
    for k, text in enumerate(texts):
        if text and "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(strip)]
            out[k] = len(lines) - len(set(lines))
    return out


def _verdict(column: pa.Array, m: QualityModel | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, repeated words, whether the plain rules fail, the log ratio, and whether the text is kept."""
    exact = Words(column, lower=False)
    n_words = np.diff(exact.offsets)
    repeat = _repeated(exact, exact.hashes())
    failed = (n_words < 50) | (100 * repeat > 50 * n_words)
    llr = np.zeros(len(n_words))
    if m is not None:
        w = Words(column)
        buckets, begin = _ngrams(w, w.hashes())
        total = np.r_[0.0, np.cumsum(m.ratio[buckets])]
        # rounded, so that copies of a text agree to the last digit
        llr = np.round((total[begin[1:]] - total[begin[:-1]]) / np.maximum(1, np.diff(begin)), 9)
    return n_words, repeat, failed, llr, ~failed & (m is None or llr >= m.threshold)


def good(docs: DataFrame, model: QualityModel | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is kept; cases as in ``measure``."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda column: _verdict(column, broadcast.value)[4])


def measure(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, ``base_failed``, ``llr`` and ``kept``.

    ``llr`` is the mean log ratio of the text's n-grams (0 without words).
    Without a model every text that passes the plain rules is kept.  Null and
    empty texts have no words and fail; repeated rows each keep a row.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    space = np.zeros(256, bool)
    space[list(SPACE)] = True

    def per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return total[at[1:]] - total[at[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        for b in chunks(batches, "text"):
            data, at = text_bytes(b.column(1))
            n_words, repeat, failed, llr, kept = _verdict(b.column(1), m)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(n_words.astype(np.int64)),
                    pa.array(per_doc(~space[data] & ((data & 0xC0) != 0x80), at).astype(np.int64)),
                    pa.array(per_doc(symbol[data], at).astype(np.int64)),
                    pa.array(_duplicate_lines(b.column(1).to_pylist())),
                    pa.array(repeat.astype(np.int64)),
                    pa.array(failed),
                    pa.array(llr),
                    pa.array(kept),
                ],
                ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"],
            )

    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
    return source.mapInArrow(run, f"id {kind}, {schema}")


def _cut(step: np.ndarray, good: np.ndarray, poor: np.ndarray) -> float:
    """The middle of the gap that parts the two labels with the fewest mistakes, of equals the lowest of the widest.

    ``step``: ascending multiples of 1 / ``GRID`` that log ratios were rounded
    down to, ``good`` and ``poor``: how many rows of either label each has.
    Without rows labelled 0, at most ``LOST`` of the trusted rows fall below it.
    """
    if not poor.sum():
        return float(step[np.searchsorted(np.cumsum(good), LOST * good.sum(), "right")]) / GRID if len(step) else -np.inf
    if not good.sum():
        return np.inf
    mistakes = np.r_[0, np.cumsum(good)] + poor.sum() - np.r_[0, np.cumsum(poor)]
    low, high = np.r_[step[0] - GRID, step + 1], np.r_[step, step[-1] + GRID]
    best = np.flatnonzero(mistakes == mistakes.min())
    best = best[np.argmax((high - low)[best])]
    return float(low[best] + high[best]) / (2 * GRID)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> QualityModel | None:
    """Raw counts over all documents, target counts and threshold from all labelled rows.

    Rows labelled 1 are the trusted target.  The threshold is fitted on those of either label
    that pass the plain rules, each trusted text's own n-grams taken out, so
    that it holds for texts that are not among the labelled ones.  Ids labelled both ways count as labelled 0,
    null ids and labels are left out, and of several texts with one id the
    first in order is taken.  None without trusted rows.
    """
    raw = np.zeros(BUCKETS)
    for bucket, n in ngram_counts(docs, text_col).collect():
        raw[bucket] = n
    label = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(quality_col).alias("quality"))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # ids alone are counted first, so that texts are grouped for repeated ids only, whose rows would repeat a document's weight
    label = materialise(text.groupBy("id").agg(F.count("*").alias("times")).join(label, "id"), "labels")
    once = text.join(label.where("times = 1"), "id").select("id", "text", "quality")
    many = label.where("times > 1")
    if not many.isEmpty():
        once = once.unionByName(text.join(many, "id").groupBy("id", "quality").agg(F.min("text").alias("text")))
    labelled = materialise(once, "labelled")
    target = np.zeros(BUCKETS)
    for bucket, n in ngram_counts(labelled.where("quality = 1")).collect():
        target[bucket] = n
    if not target.sum():
        return None
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    model = QualityModel(ratio, -np.inf)
    counts = docs.sparkSession.sparkContext.broadcast((target, raw))

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The log ratio of each labelled text as if it were none of the trusted ones: its own n-grams taken out of the target."""
        target, raw = counts.value
        for b in chunks(batches, "text"):
            trusted = b.column(2).to_numpy() == 1
            failed = _verdict(b.column(1), None)[2]
            w = Words(b.column(1))
            buckets, begin = _ngrams(w, w.hashes())
            llr = np.zeros(len(failed))
            for k in np.flatnonzero(~failed).tolist():
                own, times = np.unique(buckets[begin[k] : begin[k + 1]], return_counts=True)
                rest = target[own] - times * trusted[k]
                total = target.sum() - times.sum() * trusted[k]
                each = np.log((rest + 1) / (total + BUCKETS)) - np.log((raw[own] + 1) / (raw.sum() + BUCKETS))
                llr[k] = (each * times).sum() / times.sum()
            keep = np.flatnonzero(~failed)
            step = np.floor(np.round(llr[keep], 9) * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(trusted[keep].astype(np.int64))], ["step", "good"])

    passed = labelled.select("id", "text", "quality").mapInArrow(held_out, "step long, good long")
    passed = passed.groupBy("step").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("poor")).orderBy("step").toPandas()
    model.threshold = _cut(*(passed[c].to_numpy(np.int64) for c in ("step", "good", "poor")))
    return model
