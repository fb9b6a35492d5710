"""Vector code compression: product codes of integer vectors, found by equal-average search.

A vector's components become integers and the vector is cut into equal parts.
Each part has a codebook; a part's code is the index of its nearest entry.  The
search sorts a codebook by the entries' component sums and expands outward from
a part's own sum: a squared distance is never less than the squared gap between
the sums over the part's width, so a side is finished once that bound strictly
exceeds the best distance (equal ones are still looked at, since ties go to the
lower index).

Codebooks are small and of a fixed size (parts x entries x width); they alone
travel to the tasks and back.  Each round is one pass over all vectors, summed
within tasks before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCALE = 1024
#: Vectors of neighbouring sums that are searched together, and entries taken at a time on either side.
SEGMENT, STEP = 256, 16


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]``: the entries of part p, integers, one row each; all parts have the same number and width."""

    entries: tuple[np.ndarray, ...]

    @property
    def dimension(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lowest of equals, and its squared distance.

    Rows are searched in segments of neighbouring sums: first the entries
    within a segment's sums, then ``STEP`` entries at a time on either side, for
    those rows whose bound on that side does not exceed their best distance.
    """
    width, m = x.shape[1], len(entries)
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    # products are exact as doubles up to 2**53, else they are taken as integers
    kind = np.float64 if 4 * width * top * top < 1 << 53 else np.int64
    rank = np.argsort(entries.sum(axis=1), kind="stable")
    e = entries[rank].astype(kind)
    e_sum, e_square, et = entries[rank].sum(axis=1), (e * e).sum(axis=1), np.ascontiguousarray(e.T)
    sums = x.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    index, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for lo in range(0, len(x), SEGMENT):
        rows = order[lo : lo + SEGMENT]
        part, own = x[rows].astype(kind), sums[rows]
        square = (part * part).sum(axis=1)
        best = np.full(len(rows), np.iinfo(np.int64).max // width, np.int64)
        code = np.full(len(rows), m, np.int64)

        def look(some: np.ndarray, a: int, b: int) -> None:
            d = square[some, None] - 2 * (part[some] @ et[:, a:b]) + e_square[a:b]
            least = d.min(axis=1)
            first = np.where(d == least[:, None], rank[a:b], m).min(axis=1)
            least = least.astype(np.int64)
            better = (least < best[some]) | ((least == best[some]) & (first < code[some]))
            best[some[better]], code[some[better]] = least[better], first[better]

        left, right = int(np.searchsorted(e_sum, own[0])), int(np.searchsorted(e_sum, own[-1], "right"))
        if left < right:
            look(np.arange(len(rows)), left, right)
        while True:
            more = False
            if right < m and len(some := np.flatnonzero((e_sum[right] - own) ** 2 <= width * best)):
                look(some, right, min(m, right + STEP))
                right, more = min(m, right + STEP), True
            if left > 0 and len(some := np.flatnonzero((own - e_sum[left - 1]) ** 2 <= width * best)):
                look(some, max(0, left - STEP), left)
                left, more = max(0, left - STEP), True
            if not more:
                break
        index[rows], error[rows] = code, best
    return index, error


def _fits(vec: Column, dimension: int | None, parts: int) -> Column:
    """A vector that can be coded: no null or non-finite component, none so large that a squared distance would not fit a long."""
    size = F.size(vec) if dimension is None else F.lit(dimension)
    limit = F.sqrt(F.lit(2.0**61) / (size / parts)) / SCALE
    whole = F.forall(vec, lambda v: F.coalesce(F.abs(v.cast("double")) < limit, F.lit(False)))
    return vec.isNotNull() & (F.size(vec) > 0) & (F.size(vec) % parts == 0 if dimension is None else F.size(vec) == dimension) & whole


def integers(column: pa.Array, dimension: int) -> np.ndarray:
    """A list column of whole vectors as rows of ``floor(1024 x)``."""
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dimension)


def _cuts(dimension: int, parts: int) -> list[slice]:
    width = dimension // parts
    return [slice(p * width, (p + 1) * width) for p in range(parts)]


def coded_rows(vectors: DataFrame, dimension: int | None, parts: int, vec_col: str = "embedding") -> DataFrame:
    """The rows whose vectors can be coded."""
    return vectors.where(F.coalesce(_fits(F.col(vec_col), dimension, parts), F.lit(False)))


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = 4, size: int = 256, rounds: int = 4) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all vectors; None where no vector can be coded.

    They start as the parts of the ``size`` smallest ids (null ids last, rows of
    one id in order of their vectors).  In each round an entry becomes the
    componentwise floor of the mean of the parts nearest to it; entries without
    any stay.  The dimension is that of the smallest id with a vector that can
    be coded and be cut into ``parts``; other lengths are left out, as are
    vectors that are null or hold a null, a non-finite or a huge component.
    """
    named = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"))

    def smallest(dimension: int | None, n: int) -> list:
        rows = coded_rows(named, dimension, parts).orderBy(F.col("id").asc_nulls_last(), "embedding").limit(n)
        return [r.embedding for r in rows.select("embedding").collect()]

    # a codebook's worth of rows, whatever the table
    start = smallest(None, size)
    if not start:
        return None
    dimension = len(start[0])
    if any(len(v) != dimension for v in start):
        start = smallest(dimension, size)
    cuts = _cuts(dimension, parts)
    first = np.floor(SCALE * np.array(start, np.float64)).astype(np.int64)
    books = Codebooks(tuple(np.ascontiguousarray(first[:, c]) for c in cuts))
    rows = coded_rows(named, dimension, parts).select("embedding")
    for _ in range(rounds):
        books = _improved(rows, books, cuts)
    return books


def _improved(rows: DataFrame, books: Codebooks, cuts: list[slice]) -> Codebooks:
    width, size = cuts[0].stop, len(books.entries[0])
    names = ["part", "entry", "n", *(f"s{k}" for k in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(cuts), size, width + 1), np.int64)
        for b in batches:
            x = integers(b.column(0), books.dimension)
            for p, c in enumerate(cuts):
                index, _ = nearest(x[:, c], books.entries[p])
                np.add.at(total[p], index, np.column_stack([np.ones(len(x), np.int64), x[:, c]]))
        part, entry = np.nonzero(total[:, :, 0])
        found = total[part, entry]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), *(pa.array(v) for v in found.T)], names)

    sums = rows.mapInArrow(run, "part int, entry int, " + ", ".join(f"{n} long" for n in names[2:]))
    found = sums.groupBy("part", "entry").agg(*(F.sum(n).alias(n) for n in names[2:]))
    entries = [e.copy() for e in books.entries]
    # at most parts x entries rows
    for r in found.collect():
        entries[r.part][r.entry] = np.array(r[3:], np.int64) // r.n
    return Codebooks(tuple(entries))


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, label, code, error)``: two hex digits a part, and the squared distances summed over the parts.

    Rows whose vectors cannot be coded have no row; repeated ids keep a row each.
    """
    parts, cuts = len(books.entries), _cuts(books.dimension, len(books.entries))
    source = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("embedding"))
    kinds = {c: source.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column(2), books.dimension)
            codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, c in enumerate(cuts):
                index, far = nearest(x[:, c], books.entries[p])
                codes[:, p] = index
                error += far
            text = pa.Array.from_buffers(pa.string(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * 2 * parts).tobytes()), pa.py_buffer(codes.tobytes().hex().encode())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text, pa.array(error)], ["id", "label", "code", "error"])

    return coded_rows(source, books.dimension, parts).mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """The vectors that the codes stand for, as doubles: each part's entry, a half added before scaling back."""
    width = books.dimension // len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.frombuffer(bytes.fromhex("".join(b.column(1).to_pylist())), np.uint8).reshape(-1, len(books.entries))
            x = np.hstack([e[at[:, p]] for p, e in enumerate(books.entries)]) if len(at) else np.zeros((0, books.dimension))
            flat = pa.array(((x + 0.5) / SCALE).ravel(), pa.float64())
            offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * width * len(books.entries))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], ["id", "embedding"])

    return codes.select("id", "code").mapInArrow(run, f"id {codes.schema['id'].dataType.simpleString()}, embedding array<double>")


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the errors summed over equal labels, null ones together.

    Sums are taken within tasks first and written, so that few labels meet the
    rows by a broadcast that Spark plans from their known size; beyond its
    threshold the join shuffles, and skewed labels are split at run time.
    """
    codes = materialise(codes, "vector-codes")
    sums = materialise(codes.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(sums, codes.label.eqNullSafe(sums.of_label)).drop("of_label")
