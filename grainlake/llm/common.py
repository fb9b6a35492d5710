"""Helpers that the operators of this subpackage share.

Texts reach Python as Arrow string columns.  ``chunks`` cuts a stream of record
batches into pieces of a bounded number of text bytes, and ``Words`` finds the
words of such a piece with numpy alone, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, materialise, shared_dir

__all__ = ["ALNUM", "SPACED", "Words", "chunks", "fresh_path", "keep_rows", "materialise", "mix64", "packed_counts", "power_tables", "read_table", "release", "shared_dir", "summed_counts", "text_bytes"]

SPACE = bytes([0x20, *range(0x09, 0x0E)])
CHUNK_BYTES = 1 << 18
#: Counts in a block of a long array of them.
COUNTS = 1 << 16
#: Base of the polynomial word hash (odd, so that it has an inverse modulo 2**64).
HASH_BASE = 0x9E3779B97F4A7C15


#: Tables that a worker keeps for later tasks of an operator.
KEPT: list[dict] = []


def release() -> None:
    """Empty the tables that this worker keeps, before a task that needs the memory."""
    for tables in KEPT:
        tables.clear()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(
    batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``max_bytes`` of text each, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < n:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + max_bytes, "right")))
            yield batch.slice(at, end - at)
            at = end


def keep_rows(docs: DataFrame, text_col: str, verdict: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, all columns as they are, for whose texts ``verdict`` says true.

    The texts are judged and the rows filtered in one pass, so nothing is
    shuffled and each row is judged by itself, whatever its id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in chunks(batches, text_col):
            yield b.filter(pa.array(verdict(b.column(b.schema.get_field_index(text_col))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + n + 1]
    if buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets.astype(np.int64) - int(offsets[0])


def byte_class(outside: bytes) -> np.ndarray:
    """A table of 256 booleans: is the byte part of a word."""
    table = np.ones(256, bool)
    table[list(outside)] = False
    return table


#: Words are ``[^\x20\x09-\x0D]+``.
SPACED = byte_class(SPACE)
#: Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after lower-casing A-Z.
ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n of them."""
    if len(_powers.get("up", ())) < n:
        inverse = pow(HASH_BASE, -1, 1 << 64)
        for key, base in (("up", HASH_BASE), ("down", inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a piece of a text column.

    ``data``: bytes, lower-cased if asked; ``starts`` and ``ends``: byte
    positions of each word; ``offsets``: for document i, its words are
    ``offsets[i]:offsets[i + 1]``.
    """

    def __init__(self, column: pa.Array, inside: np.ndarray = SPACED, lower: bool = True):
        data, at = text_bytes(column)
        if lower:
            data = np.frombuffer(data.tobytes().translate(LOWER.tobytes()), np.uint8)
        self.data, self.at = data, at
        word = inside[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | cut[1:-1]
        last[:-1] &= ~word[1:] | cut[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.starts, at)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every task."""
        n = len(self.data)
        if n == 0:
            return np.zeros(0, np.uint64)
        up, down = power_tables(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        return mix64((total[self.ends] - total[self.starts]) * down[self.starts])

    def spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words of each document joined by single spaces: bytes, starts and ends."""
        n = len(self.starts)
        length = self.ends - self.starts
        starts = np.zeros(n, np.int64)
        if n:
            np.cumsum(length[:-1] + 1, out=starts[1:])
        out = np.full(int(starts[-1] + length[-1]) if n else 0, 0x20, np.uint8)
        if n:
            word = np.zeros(len(self.data) + 1, np.int8)
            word[self.starts] += 1
            word[self.ends] -= 1
            inside = np.cumsum(word[:-1], dtype=np.int8).astype(bool)
            # the words of two neighbouring documents may touch, with no space in between
            mask = np.ones(len(out), bool)
            mask[starts[1:] - 1] = False
            out[mask] = self.data[inside]
        return out.tobytes(), starts, starts + length


def packed_counts(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of a long array of counts that are not all zero, as rows."""
    rows = [(k, pa.compress(own.tobytes(), codec="zstd", asbytes=True)) for k in range(-(-len(total) // COUNTS)) if (own := total[k * COUNTS : (k + 1) * COUNTS]).any()]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["block", "data"])


def summed_counts(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the arrays of ``size`` counts that tasks have packed: by block and share of the tasks, then by block."""

    def unpack(block: int, data: bytes) -> np.ndarray:
        width = min(COUNTS, size - block * COUNTS)
        return np.frombuffer(pa.decompress(data, 8 * width, codec="zstd", asbytes=True), np.int64)

    def add(p: pd.DataFrame) -> pd.DataFrame:
        block, total = int(p["block"].iloc[0]), 0
        for data in p["data"]:
            total = total + unpack(block, data)
        return pd.DataFrame({"block": [block], "data": [pa.compress(total.tobytes(), codec="zstd", asbytes=True)]})

    shares = parts.withColumn("share", F.spark_partition_id() % 64).groupBy("block", "share").applyInPandas(add, "block int, data binary")
    out = np.zeros(size, np.int64)
    for block, data in shares.groupBy("block").applyInPandas(add, "block int, data binary").collect():
        own = unpack(block, bytes(data))
        out[block * COUNTS : block * COUNTS + len(own)] = own
    return out
