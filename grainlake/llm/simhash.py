"""SimHash near-duplicates, linked through vantage-point trees.

Fingerprints are points of the 64-bit Hamming space.  A tree of vantage points,
fitted on a bounded sample, cuts that space into shards: a fingerprint closer
to the vantage point than the node's radius goes inside, any other outside.
By the triangle inequality two fingerprints at distance r or less lie on
different sides only if the inner one is within r of the radius, so inner
fingerprints of that shell are also sent outside, where each of their links is
then found.  A shard is searched the same way, by trees of its own, down to
blocks that are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, merge_labels
from .common import Words, chunks, materialise

SEED = 42
#: The largest number of fingerprints that the routing tree is fitted on, and of its leaves.
SAMPLE = 32768
MAX_LEAVES = 4096
#: Fingerprints wanted in a shard, and in a block that is compared exactly.
SHARD = 2048
BLOCK = 512


def majority(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SimHash of each run ``begin[i]:begin[i + 1]`` of the hashes: bits set in over half of them, zero for an empty run."""
    n_hash = np.diff(begin)
    out = np.zeros(len(n_hash), np.uint64)
    full = np.flatnonzero(n_hash)
    if len(full):
        ones = np.empty((len(full), 64), np.int64)
        for part in range(0, len(full), 256):
            at = full[part : part + 256]
            lo, hi = begin[at[0]], begin[at[-1] + 1]
            bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[part : part + 256] = np.add.reduceat(bits, begin[at] - lo, axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > n_hash[full, None], axis=1, bitorder="little")
        out[full] = packed.view("<u8").ravel()
    return out


def _fingerprints(column: pa.Array, width: int) -> np.ndarray:
    """SimHash of each text of the column, as unsigned 64-bit integers."""
    w = Words(column)
    data, starts, ends = w.spaced()
    n_words = np.diff(w.offsets)
    n_hash = np.where(n_words == 0, 0, np.maximum(1, n_words - width + 1))
    begin = np.zeros(len(n_hash) + 1, np.int64)
    np.cumsum(n_hash, out=begin[1:])
    doc = np.repeat(np.arange(len(n_hash)), n_hash)
    first = np.arange(begin[-1]) - begin[doc] + w.offsets[doc]
    last = np.minimum(first + width, w.offsets[doc + 1]) - 1
    view, digest = memoryview(data), xxhash.xxh64_intdigest
    h = np.fromiter((digest(view[s:e], SEED) for s, e in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, len(first))
    return majority(h, begin)


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)``: the 64-bit SimHash of every text, its bits held in a long.

    Shingles are ``width`` words of the lower-cased (A-Z) text joined by
    spaces, repeats included; a text of fewer words is one shingle.  A null or
    empty text has fingerprint zero.  Other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            fp = _fingerprints(b.column(1), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, fp long")


def _distance(a: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ v).astype(np.int16)


class VantageTree:
    """A routing tree: per node the vantage point, the radius and two children; leaves are numbered."""

    def __init__(self, sample: np.ndarray, n_total: int, radius: int, shard: int = SHARD):
        self.radius, self.nodes, self.leaves = radius, [], 0
        want = min(MAX_LEAVES, max(1, n_total // shard))
        self.least = max(2, len(sample) // want)
        self.rng = np.random.default_rng(7)
        self.root = self._build(sample, 0)
        del self.rng

    def _build(self, s: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        cut = _split(s, self.radius, self.rng) if len(s) > self.least and depth < 24 and self.leaves < MAX_LEAVES else None
        if cut is None:
            self.nodes[at] = (self.leaves,)
            self.leaves += 1
        else:
            v, mu, d = cut
            self.nodes[at] = (v, mu, self._build(s[d < mu], depth + 1), self._build(s[d >= mu], depth + 1))
        return at

    def route(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``fp`` and the leaves they go to; a position may have several leaves."""
        rows, leaf, todo = [], [], [(self.root, np.arange(len(fp)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if len(self.nodes[node]) == 1:
                rows.append(at)
                leaf.append(np.full(len(at), self.nodes[node][0], np.int64))
                continue
            v, mu, inner, outer = self.nodes[node]
            d = _distance(fp[at], v)
            todo.append((inner, at[d < mu]))
            todo.append((outer, at[d >= mu - self.radius]))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(leaf)


def _split(s: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int, np.ndarray] | None:
    """Of a few vantage points and radii near the median, those that duplicate least; None if none splits."""
    best = None
    for v in rng.choice(s, min(5, len(s)), replace=False):
        d = _distance(s, v)
        for mu in {int(np.quantile(d, q)) for q in (0.35, 0.45, 0.5, 0.55, 0.65)}:
            n_in, n_out = int((d < mu).sum()), int((d >= mu - radius).sum())
            if 0 < n_in and n_out < len(s) and (best is None or max(n_in, n_out) < best[0]):
                best = (max(n_in, n_out), v, mu, d)
    return best[1:] if best and best[0] <= 0.9 * len(s) else None


def _links(fp: np.ndarray, radius: int, rng: np.random.Generator, at: np.ndarray, out: list) -> None:
    """Append pairs of positions of linked fingerprints; a block links to its first members, so pairs stay few."""
    cut = _split(fp[at], radius, rng) if len(at) > BLOCK else None
    if cut is not None:
        _, mu, d = cut
        _links(fp, radius, rng, at[d < mu], out)
        _links(fp, radius, rng, at[d >= mu - radius], out)
        return
    label = np.arange(len(at))
    x = fp[at]
    for lo in range(0, len(at), BLOCK):
        i, j = np.nonzero(np.bitwise_count(x[lo : lo + BLOCK, None] ^ x[None, :]) <= radius)
        i += lo
        keep = i > j
        label = merge_labels(label, i[keep], j[keep])
    linked = np.flatnonzero(label != np.arange(len(at)))
    out.append((at[linked], at[label[linked]]))


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """``(u, v)``: links that connect the distinct fingerprints ``fp`` exactly as Hamming distance <= radius does.

    The links keep the components, not every pair.  A fingerprint without a
    link gets no row; null fingerprints are left out; an empty table gives none.
    """
    n = fps.count()
    bounded = fps.where("fp is not null").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"]
    tree = VantageTree(bounded.to_numpy(np.int64).view(np.uint64), n, radius)

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            fp = p["fp"].to_numpy(np.int64)
            rows, leaf = tree.route(fp.view(np.uint64))
            yield pd.DataFrame({"leaf": leaf, "fp": fp[rows]})

    def link(p: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(p["fp"].to_numpy(np.int64))
        pairs: list = []
        _links(fp.view(np.uint64), radius, np.random.default_rng(7), np.arange(len(fp)), pairs)
        u = np.concatenate([a for a, _ in pairs]) if pairs else np.zeros(0, np.int64)
        v = np.concatenate([b for _, b in pairs]) if pairs else np.zeros(0, np.int64)
        return pd.DataFrame({"u": fp[u], "v": fp[v]})

    shards = fps.where("fp is not null").mapInPandas(route, "leaf long, fp long")
    return shards.groupBy("leaf").applyInPandas(link, "u long, v long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2
) -> DataFrame:
    """One row per document: ``(id, fp, component_id)``.

    Documents whose fingerprints differ in ``radius`` bits or fewer are linked,
    and ``component_id`` is the smallest id reachable, the document's own
    included.  Rows that repeat an id each keep a row; null ids are never the
    smallest, and a component of null ids only has a null ``component_id``.
    An empty table gives an empty result.
    """
    marked = materialise(simhash(docs, id_col, text_col, width), "simhash")
    reps = materialise(marked.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    star = connected_components(fingerprint_links(reps.select("fp"), radius), "fingerprint-links")
    rooted = reps.join(star, reps.fp == star.u, "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("id", "fp", "component_id")
