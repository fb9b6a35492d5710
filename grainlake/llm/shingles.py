"""Near-duplicates by SimHash, and by an exact bound on the Jaccard similarity of their word shingles.

Documents are linked in steps, each of which proposes pairs of those that are
not linked yet; each proposed pair is checked by its sets of shingles.

1. SimHash fingerprints a few bits apart are found in trees of vantage points
   (``simhash``).  A radius that holds all pairs of similarity 0.8 leaves such a
   tree nothing to cut, so this links the closest copies, and what it misses is
   left to the bound.
2. In any order of all shingles, two sets of similarity s or more share one
   among the first n - ceil(s n) + 1 shingles of each.  Frequent shingles come
   late in the order; how frequent they are is counted over all sets, by a part
   of their hash, and affects the work only.  Of a shingle's holders, those a
   few fixed steps apart in the order of size are checked first, in proportion
   to their number.
3. Then, in a mixed order of the holders, those of different components, in
   rounds of twice the distance each.  A set that is like one in k of a large
   group of near copies so finds a link after some k comparisons, however large
   the group is.  The last round, once about as few pairs as sets are left, takes
   all distances, so that no pair which shares such a shingle is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import Words, chunks, materialise, packed_counts, release, summed_counts
from .simhash import SEED, fingerprint_links, majority

#: The similarity wanted, as a fraction.
LEAST = (4, 5)
#: Bits of a shingle's hash by which its holders are counted.
COUNTED = 22
#: Prefix shingles wanted in a bucket; pairs compared at a time.
BUCKET, PAIRS = 200_000, 1 << 18
#: Of a shingle's holders in order of size, how far apart those are that are compared at first.
STEPS = (1, 2, 4, 9, 19, 41)
#: Of the same in a mixed order, up to which distance unlinked ones are compared first, and a distance beyond all.
NEAR, FAR = 6, 1 << 40
#: Parts of the hash range that a set's shingles are counted in.
PARTS = 256


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id, key, fp, shingles, counts)``: the distinct shingle hashes of every text, sorted, a hash of them all, and their numbers by part of the hash range.

    Shingles and the fingerprint ``fp`` are those of ``simhash``; a null or empty text has none.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        digest = xxhash.xxh64_intdigest
        for b in chunks(batches, "text"):
            w = Words(b.column(1))
            data, starts, ends = w.spaced()
            view, keys, sets, counts, hashes = memoryview(data), [], [], [], []
            for lo, hi in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist()):
                n = max(1, hi - lo - width + 1) if hi > lo else 0
                last = np.minimum(np.arange(lo, lo + n) + width, hi) - 1
                h = np.fromiter((digest(view[s:e], SEED) for s, e in zip(starts[lo : lo + n].tolist(), ends[last].tolist())), np.uint64, n)
                hashes.append(h)
                sets.append(np.unique(h).view(np.int64))
                keys.append(digest(sets[-1].tobytes(), SEED))
                counts.append(np.bincount(sets[-1].view(np.uint64) >> np.uint64(56), minlength=PARTS).astype(np.int32))
            fp = majority(np.concatenate(hashes), np.r_[0, np.cumsum([len(x) for x in hashes])])
            offsets = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
            numbers = pa.ListArray.from_arrays(pa.array(np.arange(0, PARTS * len(sets) + 1, PARTS, dtype=np.int32)), pa.array(np.concatenate(counts)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(fp.view(np.int64)), lists, numbers], ["id", "key", "fp", "shingles", "counts"])

    return source.mapInArrow(run, f"id {kind}, key long, fp long, shingles array<long>, counts array<int>")


def _holders(sets: DataFrame) -> np.ndarray:
    """How many sets hold shingles with the same first ``COUNTED`` bits, by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTED, np.int64)
        for b in batches:
            h = b.column(0).flatten().to_numpy().view(np.uint64)
            for lo in range(0, len(h), 1 << 20):
                np.add.at(total, h[lo : lo + (1 << 20)] >> np.uint64(64 - COUNTED), 1)
        yield from packed_counts(total)

    total = summed_counts(sets.select("shingles").mapInArrow(run, "block int, data binary"), 1 << COUNTED)
    return np.minimum(total, 2**31 - 1).astype(np.int32)


def _needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of common shingles of similar sets of these sizes."""
    num, den = LEAST
    return -(-num * (a + b) // (num + den))


def _possible(n: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Can the sets be similar, if their first common shingle has these places in them."""
    return np.minimum(n[i] - place[i], n[j] - place[j]) >= _needed(n[i], n[j])


def _prefixes(sets: DataFrame, parts: int, order) -> DataFrame:
    """The first shingles of each set, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den = LEAST
        held = order.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                lists = b.column(1)
                n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                h = lists.flatten().to_numpy()
                if not len(h):
                    continue
                doc = np.repeat(np.arange(len(n)), n)
                by = np.lexsort((h, held[h.view(np.uint64) >> np.uint64(64 - COUNTED)], doc))
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                first = place < (n - -(-num * n // den) + 1)[doc]
                h, doc, place = h[by][first], doc[first], place[first]
                key, part = b.column(0).to_numpy(), h.view(np.uint64) % np.uint64(parts)
                by = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[by], np.arange(parts + 1, dtype=np.uint64))
                rows = []
                for k, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                    if lo < hi:
                        own = by[lo:hi]
                        rows.append((k, *(x.tobytes() for x in (h[own], key[doc[own]], n[doc[own]].astype("<i4"), place[own].astype("<i4")))))
                number, *packed = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["part", "h", "u", "n", "place"])

    return sets.select("key", "shingles").mapInArrow(run, "part int, h binary, u binary, n binary, place binary")


def _neighbours(p: pd.DataFrame) -> pd.DataFrame:
    """Pairs (u, v) of each shingle's holders that are ``STEPS`` apart in the order of size; of shingles of more than two sets also these, v being null."""
    h, u, n, place = (np.frombuffer(b"".join(p[c]), kind) for c, kind in (("h", "<i8"), ("u", "<i8"), ("n", "<i4"), ("place", "<i4")))
    by = np.lexsort((u, n, h))
    by = by[np.r_[True, (h[by][1:] != h[by][:-1]) | (u[by][1:] != u[by][:-1])]]
    h, u, n, place = h[by], u[by], n[by].astype(np.int64), place[by].astype(np.int64)
    ends = []
    for step in STEPS:
        i = np.flatnonzero(h[step:] == h[:-step])
        i = i[_possible(n, place, i, i + step)]
        ends.append(np.stack([np.maximum(u[i], u[i + step]), np.minimum(u[i], u[i + step])], axis=1))
    pairs = np.unique(np.concatenate(ends), axis=0)
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    many = np.repeat(np.diff(np.r_[start, len(h)]) > 2, np.diff(np.r_[start, len(h)]))
    none = pd.array([pd.NA] * int(many.sum()), "Int64")
    of_pairs = pd.DataFrame({"h": 0, "u": pairs[:, 0], "v": pd.array(pairs[:, 1], "Int64"), "n": 0, "place": 0})
    return pd.concat([of_pairs, pd.DataFrame({"h": h[many], "u": u[many], "v": none, "n": n[many], "place": place[many]})])


def _between(first: int, last: int):
    """Pairs of a shingle's sets of different components, ``first`` to ``last - 1`` apart on a circle that mixes components, some at a time.

    A pair's distance on the circle is the same each time, so that calls with
    adjoining bounds find all possible pairs of sets that no link has joined
    before.  Of two sets in different components one at least is outside of the
    shingle's largest component; only such sets look for others, so that the
    work does not grow with the square of that component.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pd.concat(parts)
        p = p.assign(mixed=p["u"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sort_values(["h", "mixed"])
        h, u, root, n, place = (p[c].to_numpy(np.int64) for c in ("h", "u", "root", "n", "place"))
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        length = np.diff(np.r_[start, len(h)])
        group = np.repeat(np.arange(len(start)), length)
        by = np.lexsort((root, group))
        runs = np.flatnonzero(np.r_[True, (group[by][1:] != group[by][:-1]) | (root[by][1:] != root[by][:-1])])
        of_run, members = by[runs], np.diff(np.r_[runs, len(h)])
        most = np.lexsort((members, group[of_run]))
        most = most[np.r_[group[of_run][most][1:] != group[of_run][most][:-1], True]]
        outside = root != root[of_run[most]][group]
        rows = np.flatnonzero(outside)
        count = np.maximum(0, np.minimum(last, length[group[rows]] // 2 + 1) - first)
        rows, count = rows[count > 0], count[count > 0]
        upto, at = np.cumsum(count), 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] - count[at] + PAIRS, "right")))
            own = count[at:end]
            i = np.repeat(rows[at:end], own)
            step = first + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
            begin, size = start[group[i]], length[group[i]]
            ahead, back = begin + (i - begin + step) % size, begin + (i - begin - step) % size
            once = ~outside[back]  # the others have it ahead of them
            i, j = np.r_[i, i[once]], np.r_[ahead, back[once]]
            keep = root[i] != root[j]
            i, j = i[keep], j[keep]
            keep = _possible(n, place, i, j)
            pairs = np.unique(np.stack([np.maximum(u[i], u[j])[keep], np.minimum(u[i], u[j])[keep]], axis=1), axis=0)
            if len(pairs):
                yield pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})
            at = end

    return run


def _both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The pairs with this column of either set as ``a`` and ``b``; only the sets of the pairs move."""
    ends = materialise(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct(), "shingle-ends")
    own = sets.select("key", column).join(ends, "key", "left_semi").groupBy("key").agg(F.first(column).alias(column))
    own = materialise(own, "shingle-sides")
    return pairs.join(own.select(F.col("key").alias("u"), F.col(column).alias("a")), "u").join(own.select(F.col("key").alias("v"), F.col(column).alias("b")), "v")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar.

    Two sets have at most as many shingles in common as the smaller of their
    counts in each part of the hash range allow; the sets themselves are
    compared only where that is enough.
    """
    num, den = LEAST
    add = lambda x, y: x + y
    counted = _both(materialise(pairs, "shingle-candidates"), sets, "counts")
    most = F.aggregate(F.zip_with("a", "b", lambda x, y: F.least(x, y)), F.lit(0), add)
    sizes = F.aggregate("a", F.lit(0), add) + F.aggregate("b", F.lit(0), add)
    possible = materialise(counted.where(most * (num + den) >= sizes * num).select("u", "v"), "shingle-possible")
    common = F.size(F.array_intersect("a", "b"))
    return _both(possible, sets, "shingles").where(common * (num + den) >= (F.size("a") + F.size("b")) * num).select("u", "v")


def simhash_links(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of similar sets whose fingerprints are equal or linked in the trees of vantage points; not every such pair.

    The sets of one fingerprint meet the least of them, and those of linked fingerprints each other.
    """
    marked = materialise(sets.select("key", "fp").distinct(), "shingle-prints")
    least = materialise(marked.groupBy("fp").agg(F.min("key").alias("least")), "shingle-prints")
    linked = fingerprint_links(least.select("fp")).toDF("fp", "other")
    linked = linked.join(least, "fp").select(F.col("least").alias("u"), F.col("other").alias("fp")).join(least, "fp").select("u", F.col("least").alias("v"))
    pairs = marked.join(least, "fp").select(F.col("key").alias("u"), F.col("least").alias("v")).unionByName(linked)
    return _similar(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), sets)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One row per document: ``(id, component_id)``.

    Documents whose sets of ``width``-word shingles have a Jaccard similarity of
    0.8 or more are linked, texts without words among themselves;
    ``component_id`` is the smallest id reachable, the document's own included.
    Null and repeated ids are as in ``near_duplicates``.
    """
    spark = docs.sparkSession
    sets = materialise(shingle_sets(docs, id_col, text_col, width), "shingle-sets")
    total = sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    parts = max(12, total // (5 * BUCKET))
    order = spark.sparkContext.broadcast(_holders(sets))
    found = _prefixes(sets, parts, order).groupBy("part").applyInPandas(_neighbours, "h long, u long, v long, n long, place long")
    found = materialise(found, "shingle-neighbours")
    close = materialise(simhash_links(sets), "shingle-links")
    star = connected_components(close, "shingle-stars").select("u", F.col("v").alias("root"))
    root = lambda c: star.select(F.col("u").alias(c), F.col("root").alias(f"{c}_root"))
    apart = found.where("v is not null").select("u", "v").distinct().join(root("u"), "u", "left").join(root("v"), "v", "left")
    apart = apart.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")
    near = close.unionByName(materialise(_similar(apart, sets), "shingle-links"))
    star = connected_components(near, "shingle-stars")
    held = found.where("v is null").drop("v")
    part = F.pmod("h", F.lit(parts)).alias("part")
    many, most = sets.count(), held.groupBy("h").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    first, last, tried = 1, NEAR + 1, None
    while first <= most // 2:
        rooted = held.join(star.select("u", F.col("v").alias("root")), "u", "left").select("h", "u", "n", "place", F.coalesce("root", "u").alias("root"))
        pairs = rooted.groupBy(part).applyInPandas(_between(first, last), "u long, v long").distinct()
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "shingle-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        star = connected_components(star.unionByName(materialise(_similar(pairs, sets), "shingle-links")), "shingle-stars")
        # about how many pairs are left, if all further distances give as many as these; this bounds the number of rounds only
        left = pairs.count() * (most // 2) // (last - first)
        first, last = last, FAR if left <= many else 2 * last
    star = star.select(F.col("u").alias("key"), F.col("v").alias("root"))
    rooted = sets.groupBy("key").agg(F.min("id").alias("least")).join(star, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return sets.select("id", "key").join(rooted.join(smallest, "root").select("key", "component_id"), "key").select("id", "component_id")
