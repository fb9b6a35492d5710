"""Benchmark decontamination over a distributed positional inverted index.

The corpus is indexed in blocks of documents.  For each block and term, of all
terms, the index stores the term's positions in the block, delta-coded; the
documents of a block lie one after the other with one free position between
them, so that no phrase reaches from one into the next.  Test windows meet the
blocks by joining their rarest term (over the whole corpus) with the postings.
Inside a block the positions of that term propose starts, and the lists of the
window's other terms, shifted by their offsets, are intersected in order of
rarity.  Nothing of the test set or the index passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, chunks, materialise, release

WINDOW = 13
#: Words in an index block, test windows looked at together, and places proposed together.
BLOCK_WORDS = 1 << 21
PIECE = 20_000
CANDIDATES = 1 << 21

INDEX_SCHEMA = "block long, id {id}, first int, n_words int, term long, n long, positions binary"


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(item, terms)``: each item's windows of ``width`` consecutive words, as word hashes.

    An item of fewer words, but not none, is one window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            w = Words(b.column(1), ALNUM)
            h = w.hashes()
            n = np.diff(w.offsets)
            windows = np.where(n > 0, np.maximum(1, n - width + 1), 0)
            item = np.repeat(np.arange(len(n)), windows)
            first = w.offsets[item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
            size = np.minimum(width, n[item])
            at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            terms = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(h[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(item)), terms], ["item", "terms"])

    source = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "item string, terms array<long>")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of ``docs``, written to the shared folder; it serves any test set.

    A row with a null term describes a document: its first position in the
    block and its number of words (null or empty text: none).  Other rows are
    postings: a term, how often it comes in the block, and where.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = ["block", "id", "first", "n_words", "term", "n", "positions"]

    def block_rows(block: int, ids: list, firsts: list, counts: list, places: list, terms: list) -> pa.RecordBatch:
        place, term = np.concatenate(places), np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        place, term = place[order], term[order]
        at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        step = np.diff(place, prepend=0)
        step[at] = place[at]
        ends = np.r_[at[1:], len(term)].astype(np.int64) if len(at) else at
        ids = pa.concat_arrays(ids)
        n, m = len(ids), len(at)
        data = step.astype("<i4").tobytes()
        starts = np.r_[np.zeros(n + 1, np.int32), (4 * ends).astype(np.int32)]
        missing = np.r_[np.zeros(n, bool), np.ones(m, bool)]
        packed = pa.Array.from_buffers(pa.binary(), n + m, [pa.py_buffer(np.packbits(missing, bitorder="little").tobytes()), pa.py_buffer(starts.tobytes()), pa.py_buffer(data)])
        nulls = lambda k, t: pa.nulls(k, t)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + m, block)),
                pa.concat_arrays([ids, nulls(m, ids.type)]),
                pa.concat_arrays([pa.array(np.concatenate(firsts), pa.int32()), nulls(m, pa.int32())]),
                pa.concat_arrays([pa.array(np.concatenate(counts), pa.int32()), nulls(m, pa.int32())]),
                pa.concat_arrays([nulls(n, pa.int64()), pa.array(term[at].view(np.int64))]),
                pa.concat_arrays([nulls(n, pa.int64()), pa.array((ends - at).astype(np.int64))]),
                packed,
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        block, size = TaskContext.get().partitionId() << 24, 0
        state: tuple[list, ...] = ([], [], [], [], [])
        for b in chunks(batches, "text"):
            w = Words(b.column(1), ALNUM)
            n_words = np.diff(w.offsets)
            shift = size + np.arange(len(n_words))
            doc = np.repeat(np.arange(len(n_words)), n_words)
            places = np.arange(len(doc)) + shift[doc]
            for into, new in zip(state, (b.column(0), w.offsets[:-1] + shift, n_words, places.astype(np.int32), w.hashes())):
                into.append(new)
            size += len(doc) + len(n_words)
            if size >= BLOCK_WORDS:
                yield block_rows(block, *state)
                block, size, state = block + 1, 0, ([], [], [], [], [])
        if state[0]:
            yield block_rows(block, *state)

    return materialise(source.mapInArrow(run, INDEX_SCHEMA.format(id=kind)), "positional-index")


def ranked_windows(index: DataFrame, items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(items, ranked)``: each distinct test window, the items that have it, and its terms in order of rarity.

    ``ranked`` holds ``(often, offset, term)``; ``often`` counts the term in the
    whole corpus and is 0 for a term that it has nowhere.
    """
    windows = item_windows(items, id_col, text_col, width).groupBy("terms").agg(F.sort_array(F.collect_set("item")).alias("items"))
    windows = materialise(windows, "test-windows")
    terms = windows.select("terms", "items", F.posexplode("terms").alias("offset", "term"))
    often = index.where("term is not null").select("term", "n").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("often"))
    ranked = F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).cast("long").alias("often"), "offset", "term"))).alias("ranked")
    rated = terms.join(often, "term", "left").groupBy("terms").agg(F.first("items").alias("items"), ranked)
    return materialise(rated.select("items", "ranked"), "ranked-windows")


def _met(index: DataFrame, ranked: DataFrame, proposing: Column, twice: bool):
    """The rows of each block that bear on the test, beside the windows that one of their ``proposing`` terms brings there."""
    test_terms = ranked.select(F.explode("ranked.term").alias("term")).distinct()
    docs, postings = index.where("term is null"), index.where("term is not null")
    rows = docs.unionByName(postings.join(test_terms, "term", "left_semi").select(*index.columns))
    brought = ranked.select("items", "ranked", F.explode(proposing).alias("by")).select("items", "ranked", F.col("by.term").alias("term"))
    windows = brought.join(postings.select(F.col("block").alias("in_block"), "term"), "term").select("in_block", "items", "ranked")
    if twice:
        windows = windows.groupBy("in_block", "ranked").agg(F.first("items").alias("items")).select("in_block", "items", "ranked")
    return rows.groupBy("block").cogroup(windows.groupBy("in_block"))


class Phrases:
    """Some test windows, their terms in order of rarity."""

    def __init__(self, windows: pa.Table):
        ranked = windows.column("ranked").combine_chunks()
        self.items = windows.column("items").to_pylist()
        self.length = np.diff(ranked.offsets.to_numpy()).astype(np.int32)
        rows = ranked.flatten()
        width = int(self.length.max())
        # rows shorter than the longest repeat their rarest term
        column = np.arange(width)[None, :]
        begin = np.cumsum(self.length) - self.length
        at = begin[:, None] + np.where(column < self.length[:, None], column, 0)
        self.terms = rows.field("term").to_numpy().view(np.uint64)[at]
        self.offset = rows.field("offset").to_numpy()[at].astype(np.int32)

    def find(self, known: np.ndarray, lists: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and window numbers of all occurrences in a block of ``size`` positions."""
        own = np.searchsorted(known, self.terms)
        own = np.where((own < len(known)) & (known[np.minimum(own, len(known) - 1)] == self.terms), own, -1)
        live = np.flatnonzero((own >= 0).all(axis=1))
        if not len(live):
            return
        at_place = np.full(size, -1, np.int32)
        for k in np.unique(own[live]):
            at_place[lists[k]] = k
        lengths = np.array([len(x) for x in lists])
        live = live[np.argsort(own[live, 0], kind="stable")]
        total = np.cumsum(lengths[own[live, 0]])
        lo = 0
        while lo < len(live):
            base = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, base + CANDIDATES, "right")))
            some = live[lo:hi]
            window = np.repeat(some, lengths[own[some, 0]])
            start = np.concatenate([lists[k] for k in own[some, 0]]) - self.offset[window, 0]
            ok = (start >= 0) & (start + self.length[window] <= size)
            window, start = window[ok], start[ok]
            for r in range(1, self.terms.shape[1]):
                ok = at_place[start + self.offset[window, r]] == own[window, r]
                window, start = window[ok], start[ok]
            if len(start):
                yield start, window
            lo = hi


    def find_near(self, known: np.ndarray, lists: list[np.ndarray], first: np.ndarray, n_words: np.ndarray, slack: int, missing: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Documents, window numbers and terms in order of the proximity matches in a block.

        One of a window's ``missing`` + 1 rarest terms comes in each of its matches, and proposes it.
        """
        place = np.searchsorted(known, self.terms)
        own = np.where((place < len(known)) & (known[np.minimum(place, len(known) - 1)] == self.terms), place, -1)
        at_place = np.full(int(first[-1] + n_words[-1]), -1, np.int32)
        for k in np.unique(own[own >= 0]):
            at_place[lists[k]] = k
        for window, n in enumerate(self.length.tolist()):
            absent, reach = min(missing, n // 6), n + slack
            if (own[window, :n] < 0).sum() > absent:
                continue
            terms = np.empty(n, np.int32)
            terms[self.offset[window, :n]] = own[window, :n]
            anchors = [lists[k] for k in np.unique(own[window, : absent + 1]) if k >= 0]
            anchor = np.unique(np.concatenate(anchors))
            for lo in range(0, len(anchor), CANDIDATES // 64):
                p = anchor[lo : lo + CANDIDATES // 64]
                doc = np.searchsorted(first, p, "right") - 1
                around = p[:, None] + np.arange(1 - reach, reach)
                inside = (around >= first[doc, None]) & (around < (first + n_words)[doc, None])
                words = np.where(inside, at_place[np.clip(around, 0, len(at_place) - 1)], -1)
                some = np.flatnonzero((np.isin(words, terms) & (words >= 0)).sum(axis=1) >= n - absent)
                most = np.zeros(len(some), np.int64)
                for a in range(reach):
                    most = np.maximum(most, _in_order(words[some, a : a + reach], terms))
                found = most >= n - absent
                if found.any():
                    yield doc[some[found]], np.full(int(found.sum()), window), most[found]


def _in_order(words: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Of each row of words, how many of the terms come in it in order."""
    best = np.zeros((len(words), len(terms) + 1), np.int64)
    for k in range(words.shape[1]):
        same = (words[:, k, None] == terms[None, :]) & (terms >= 0)
        longer = np.maximum(best[:, 1:], np.where(same, best[:, :-1] + 1, 0))
        best[:, 1:] = np.maximum.accumulate(longer, axis=1)
    return best[:, -1]


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
) -> DataFrame:
    """One row per document: ``(id, n_words, n_hit, items)``.

    ``n_hit`` counts the document's words inside any occurrence of a test
    window, ``items`` lists (as sorted strings) the items that have one.  Words
    are runs of ASCII letters and digits, lower-cased, and of any characters
    beyond ASCII; they are compared by a 64-bit hash.  Null and empty texts have
    no words and hit nothing; windows of items with a null id are hit but name
    no item; repeated items count once, repeated documents each keep a row; an empty table on
    either side gives rows without hits, or no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    index = build_index(docs, id_col, text_col)
    ranked = ranked_windows(index, items, item_col, item_text_col, width)
    found = ranked.where(F.col("ranked")[0]["often"] > 0)

    def search(rows: pa.Table, windows: pa.Table) -> pa.Table:
        of_docs, first, n_words, known, lists = _block(rows)
        size = int(first[-1] + n_words[-1])
        names: list[set] = [set() for _ in range(len(first))]
        edge = np.zeros(size + 1, np.int32)
        for lo in range(0, windows.num_rows, PIECE):
            phrases = Phrases(windows.slice(lo, PIECE))
            for start, window in phrases.find(known, lists, size):
                np.add.at(edge, start, 1)
                np.add.at(edge, start + phrases.length[window], -1)
                doc = np.searchsorted(first, start, "right") - 1
                for d, x in set(zip(doc.tolist(), window.tolist())):
                    names[d].update(phrases.items[x])
        covered = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
        hit = covered[first + n_words] - covered[first]
        return pa.table(
            {
                "id": of_docs.column("id"),
                "n_words": pa.array(n_words.astype(np.int64)),
                "n_hit": pa.array(hit.astype(np.int64)),
                "items": pa.array([sorted(x) for x in names], pa.list_(pa.string())),
            }
        )

    rarest = F.slice("ranked", 1, 1)
    return _met(index, found, rarest, False).applyInArrow(search, f"id {kind}, n_words long, n_hit long, items array<string>")


def proximity(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    slack: int = 3,
    missing: int = 2,
) -> DataFrame:
    """One row per document row and item with a proximity match: ``(id, item, n_terms, n_found)``.

    A test window of n terms matches where at most ``missing`` of them, and at
    most n / 6, are left out or changed, and the others come in the window's
    order within n + ``slack`` consecutive words of a document.  Exact
    occurrences match as well.  The row has the item's window with the fewest
    terms missing.  Otherwise as ``contamination``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    index = build_index(docs, id_col, text_col)
    ranked = ranked_windows(index, items, item_col, item_text_col, width)

    def search(rows: pa.Table, windows: pa.Table) -> pa.Table:
        of_docs, first, n_words, known, lists = _block(rows)
        best: dict = {}
        for lo in range(0, windows.num_rows, PIECE):
            phrases = Phrases(windows.slice(lo, PIECE))
            for doc, window, n in phrases.find_near(known, lists, first, n_words, slack, missing):
                for d, w, m in set(zip(doc.tolist(), window.tolist(), n.tolist())):
                    size = int(phrases.length[w])
                    for item in phrases.items[w]:
                        best[d, item] = max(best.get((d, item), (-size, 0, 0)), (m - size, m, size))
        at = sorted(best)
        return pa.table(
            {
                "id": of_docs.column("id").take(pa.array([d for d, _ in at], pa.int64())),
                "item": pa.array([item for _, item in at], pa.string()),
                "n_terms": pa.array([best[k][2] for k in at], pa.int64()),
                "n_found": pa.array([best[k][1] for k in at], pa.int64()),
            }
        )

    # of a window's (missing + 1) rarest terms one is in each of its matches
    proposing = F.slice("ranked", F.lit(1), F.lit(missing + 1))
    return _met(index, ranked, proposing, True).applyInArrow(search, f"id {kind}, item string, n_terms long, n_found long")


def _block(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """A block's documents in order, where they begin, their words, and its terms with their positions."""
    posting = pc.is_valid(rows.column("term"))
    of_docs, of_terms = rows.filter(pc.invert(posting)), rows.filter(posting)
    of_docs = of_docs.take(pa.array(np.argsort(of_docs.column("first").to_numpy(), kind="stable")))
    known = of_terms.column("term").to_numpy().view(np.uint64)
    by = np.argsort(known)
    data = of_terms.column("positions").to_pylist()
    return of_docs, of_docs.column("first").to_numpy(), of_docs.column("n_words").to_numpy(), known[by], [np.cumsum(np.frombuffer(data[k], "<i4")) for k in by]


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """The rule: some hit, and a twentieth of the words or more."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
