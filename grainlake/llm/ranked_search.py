"""Ranked lexical search by presence masks.

The corpus is indexed in blocks of documents: for each block and term, of all
terms, the documents that hold it and how often.  A search brings each term of
the test items to the blocks that hold it, by a join.  Within a block every term
has a bitmap of the documents; an item's bitmaps, turned, give each document
the mask of the terms it holds, and documents are grouped by mask.  A mask's
maximum score is that of a document with the block's best part for each of its
terms.  Distinct masks are evaluated by descending maximum until the block's
k-th best score strictly exceeds the next one, so that no document that could be
among an item's best is left unscored; equal scores are still looked at, since
ties go by id.  Each block gives an item's k best, and Spark ranks those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, Words, chunks, materialise

#: A block ends at so many words or documents.
BLOCK_WORDS, BLOCK_DOCS = 1 << 21, 1 << 15
#: Items that one task sees together, documents scored at first, and term bitmaps made at a time.
ITEMS, FIRST, BITMAPS = 2048, 64, 512

INDEX_SCHEMA = "block long, id {id}, n long, term long, df long, docs binary, tfs binary"


def _pairs(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, document) pairs in order, and how often each comes."""
    order = np.lexsort((doc, term))
    doc, term = doc[order], term[order]
    at = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]) if len(term) else np.zeros(0, np.int64)
    return term[at], doc[at], np.diff(at, append=len(term))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``docs``, written to the shared folder; it serves any test set.

    A row with a null term describes a document, by its place in the block: its
    id and its number of terms ``n`` with repeats (null or empty text: none).
    Other rows are postings: a term (by a 64-bit hash), how many of the block's
    documents hold it, their places (delta-coded) and how often each has it.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = ["block", "id", "n", "term", "df", "docs", "tfs"]

    def block_rows(block: int, ids: list, counts: list, pairs: list) -> pa.RecordBatch:
        term, doc, tf = (np.concatenate(x) for x in zip(*pairs))
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        ends = np.r_[at[1:], len(term)].astype(np.int64) if len(at) else at
        step = np.diff(doc, prepend=0)
        step[at] = doc[at]
        ids = pa.concat_arrays(ids)
        n, m = len(ids), len(at)
        missing = pa.py_buffer(np.packbits(np.r_[np.zeros(n, bool), np.ones(m, bool)], bitorder="little").tobytes())
        offsets = pa.py_buffer(np.r_[np.zeros(n + 1, np.int32), (4 * ends).astype(np.int32)].tobytes())
        packed = [pa.Array.from_buffers(pa.binary(), n + m, [missing, offsets, pa.py_buffer(v.astype("<i4").tobytes())]) for v in (step, tf)]
        absent = lambda k: pa.nulls(k, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + m, block)),
                pa.concat_arrays([ids, pa.nulls(m, ids.type)]),
                pa.concat_arrays([pa.array(np.concatenate(counts).astype(np.int64)), absent(m)]),
                pa.concat_arrays([absent(n), pa.array(term[at].view(np.int64))]),
                pa.concat_arrays([absent(n), pa.array(ends - at)]),
                *packed,
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, size = TaskContext.get().partitionId() << 24, 0, 0
        state: tuple[list, ...] = ([], [], [])
        for b in chunks(batches, "text"):
            w = Words(b.column(1), ALNUM)
            n = np.diff(w.offsets)
            pairs = _pairs(np.repeat(np.arange(size, size + len(n)), n), w.hashes())
            for into, new in zip(state, (b.column(0), n, pairs)):
                into.append(new)
            words, size = words + int(n.sum()), size + len(n)
            if words >= BLOCK_WORDS or size >= BLOCK_DOCS:
                yield block_rows(block, *state)
                block, words, size, state = block + 1, 0, 0, ([], [], [])
        if state[0]:
            yield block_rows(block, *state)

    return materialise(source.mapInArrow(run, INDEX_SCHEMA.format(id=kind)), "search-index")


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, term)``: the distinct terms of each item, as hashes; rows of one id are one item."""
    source = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    kind = source.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            w = Words(b.column(1), ALNUM)
            term, row, _ = _pairs(np.repeat(np.arange(b.num_rows), np.diff(w.offsets)), w.hashes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(term.view(np.int64))], ["item", "term"])

    return source.mapInArrow(run, f"item {kind}, term long").distinct()


class Block:
    """A block's documents and those of its postings that a search needs, with each posting's part of a score."""

    def __init__(self, rows: pa.Table, n_docs: int, n_terms: int):
        own = rows.filter(pc.is_null(rows.column("term"))).combine_chunks()
        self.ids, self.size = own.column("id"), own.num_rows
        n = own.column("n").to_numpy()
        # 100 - 90 + the document's length relative to the mean, in hundredths
        m = 100 - 90 + (90 * n * n_docs) // max(n_terms, 1)
        postings = rows.filter(pc.is_valid(rows.column("term"))).sort_by("term").combine_chunks()
        self.terms = postings.column("term").to_numpy()
        count = postings.column("df").to_numpy()
        self.firsts = np.cumsum(count) - count
        step, tf = (np.frombuffer(b"".join(postings.column(c).to_pylist()), "<i4").astype(np.int64) for c in ("docs", "tfs"))
        total = np.cumsum(step)
        base = np.where(self.firsts > 0, total[self.firsts - 1], 0) if len(total) else self.firsts
        doc = total - np.repeat(base, count)
        self.key = np.repeat(np.arange(len(count)), count) * self.size + doc
        self.part = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        self.most = np.maximum.reduceat(self.part, self.firsts) if len(count) else self.part
        self.uses = postings.column("uses").combine_chunks()
        self.bitmaps = np.zeros((len(count), (self.size + 7) // 8), np.uint8)
        for lo in range(0, len(count), BITMAPS):
            hi = min(lo + BITMAPS, len(count))
            bits = np.zeros((hi - lo, self.size), bool)
            some = slice(self.firsts[lo], self.firsts[hi] if hi < len(count) else None)
            bits.ravel()[self.key[some] - lo * self.size] = True
            self.bitmaps[lo:hi] = np.packbits(bits, axis=1)

    def best(self, terms: np.ndarray, weight: np.ndarray, by_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best documents with a score above 0, the best first, equal ones by id."""
        member = np.unpackbits(self.bitmaps[terms], axis=1, count=self.size)
        held = np.flatnonzero(member.any(axis=0))
        member = member[:, held]
        masks = np.packbits(member, axis=0).T
        masks = np.ascontiguousarray(np.pad(masks, ((0, 0), (0, -masks.shape[1] % 8)))).view(np.uint64)
        if masks.shape[1] == 1:
            _, one, group = np.unique(masks[:, 0], return_index=True, return_inverse=True)
        else:
            order = np.lexsort(masks.T)
            new = np.r_[True, (masks[order[1:]] != masks[order[:-1]]).any(axis=1)]
            group = np.empty(len(held), np.int64)
            group[order] = np.cumsum(new) - 1
            one = order[new]
        most = (weight * self.most[terms]).astype(np.float64) @ member[:, one]
        masks_by_most = np.argsort(-most, kind="stable")
        place = np.empty(len(most), np.int64)
        place[masks_by_most] = np.arange(len(most))
        order = np.argsort(place[group], kind="stable")
        ends = np.cumsum(np.bincount(place[group]))
        most = most[masks_by_most]
        doc, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        mask = lo = 0
        want = FIRST
        while mask < len(most) and most[mask] > 0 and not (len(score) >= k and score[k - 1] > most[mask]):
            mask = min(int(np.searchsorted(ends, lo + want)) + 1, len(most))
            some = order[lo : ends[mask - 1]]
            lo, want = int(ends[mask - 1]), 2 * want
            t, d = np.nonzero(member[:, some])
            part = self.part[np.searchsorted(self.key, terms[t] * self.size + held[some[d]])]
            got = np.zeros(len(some), np.int64)
            np.add.at(got, d, weight[t] * part)
            doc, score = np.r_[doc, held[some[got > 0]]], np.r_[score, got[got > 0]]
            top = np.lexsort((by_id[doc], -score))[:k]
            doc, score = doc[top], score[top]
        return doc, score


def search(index: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, rank, id, score)``: each item's ``k`` best documents with a score above 0, equal scores by id, null ids last.

    A term of weight ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` adds ``w``
    times ``(10**9 tf) div (1000 tf + 8 m)`` to the score of a document that has
    it ``tf`` times, ``m`` being ``10 + (90 n N) div L``.  Items with a null or
    empty text, or no term in the corpus, have no rows; nor have any if there
    are no documents.  Items of one id (null ids too) are one item; documents
    of one id are documents each.  Integers are 64 bits wide: a document of over
    ``10**17 / N`` terms would not fit.

    Terms meet postings by a join; only two numbers reach the driver.  A task
    sees one block and up to about ``ITEMS`` items at a time.
    """
    of_docs, postings = index.where("term is null"), index.where("term is not null")
    n_docs, n_terms = (int(v or 0) for v in of_docs.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first())
    terms = materialise(item_terms(items, item_id, text_col), "item-terms")
    pieces = max(1, -(-terms.select("item").distinct().count() // ITEMS))
    piece = F.pmod(F.xxhash64("item"), F.lit(pieces)).cast("int")
    needed = materialise(terms.select("term").distinct(), "search-terms")
    met = postings.join(needed, "term", "left_semi").select(*index.columns)
    often = met.groupBy("term").agg(F.sum("df").alias("often"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("often") + 1).cast("double")))
    rated = terms.join(often, "term").select("item", "term", piece.alias("piece"), weight.cast("long").alias("w")).where("w > 0")
    uses = rated.groupBy("term", "piece").agg(F.first("w").alias("w"), F.collect_list(F.struct("item")).alias("uses"))
    uses = materialise(uses, "search-weights")
    rows = met.join(uses, "term").select("block", "piece", "id", "n", "term", "df", "docs", "tfs", "w", "uses")
    every = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece")
    lengths = of_docs.select("block", every, "id", "n", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("term", "df", "docs", "tfs", "w", "uses")))
    kinds = {c: f.dataType.simpleString() for c, f in (("id", index.schema["id"]), ("item", terms.schema["item"]))}

    def run(table: pa.Table) -> pa.Table:
        block = Block(table, n_docs, n_terms)
        users = block.uses.flatten().field("item").dictionary_encode("encode")
        term = np.repeat(np.arange(len(block.uses)), np.diff(block.uses.offsets.to_numpy()))
        code = users.indices.to_numpy()
        weights = pc.drop_null(table.sort_by("term").column("w")).to_numpy()
        by_id = np.empty(block.size, np.int64)
        by_id[pc.sort_indices(block.ids, null_placement="at_end").to_numpy()] = np.arange(block.size)
        order = np.argsort(code, kind="stable")
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else ():
            doc, score = block.best(term[own], weights[term[own]], by_id, k)
            out.append((np.full(len(doc), code[own[0]]), doc, score))
        item, doc, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        ids = block.ids.take(pa.array(doc))
        return pa.table([users.dictionary.take(pa.array(item)), ids, pa.array(score)], ["item", "id", "score"])

    found = lengths.unionByName(rows).groupBy("block", "piece").applyInArrow(run, f"item {kinds['item']}, id {kinds['id']}, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item", "rank", "id", "score")
