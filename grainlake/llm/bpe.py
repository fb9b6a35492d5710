"""Byte-level BPE: a lazily determinised transducer for encoding, a streaming decoder.

Encoding.  A token may follow another only if the two, written together, encode
to just these two; and a sequence of tokens is the encoding of its bytes exactly
if each neighbouring pair passes that test.  So each prefix of the input has one
last token, and the encoder is a finite-state transducer whose states are pairs
(bytes of a token begun, the token before it).  Subsets of these, each with the
output not yet common to all, are the states of the determinised machine.  They
are made when first reached and kept in a table of bounded size.  Output comes
as soon as all readings agree on it, after a lookahead of a token's length.

Decoding.  Token bytes stream through an incremental UTF-8 decoder, which holds
an unfinished character between the blocks.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, chunks

#: Bounds of the tables that a worker keeps: a full table of pairs or pieces is emptied and filled anew.
MAX_STATES = 30_000
MAX_PAIRS = 200_000
MAX_PIECES = 250_000
#: Outside the table of states, output is emitted once so many tokens are held.
LOOKBACK = 24
#: Longer pieces are not kept in the table of pieces.
PIECE_BYTES = 64
DECODE_BLOCK = 65_536


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines ``base64(token) rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes bytes with the merges that the ranks stand for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        #: The tokens as a trie: ``child[node << 8 | byte]``; per node its token, or -1, and whether it goes on.
        self.child: dict[int, int] = {}
        self.token_at, self.goes_on = [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.goes_on[node] = True
                key = node << 8 | byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.goes_on.append(False)
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        # a state: readings (node begun, token before, its output not yet emitted); the first is the finished one
        start = ((0, -1, ()),)
        self.states, self.number, self.step = [start], {start: 0}, {}

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; a single byte is its own halves."""
        known = self.parts.get(token)
        if known is None:
            ranks, parts = self.ranks, [bytes([x]) for x in self.bytes_of[token]]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], token))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            known = self.parts[token] = (ranks[parts[0]], ranks[parts[-1]])
        return known

    def fits(self, before: int, token: int) -> bool:
        """Do the two, written together, encode to just these two.

        Their merges are undone along the common edge, the latest first; a
        merge across the edge that would have come earlier parts them otherwise.
        """
        if before < 0:
            return True
        key = before << 32 | token
        known = self.pairs.get(key)
        if known is not None:
            return known
        left, right, latest, apart = before, token, 1 << 31, True
        ranks, of = self.ranks, self.bytes_of
        while True:
            if ranks.get(of[left] + of[right], latest) < latest:
                apart = False
                break
            # of two merges of the same rank the left one comes first
            undo_left = left > right and len(of[left]) > 1 or len(of[right]) == 1
            if undo_left:
                if len(of[left]) == 1:
                    break
                latest, left = left, self.halves(left)[1]
            else:
                latest, right = right + 1, self.halves(right)[0]
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[key] = apart
        return apart

    def _read(self, readings, byte: int) -> list[tuple]:
        """The readings after one more byte, the finished one first."""
        child, token_at, goes_on, pairs = self.child, self.token_at, self.goes_on, self.pairs
        done, going = None, [None]
        for node, before, held in readings:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            token = token_at[node]
            if token >= 0 and done is None:
                fits = before < 0 or pairs.get(before << 32 | token)
                if fits or fits is None and self.fits(before, token):
                    done = (0, token, (*held, token))
            if goes_on[node]:
                going.append((node, before, held))
        going[0] = done
        return going

    @staticmethod
    def _emit(readings: list[tuple]) -> tuple[tuple[int, ...], list[tuple]]:
        """What all readings begin with, and the readings without it."""
        out = readings[0][2]
        for _, _, held in readings:
            if held[: len(out)] != out:
                out = out[: next((k for k, (x, y) in enumerate(zip(held, out)) if x != y), len(held))]
            if not out:
                return out, readings
        common = len(out)
        return out, [(n, t, held[common:]) for n, t, held in readings]

    def encode(self, data: bytes) -> list[int]:
        """The ids of the bytes, in time proportional to their number.

        States beyond the table's bound are followed without being kept.
        """
        state, out, step, readings = 0, [], self.step, None
        for byte in data:
            if state >= 0:
                known = step.get(state << 8 | byte)
                if known is None:
                    emitted, readings = self._emit(self._read(self.states[state], byte))
                    key = tuple(readings)
                    to = self.number.get(key, -1)
                    if to < 0 and len(self.states) < MAX_STATES:
                        to = self.number[key] = len(self.states)
                        self.states.append(key)
                    if to >= 0:
                        step[state << 8 | byte] = to, emitted
                    state = to
                else:
                    state, emitted = known
                if emitted:
                    out.extend(emitted)
            else:
                readings = self._read(readings, byte)
                if len(readings[0][2]) > LOOKBACK:
                    emitted, readings = self._emit(readings)
                    out.extend(emitted)
        out.extend((self.states[state] if state >= 0 else readings)[0][2])
        return out


class Encoder:
    """Texts to token ids: each match of the pattern is encoded separately."""

    def __init__(self, path: str, pattern: str):
        self.machine = Transducer(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out, pieces = [], self.pieces
        for piece in self.pattern.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = pack("<%dI" % len(own := self.machine.encode(piece.encode())), *own)
                if len(piece) <= PIECE_BYTES:
                    if len(pieces) >= MAX_PIECES:
                        pieces.clear()
                    pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> Iterator[str]:
        """The text, block by block; bytes that are no UTF-8 become U+FFFD."""
        return stream_decode(self.machine.bytes_of, np.frombuffer(ids, "<u4"))


def stream_decode(bytes_of: list[bytes], ids: np.ndarray) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for at in range(0, len(ids), DECODE_BLOCK):
        yield decoder.decode(b"".join([bytes_of[i] for i in ids[at : at + DECODE_BLOCK].tolist()]))
    yield decoder.decode(b"", final=True)


_encoders: dict[tuple[str, str], Encoder] = {}
KEPT.append(_encoders)


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder; its tables serve all tasks that the worker runs."""
    if (path, pattern) not in _encoders:
        _encoders.clear()
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: the token ids of every text, packed as little-endian unsigned 32-bit integers.

    ``path`` is a rank file that every executor has.  Null and empty texts give
    no ids, repeated rows each keep a row, an empty table gives an empty one.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in chunks(batches, "text"):
            ids = [own.encode(x) if x else b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids binary")


def decode_texts(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(id, ids)`` to ``(id, text)``: the way back; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in chunks(batches, "ids"):
            texts = ["".join(own.decode(x or b"")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, text string")


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of every text, encoded and then decoded from its ids.

    Both ways run in one Python worker a task, so a task holds the tables and
    the batches once.  The decoded text is never held whole.  Nulls, empty
    texts, repeated rows and empty tables count as in ``encode_texts``.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def digests(own: Encoder, text: str | None) -> tuple[int, str, str]:
        ids = own.encode(text) if text else b""
        h = hashlib.sha256()
        for block in own.decode(ids):
            h.update(block.encode())
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), h.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in chunks(batches, "text"):
            n, ids, decoded = zip(*(digests(own, x) for x in b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
