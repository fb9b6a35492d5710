"""Token ids in Arrow files of fixed-size-list batches.

Documents in ascending order of their id are one stream of ids, cut into
sequences of equal length.  Each task writes the part of the stream that it
holds: ``<name>.arrow`` has a row per sequence (``ids``, and ``mask``, false for
the padding at the part's end), ``<name>.docs.arrow`` a row per document (its
id, where it starts in the part, and its number of ids).  Buffers are not
compressed, so that a reader maps a file and takes any sequence from it without
a copy.  A file's name carries the task attempt, and only files that a finished
task reports count, so a lost executor leaves nothing behind that is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, materialise

SEQUENCE = 2048
ROWS = 64
MAX_WORDS = 1_000_000
WORD_BYTES = 64


#: Runs of these at a word's end are tokenized apart from what is before them.
TRAILING = b".,;:!?#*$%&|"
_ALNUM = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


class WordEncoder:
    """A tokenizer that lower-cases and never reaches across ASCII white space, with a bounded table of words.

    A text with the start of a special token's string is encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {b"": b""}
        self.long: list[bytes] = []

    def _core(self, word: bytes) -> bytes:
        """The word without the symbols at its end, if what is before them still ends in a letter or digit once it is normalised.

        Normalising may turn a last letter into a letter and a mark, which the symbols would then join.
        """
        core = word.rstrip(TRAILING)
        if len(core) == len(word) or not core:
            return word
        if core[-1] < 0x80:
            return core if core[-1:].isalnum() else word
        text = core.decode()
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        return core if text[-1:].isalnum() else word

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Words of letters alone, encoded as one text, which is cut where a word's last token is."""
        coded = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
        ids = np.array(coded[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
        if len(ends) != len(words):
            return self._tokenize(words)
        data = ids.tobytes()
        return [data[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _tokenize(self, texts: list[bytes]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in coded]

    def _learn(self, words: list[bytes]) -> None:
        """Puts words and their parts into the table."""
        cut = [(w, core, w[len(core) :]) for w in words if w[-1] not in _ALNUM for core in (self._core(w),)]
        whole = [w for w in words if w[-1] in _ALNUM]
        whole += {x for _, core, tail in cut for x in (core, tail)}.difference(self.words, whole)
        letters = [x for x in whole if x.isalpha() or not x.isascii() and x.decode().isalpha()]
        others = list(set(whole).difference(letters)) if len(letters) < len(whole) else []
        for group, coder in ((letters, self._together), (others, self._tokenize)):
            for at in range(0, len(group), 4096):
                self.words.update(zip(group[at : at + 4096], coder(group[at : at + 4096])))
        find = self.words.__getitem__
        self.words.update([(w, find(core) + find(tail)) for w, core, tail in cut if tail])
        self.long += [x for x in whole if len(x) > WORD_BYTES]
        self.long += [w for w, _, tail in cut if tail and len(w) > WORD_BYTES]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [None if b"<|" in t else t.translate(_LOWER).split() for t in texts]
        missing = set().union(*(w for w in split if w is not None)).difference(self.words)
        self._learn(list(missing))
        find = self.words.__getitem__
        out = [self._tokenize([t])[0] if w is None else b"".join(map(find, w)) for t, w in zip(texts, split)]
        if len(self.words) > MAX_WORDS:
            self.words = {b"": b""}
        else:
            for word in self.long:
                self.words.pop(word, None)
        self.long.clear()
        return out


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Part:
    """One task's files while they are written."""

    def __init__(self, folder: str, id_type: pa.DataType, kind: pa.DataType):
        context = TaskContext.get()
        self.name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        self.store, path = filesystem(folder)
        self.store.create_dir(path, recursive=True)
        self.kind = kind
        self.sequences = pa.schema([("ids", pa.list_(kind, SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))])
        self.docs = pa.schema([("id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.streams = [self.store.open_output_stream(f"{path}/{self.name}{end}.arrow") for end in ("", ".docs")]
        self.writers = [pa.ipc.new_file(s, schema) for s, schema in zip(self.streams, (self.sequences, self.docs))]
        self.at, self.rest = 0, np.zeros(0, kind.to_pandas_dtype())

    def _write(self, ids: np.ndarray, n: int) -> None:
        """Whole sequences, of whose ids the first n are no padding."""
        rows = len(ids) // SEQUENCE
        for lo in range(0, rows, ROWS):
            hi = min(rows, lo + ROWS)
            own = pa.array(ids[lo * SEQUENCE : hi * SEQUENCE], self.kind)
            mask = pa.array(np.arange(lo * SEQUENCE, hi * SEQUENCE) < n)
            lists = [pa.FixedSizeListArray.from_arrays(x, SEQUENCE) for x in (own, mask)]
            self.writers[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.sequences))

    def add(self, ids: pa.Array, coded: list[bytes]) -> None:
        n = np.array([len(x) // 4 for x in coded], np.int64)
        start = self.at + np.r_[0, np.cumsum(n)][:-1]
        self.writers[1].write_batch(pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array(n)], schema=self.docs))
        self.at += int(n.sum())
        flow = np.concatenate([self.rest, np.frombuffer(b"".join(coded), "<u4").astype(self.rest.dtype)])
        whole = len(flow) // SEQUENCE * SEQUENCE
        self._write(flow[:whole], whole)
        self.rest = flow[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._write(np.r_[self.rest, np.zeros(SEQUENCE - len(self.rest), self.rest.dtype)], len(self.rest))
        for x in (*self.writers, *self.streams):
            x.close()


def write_token_files(
    docs: DataFrame,
    folder: str,
    path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 16,
    partitions: int | None = None,
) -> DataFrame:
    """Encode and write; returns the manifest ``(part, name, n_tokens)`` of the files that count.

    ``part`` ascends with the document ids.  ``path`` is a tokenizer file that
    every executor has and whose words end at ASCII white space; ``width`` is
    the bits of an id in the files.  ``end_id`` follows each document; null and
    empty texts have that id alone.  Null ids come first, repeated ids in order
    of a hash of their text.  Ids too large for ``width`` are an error.  An empty table writes no files and gives an empty manifest.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(n, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    kind = {16: pa.uint16(), 32: pa.uint32()}[width]
    largest = max(end_id, len(word_encoder(path).closes) - 1)
    if largest >= 1 << width:
        raise ValueError(f"ids up to {largest} do not fit {width} bits")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for b in chunks(batches, "text"):
            part = part or _Part(folder, b.column(0).type, kind)
            raw = b.column(1).cast(pa.binary()).to_pylist()
            coded = word_encoder(path).encode([x or b"" for x in raw])
            part.add(b.column(0), [x + end for x in coded])
        if part:
            part.close()
            row = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([part.name]), pa.array([part.at])]
            yield pa.RecordBatch.from_arrays(row, ["part", "name", "n_tokens"])

    manifest = ordered.mapInArrow(run, "part int, name string, n_tokens long")
    return materialise(manifest, "token-manifest")


def read_token_files(manifest: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """``(id, start, n_tokens, ids)`` per document, from the files; ``start`` counts the ids of all documents before.

    ``ids`` are packed as little-endian unsigned 32-bit integers.  An empty
    manifest gives no rows.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row per file, not per document
    placed = manifest.select("name", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    files = manifest.count()
    placed = placed.repartition(max(1, files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        local = isinstance(store, fs.LocalFileSystem)
        for name, base in ((x["name"], x["base"]) for b in batches for x in b.to_pylist()):
            opened = [pa.memory_map(f"{path}/{name}{e}.arrow") if local else store.open_input_file(f"{path}/{name}{e}.arrow") for e in ("", ".docs")]
            sequences, docs = map(pa.ipc.open_file, opened)
            reader = _Sequences(sequences)
            for k in range(docs.num_record_batches):
                b = docs.get_batch(k)
                for lo in range(0, b.num_rows, 256):
                    d = b.slice(lo, 256)
                    start, n = d.column(1).to_numpy(), d.column(2).to_numpy()
                    ids = [reader.take(s, m).astype("<u4").tobytes() for s, m in zip(start.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([d.column(0), pa.array(start + base), d.column(2), pa.array(ids, pa.binary())], ["id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids binary")


class _Sequences:
    """Random access to the ids of one open file; batches are mapped, not copied."""

    def __init__(self, reader: pa.ipc.RecordBatchFileReader):
        self.reader, self.number, self.batch = reader, -1, None
        rows = [reader.get_batch(k).num_rows for k in range(reader.num_record_batches)]
        self.ends = np.cumsum(rows) * SEQUENCE

    def take(self, start: int, n: int) -> np.ndarray:
        out = []
        while n:
            k = int(np.searchsorted(self.ends, start, "right"))
            lo = start - int(self.ends[k - 1] if k else 0)
            if k != self.number:
                self.number, self.batch = k, self.reader.get_batch(k).column(0).flatten().to_numpy()
            got = self.batch[lo : lo + n]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return np.concatenate(out) if len(out) != 1 else out[0]


def crc_of_ids(tokens: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)``: the unsigned CRC-32 of each document's packed ids."""
    return tokens.select("id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

