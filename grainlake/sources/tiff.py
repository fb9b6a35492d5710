"""Volumes as folders of TIFF slices: one grey image per slice.

Slices are read by Spark's ``binaryFile`` and take their place in the volume
from the natural order of their names.  Images may be strips of any height, in
either byte order, plain or deflated, of integers or floats.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import natural_key
from ..storage import materialise
from .files import save_files

SUFFIXES = ("tif", "tiff", "TIF", "TIFF")
#: Fixed values of the format: bytes of field types, sample formats and tags.
FIELD = {1: "B", 3: "H", 4: "I"}
FORMATS = {1: "u", 2: "i", 3: "f"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 339
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946


def encode(image: np.ndarray, compress: bool = False) -> bytes:
    """A grey image as one strip of a little-endian file."""
    data = np.ascontiguousarray(image, image.dtype.newbyteorder("<")).tobytes()
    data = zlib.compress(data) if compress else data
    kind = {v: k for k, v in FORMATS.items()}[image.dtype.kind]
    tags = [
        (WIDTH, 4, image.shape[1]), (HEIGHT, 4, image.shape[0]), (BITS, 3, 8 * image.dtype.itemsize), (COMPRESSION, 3, DEFLATE if compress else PLAIN), (PHOTOMETRIC, 3, 1),
        (OFFSETS, 4, 8), (SAMPLES, 3, 1), (STRIP_ROWS, 4, image.shape[0]), (STRIP_BYTES, 4, len(data)), (FORMAT, 3, kind),
    ]
    at = 8 + len(data) + len(data) % 2
    out = struct.pack("<2sHI", b"II", 42, at) + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(tags))
    for tag, field, value in tags:
        out += struct.pack("<HHI", tag, field, 1) + struct.pack("<" + FIELD[field], value).ljust(4, b"\0")
    return out + bytes(4)


def decode(raw: bytes) -> np.ndarray:
    """The first image of a file."""
    e = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if e is None or struct.unpack_from(e + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(e + "I", raw, 4)[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack_from(e + "H", raw, at)[0]):
        tag, field, n = struct.unpack_from(e + "HHI", raw, at + 2 + 12 * k)
        if field in FIELD:
            place = at + 2 + 12 * k + 8
            kind = f"{n}{FIELD[field]}"
            if struct.calcsize(e + kind) > 4:
                place = struct.unpack_from(e + "I", raw, place)[0]
            tags[tag] = struct.unpack_from(e + kind, raw, place)
    first = lambda t, default: tags.get(t, (default,))[0]
    width, height, bits, packed = first(WIDTH, 0), first(HEIGHT, 0), first(BITS, 1), first(COMPRESSION, PLAIN)
    if first(SAMPLES, 1) != 1 or bits % 8 or packed not in (PLAIN, DEFLATE, OLD_DEFLATE) or first(PREDICTOR, 1) != 1 or first(FORMAT, 1) not in FORMATS or OFFSETS not in tags:
        raise ValueError("only plain or deflated grey strips of whole bytes are read")
    data = b"".join(zlib.decompress(raw[o : o + n]) if packed != PLAIN else raw[o : o + n] for o, n in zip(tags[OFFSETS], tags[STRIP_BYTES]))
    kind = np.dtype(f"{e}{FORMATS[first(FORMAT, 1)]}{bits // 8}")
    if len(data) < width * height * kind.itemsize:
        raise ValueError("the strips are shorter than the image")
    return np.frombuffer(data, kind, width * height).reshape(height, width)


def natural_places(names: DataFrame, keys: Sequence[str], name: str = "name") -> DataFrame:
    """``names`` with ``z``, the place of each in the natural order of its group, from 0.

    Only names move: a group is the slices of one volume.
    """
    return names.withColumn("z", (F.row_number().over(Window.partitionBy(*keys).orderBy(natural_key(F.col(name)), name)) - 1).cast("int"))


def load_tiff(spark: SparkSession, path: str) -> DataFrame:
    """``(volume_id, z, y, line)``: the lines of the slices in the folders under ``path``, one volume a folder.

    Names are listed and placed first, as a table of their own; contents are
    read once and stay in the task that decodes them while that table is small
    enough to be broadcast.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    named = files.select("path", F.element_at(parts, -2).alias("volume_id"), F.element_at(parts, -1).alias("name"))
    placed = materialise(natural_places(named, ["volume_id"]).select(F.col("path").alias("of_path"), "volume_id", "z"), "slices")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                image = decode(b.column(2)[k].as_py())
                height, width = image.shape
                lines = pa.ListArray.from_arrays(pa.array(np.arange(height + 1, dtype=np.int32) * width), pa.array(image.astype(np.float64).ravel()))
                same = pa.array(np.full(height, k))
                yield pa.RecordBatch.from_arrays([b.column(0).take(same), b.column(1).take(same), pa.array(np.arange(height), pa.int32()), lines], ["volume_id", "z", "y", "line"])

    contents = files.select("path", "content").join(placed, F.col("path") == F.col("of_path"))
    return contents.select("volume_id", "z", "content").mapInArrow(run, "volume_id string, z int, y int, line array<double>")


def save_tiff(lines: DataFrame, path: str, dtype: str = "float32", compress: bool = False) -> None:
    """Write each volume's slices as ``volume/0.tiff``, ``volume/1.tiff`` and so on.

    A slice is put together in one task; its lines must be as many as the
    highest y says and of one length.
    """
    slices = lines.groupBy("volume_id", "z").agg(F.sort_array(F.collect_list(F.struct("y", "line"))).alias("lines"))
    rows = slices.select(F.concat("volume_id", F.lit("/"), F.col("z").cast("string"), F.lit(".tiff")).alias("name"), F.transform("lines", lambda s: s["line"]).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                image = np.array(b.column(1)[k].as_py(), np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([encode(image.astype(dtype), compress)], pa.binary())], ["name", "content"])

    save_files(rows.mapInArrow(run, "name string, content binary"), path)
