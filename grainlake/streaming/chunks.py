"""Chunks of patch predictions, finished as soon as their last patch has arrived.

A stream has a row per patch.  The state of a chunk is the patches that have
come so far; with the last one the chunk's weighted sums are taken in the order
of the patches, so that any order of arrival gives the same classes, and the
chunk's voxels leave the stream while its patches leave the state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import overlap
from ..operators.grid import AXES
from ..operators.overlap import gaussian_weight
from ..operators.predict import begins, whole_patches

#: What a stream's rows hold: the patch's place, its chunk's, the volume's sizes, class scores (z, y, x, class) as doubles, and
#: the places in the patch that have scores, null if all have.
PATCH = ["volume_id", "chunk_id", *(f"{a}0" for a in AXES), *(f"o_{a}" for a in AXES), *(f"n_{a}" for a in AXES), "scores", "places"]


def chunk_patches(scored: DataFrame, chunks: DataFrame, patches: DataFrame, classes: int) -> DataFrame:
    """Rows of ``PATCH``: ``scored`` (``volume_id, ord, lz, ly, lx, probs``) packed by patch.

    ``patches`` is a table of ``grid.chunked_grid``, ``chunks`` has ``volume_id,
    chunk_id, o_z, o_y, o_x, n_z, n_y, n_x``.  A patch is put together in one
    task; one without any voxel has a row too, so that its chunk is finished.
    """
    kind = scored.schema["volume_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_patches(batches, 64):
            first = np.flatnonzero(begins(rows))
            cut = np.r_[first, len(rows)].astype(np.int32)
            cells = [pa.ListArray.from_arrays(pa.array(cut), rows.column(c).combine_chunks()) for c in ("lz", "ly", "lx")]
            scores = pa.ListArray.from_arrays(pa.array(cut * np.int32(classes)), rows.column("probs").combine_chunks().flatten())
            own = [rows.column(c).take(pa.array(first)).combine_chunks() for c in ("volume_id", "ord")]
            yield pa.RecordBatch.from_arrays([*own, *cells, scores], ["volume_id", "ord", "lz", "ly", "lx", "scores"])

    ints = ", ".join(f"l{a} array<int>" for a in AXES)
    own = scored.select("volume_id", F.col("ord").cast("long").alias("ord"), *(F.col(f"l{a}").cast("int").alias(f"l{a}") for a in AXES), F.slice("probs", 1, classes).alias("probs"))
    dealt = own.repartition("volume_id", "ord").sortWithinPartitions("volume_id", "ord", *(f"l{a}" for a in AXES))
    packed = dealt.mapInArrow(pack, f"volume_id {kind}, ord long, {ints}, scores array<double>")
    ny, nx = (F.col(f"{a}1") - F.col(f"{a}0") for a in "yx")
    places = F.transform("lz", lambda z, k: ((z * ny + F.get("ly", k)) * nx + F.get("lx", k)).cast("int"))
    whole = F.size("lz") == (F.col("z1") - F.col("z0")) * ny * nx
    none = F.array().cast("array<int>")
    both = patches.join(packed, ["volume_id", "ord"], "left").join(chunks, ["volume_id", "chunk_id"])
    scores = F.coalesce("scores", F.array().cast("array<double>")).alias("scores")
    return both.select(*PATCH[:-2], scores, F.when(~F.coalesce(whole, F.lit(False)), F.coalesce(places, none)).alias("places"))


def starts(n: int, p: int, s: int) -> list[int]:
    """Clamped starts of patches within a chunk."""
    return sorted({*range(0, n - p + 1, s), n - p})


class Chunks(StatefulProcessor):
    """Gathers the patches of a chunk and gives its voxels' classes when all have come; places that no patch has scores for get none.

    A patch whose place the chunk's grid does not have is an error, as is one
    that comes twice, or after its chunk is done.
    """

    def __init__(self, chunk: Sequence[int], patch: Sequence[int], stride: Sequence[int], classes: int):
        self.chunk, self.patch, self.stride, self.classes = tuple(chunk), tuple(patch), tuple(stride), classes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.patches = handle.getMapState("patches", "place long", "scores binary, places binary")
        self.done = handle.getValueState("done", "n int")
        self.expected = [starts(n, p, s) for n, p, s in zip(self.chunk, self.patch, self.stride)]
        at = np.stack(np.meshgrid(*(np.arange(p) for p in self.patch), indexing="ij"))
        far = sum(32.0 * (k - p // 2) ** 2 / (p * p) for k, p in zip(at, self.patch))
        self.weight = np.exp(-far)[..., None]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[int, tuple[bytes, bytes]] = {}
        done, before = self.done.exists(), {k[0] for k in self.patches.keys()}
        for part in rows:
            for r in part.itertuples(index=False):
                local = [int(getattr(r, f"{a}0") - getattr(r, f"o_{a}")) for a in AXES]
                if any(k not in known for k, known in zip(local, self.expected)):
                    raise ValueError(f"chunk {key} has no patch at {local}")
                place = (local[0] * self.chunk[1] + local[1]) * self.chunk[2] + local[2]
                if done or place in before or place in arrived:
                    raise ValueError(f"chunk {key}: the patch at {local} came twice")
                scores = np.asarray(r.scores, np.float64)
                whole = len(scores) == np.prod(self.patch) * self.classes
                arrived[place] = scores.tobytes(), b"" if whole else np.asarray(r.places, np.int32).tobytes()
                corner, sizes = [int(getattr(r, f"o_{a}")) for a in AXES], [int(getattr(r, f"n_{a}")) for a in AXES]
        if not arrived:
            return
        if len(before) + len(arrived) < np.prod([len(e) for e in self.expected]):
            for place, value in arrived.items():
                self.patches.updateValue((place,), value)
            return
        held = arrived | ({k[0]: tuple(map(bytes, v)) for k, v in self.patches.iterator()} if before else {})
        sums, seen = np.zeros((*self.chunk, self.classes)), np.zeros(self.chunk, bool)
        for place in sorted(held):
            box = tuple(slice(k, k + p) for k, p in zip(np.unravel_index(place, self.chunk), self.patch))
            scores, n = np.frombuffer(held[place][0]).reshape(-1, self.classes), int(np.prod(self.patch))
            at = np.frombuffer(held[place][1], np.int32) if len(scores) < n else np.arange(n)
            own, has = np.zeros((n, self.classes)), np.zeros(n, bool)
            own[at], has[at] = scores, True
            sums[box] += self.weight * own.reshape(*self.patch, self.classes)
            seen[box] |= has.reshape(self.patch)
        if before:
            self.patches.clear()
        self.done.update((len(held),))
        # half a patch is cut off at faces inside the volume; rounding as in the batch form
        cut = [(p // 2 if o > 0 else 0, c - (p // 2 if o + c < n else 0)) for p, c, o, n in zip(self.patch, self.chunk, corner, sizes)]
        box = tuple(slice(*c) for c in cut)
        classes = np.round(sums[box], 9).argmax(axis=-1)
        at = np.stack(np.meshgrid(*(np.arange(*c) + o for c, o in zip(cut, corner)), indexing="ij"))[:, seen[box]]
        yield pd.DataFrame({"volume_id": key[0], "chunk_id": key[1], "z": at[0], "y": at[1], "x": at[2], "cls": classes[seen[box]]})

    def close(self) -> None:
        pass


def finished_chunks(stream: DataFrame, chunk: Sequence[int], patch: Sequence[int], stride: Sequence[int], classes: int = 3) -> DataFrame:
    """``(volume_id, chunk_id, z, y, x, cls)`` of the chunks of a stream of ``PATCH`` rows that are complete.

    The session must use the RocksDB state store.  One mark stays behind for a
    finished chunk, so that a late patch does not begin it anew.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in ("volume_id", "chunk_id")}
    return stream.groupBy("volume_id", "chunk_id").transformWithStateInPandas(
        statefulProcessor=Chunks(chunk, patch, stride, classes),
        outputStructType=f"volume_id {kinds['volume_id']}, chunk_id {kinds['chunk_id']}, z int, y int, x int, cls int",
        outputMode="Append",
        timeMode="None",
    )


def chunks_of(patches: DataFrame, shapes: DataFrame) -> DataFrame:
    """``(volume_id, chunk_id, o_z, o_y, o_x, n_z, n_y, n_x)``: the chunks of a chunked grid and where they begin."""
    corners = patches.groupBy("volume_id", "chunk_id").agg(*(F.min(f"{a}0").alias(f"o_{a}") for a in AXES))
    return corners.join(shapes.select("volume_id", *(f"n_{a}" for a in AXES)), "volume_id")


def batch_chunks(scored: DataFrame, patches: DataFrame, chunks: DataFrame, chunk: Sequence[int], patch: Sequence[int], classes: int = 3) -> DataFrame:
    """The same classes by grouping, of a table that is complete."""
    own = scored.join(patches.select("volume_id", "ord", "chunk_id"), ["volume_id", "ord"])
    keys = ["volume_id", "chunk_id", *AXES]
    sums = overlap.class_sums(own, classes, keys, gaussian_weight(patch)).withColumn("sums", F.transform("sums", lambda s: F.round(s, 9)))
    boxes = chunks.select("volume_id", "chunk_id", *(F.col(f"o_{a}") for a in AXES), *(F.col(f"n_{a}") for a in AXES))
    df = overlap.classify(sums).join(boxes, ["volume_id", "chunk_id"])
    for a, c, p in zip(AXES, chunk, patch):
        low = F.col(f"o_{a}") + F.when(F.col(f"o_{a}") > 0, p // 2).otherwise(0)
        high = F.col(f"o_{a}") + c - F.when(F.col(f"o_{a}") + c < F.col(f"n_{a}"), p // 2).otherwise(0)
        df = df.where((F.col(a) >= low) & (F.col(a) < high))
    return df.select(*keys, "cls")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, path: str, checkpoint: str, chunk: Sequence[int], patch: Sequence[int], stride: Sequence[int], classes: int = 3) -> DataFrame:
    """Take in what the stream has now, add the chunks that are complete to the Parquet folder ``path``, and read that.

    Called again with the same ``checkpoint`` it goes on where it stopped, with
    the patches of open chunks as they were.
    """
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        done = finished_chunks(stream, chunk, patch, stride, classes)
        done.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(done.schema).parquet(path)
