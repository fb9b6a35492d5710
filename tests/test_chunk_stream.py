"""Chunks from a stream of patches: any order of arrival, restarts, and patches that do not belong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainlake.operators import grid
from grainlake.streaming import chunks

N, C, P, S = (12, 8, 9), (8, 8, 8), (4, 4, 4), (3, 4, 4)


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(4)
    sizes = spark.createDataFrame([(v, *(x for t in zip(N, P, S, C) for x in t)) for v in ("a", "b")], "volume_id string, " + ", ".join(f"{k}_{a} int" for a in "zyx" for k in "npsc"))
    patches = grid.chunked_grid(sizes)
    vox = spark.createDataFrame([(v, z, y, x, float(rng.random())) for v in ("a", "b") for z in range(N[0]) for y in range(N[1]) for x in range(N[2])], "volume_id string, z int, y int, x int, v double")
    scored = grid.extract_patches(vox, patches, block=8).withColumn("probs", F.array(1 - F.col("v"), F.col("v") * (F.col("ord") % 3), F.col("v") * 0.9 * (F.col("lx") - 1)))
    boxes = chunks.chunks_of(patches, sizes)
    packed = chunks.chunk_patches(scored, boxes, patches, 3).toPandas()
    want = sorted(map(tuple, chunks.batch_chunks(scored, patches, boxes, C, P).select("volume_id", "chunk_id", "z", "y", "x", "cls").collect()))
    return packed, chunks.chunk_patches(scored, boxes, patches, 3).schema, want


def run(spark, folder, schema):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    done = chunks.run_available(stream, f"{folder}/out", f"{folder}/checkpoint", C, P, S)
    return sorted(map(tuple, done.select("volume_id", "chunk_id", "z", "y", "x", "cls").collect()))


def test_any_order_and_a_restart(spark, case, tmp_path):
    packed, schema, want = case
    mixed = packed.sample(frac=1.0, random_state=7)
    first, rest = mixed.iloc[: len(mixed) // 2], mixed.iloc[len(mixed) // 2 :]
    spark.createDataFrame(first, schema).repartition(2).write.parquet(f"{tmp_path}/in")
    part = run(spark, tmp_path, schema)
    assert set(part) < set(want)
    assert run(spark, tmp_path, schema) == part
    spark.createDataFrame(rest, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
    assert run(spark, tmp_path, schema) == want


def test_patches_that_do_not_belong(spark, case, tmp_path):
    packed, schema, _ = case
    for k, (change, said) in enumerate(((lambda p: p.assign(z0=p.z0 + 1), "has no patch"), (lambda p: p, "came twice"))):
        folder = tmp_path / str(k)
        spark.createDataFrame(packed, schema).coalesce(1).write.parquet(f"{folder}/in")
        run(spark, folder, schema)
        spark.createDataFrame(change(packed.iloc[:1]), schema).write.mode("append").parquet(f"{folder}/in")
        with pytest.raises(Exception, match=said):
            run(spark, folder, schema)


def test_starts():
    assert chunks.starts(16, 8, 4) == [0, 4, 8] and chunks.starts(8, 4, 3) == [0, 3, 4] and chunks.starts(4, 4, 4) == [0]
