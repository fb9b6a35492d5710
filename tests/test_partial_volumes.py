"""Queries against their SQL where the volume's last layer of cubes is not full, and patches that lack voxels."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from grainlake import queries as Q
from grainlake.operators import grid, predict
from grainlake.streaming import chunks

from test_queries import rows

VECTORS = "/root/testdata/sf0.001/embeddings.parquet"


@pytest.fixture(scope="module")
def partial(spark, tmp_path_factory):
    """A folder with 456 vectors: the last of five layers has 56 of 100 cubes, its last row six of ten."""
    folder = str(tmp_path_factory.mktemp("partial"))
    spark.read.parquet(VECTORS).where("vec_id < 456").write.parquet(f"{folder}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return folder, duck


@pytest.mark.parametrize("name", ["chunk_stream", "chunk_resized", "tiff_slices", "predict_patches", "predict_slices"])
def test_last_layer_is_not_full(spark, partial, name):
    folder, duck = partial
    got, want = rows(Q.QUERIES[name](spark, folder).toPandas()), rows(duck.sql(Q.SQL[name]).df())
    assert len(got[1]) == len(want[1])
    assert got == want


def test_even_grids_by_arithmetic(spark):
    """Patches of an even grid that voxels find by themselves are those that a join finds."""
    shapes = [("a", 9, 4, 2.0), ("b", 4, 4, 3.0), ("c", 13, 5, 2.5), ("d", 6, 1, 1.0), ("e", 3, 4, 2.0)]
    sizes = spark.createDataFrame([(v, n, p, s, 1, 1, 1.0, 1, 1, 1.0) for v, n, p, s in shapes], "volume_id string, " + ", ".join(f"n_{a} int, p_{a} int, s_{a} double" for a in "zyx"))
    vox = spark.createDataFrame([(v, z, 0, 0, float(z)) for v, n, *_ in shapes for z in range(n)], "volume_id string, z int, y int, x int, v double")
    columns = ["volume_id", "ord", "z", "lz", "ly", "lx", "v"]
    want = grid.extract_patches(vox, grid.patch_grid(sizes, "even"), block=4).select(columns)
    got = grid.grid_patches(vox, sizes, "even").select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_folds_and_flips_that_look_at_no_voxel(spark):
    """Of a network that looks one voxel ahead, only what has a voxel there counts."""

    def ahead(fold):
        return (lambda p: np.stack([np.zeros_like(p), np.concatenate([p[..., 1:], p[..., -1:]], axis=3)], axis=1)) if fold == 0 else None

    vox = spark.createDataFrame([("a", 0, 0, 0, 0, x, float(x)) for x in (0, 1, 3)], "volume_id string, ord long, z int, y int, lz int, lx int, v double")
    pv = vox.withColumn("x", F.col("lx")).withColumn("ly", F.lit(0)).withColumn("ord", F.col("ord").cast("long"))
    out = predict.predict_patches(pv, (1, 1, 5), predict.PatchModel("ahead", ahead, classes=2), axes=(2,), covered=True).collect()
    got = {r.x: (round(r.probs[1], 9), r.share) for r in out}
    p = lambda v: round(float(1 / (1 + np.exp(-v))), 9)
    # 0 looks at 1, and turned at itself; 1 looks at nothing, and turned at 0; 3 has no neighbour
    assert got == {0: (round((p(1.0) + p(0.0)) / 2, 9), 1.0), 1: (p(0.0), 0.5)}


def test_a_patch_without_voxels_is_sent(spark):
    sizes = spark.createDataFrame([("a", *(8, 4, 4, 8) * 3)], "volume_id string, " + ", ".join(f"{k}_{a} int" for a in "zyx" for k in "npsc"))
    patches = grid.chunked_grid(sizes)
    vox = spark.createDataFrame([("a", 0, 1, 2, 0.5)], "volume_id string, z int, y int, x int, v double")
    scored = grid.extract_patches(vox, patches, block=4).withColumn("probs", F.array(F.col("v"), F.col("v"), F.col("v")))
    packed = chunks.chunk_patches(scored, chunks.chunks_of(patches, sizes), patches, 3).collect()
    assert len(packed) == 8
    assert sorted((r.scores, r.places) for r in packed) == [([], [])] * 7 + [([0.5] * 3, [6])]
