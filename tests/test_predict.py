"""Patches by arithmetic, and a model over patches against the same by hand."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainlake.operators import grid, predict
from grainlake.operators.grid import AXES
from grainlake.plans import segment
from grainlake.queries import stencil


def sizes_row(spark, rows):
    return spark.createDataFrame([(v, *(x for t in zip(n, p, s) for x in t)) for v, n, p, s in rows], "volume_id string, " + ", ".join(f"{k}_{a} int" for a in AXES for k in "nps"))


def volume(spark, arrays):
    return spark.createDataFrame([(name, *map(int, at), float(a[tuple(at)])) for name, a in arrays.items() for at in np.argwhere(np.ones(a.shape))], "volume_id string, z int, y int, x int, v double")


@pytest.mark.parametrize("mode", ["basic", "clamped"])
def test_grid_patches_equal_the_join(spark, mode):
    rng = np.random.default_rng(3)
    arrays = {"a": rng.random((9, 8, 7)), "b": rng.random((5, 5, 12))}
    sizes = sizes_row(spark, [("a", (9, 8, 7), (4, 3, 7), (3, 2, 1)), ("b", (5, 5, 12), (5, 2, 5), (5, 1, 4))])
    vox = volume(spark, arrays)
    got = grid.grid_patches(vox, sizes, mode)
    want = grid.extract_patches(vox, grid.patch_grid(sizes, mode), block=4)
    names = want.columns
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, want.collect()))
    assert got.where(" or ".join(f"{a} <> {a}0 + l{a}" for a in AXES)).count() == 0


def by_hand(patch, axes, folds=(0, 1)):
    total = []
    for fold, flip in product(folds, product((0, 1), repeat=len(axes))):
        own = [a for a, f in zip(axes, flip) if f]
        raw = stencil(fold)(np.flip(patch, own)[None])[0]
        e = np.exp(raw - raw.max(axis=0))
        total.append(np.flip(e / e.sum(axis=0), [a + 1 for a in own]))
    return np.mean(total, axis=0)


@pytest.mark.parametrize("axes,batch", [((0, 1, 2), 6), ((0,), 2), ((), 100)])
def test_predictions_equal_those_by_hand(spark, axes, batch):
    rng = np.random.default_rng(8)
    arrays = {"a": rng.normal(size=(6, 5, 7)), "b": rng.normal(size=(4, 4, 4))}
    sizes = sizes_row(spark, [(k, a.shape, (4, 4, 4), (2, 3, 2)) for k, a in arrays.items()])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    weights = rng.random((4, 4, 4)) if batch == 2 else None
    got = predict.predict_patches(grid.grid_patches(volume(spark, arrays), sizes), (4, 4, 4), predict.PatchModel("stencil", stencil), 0.5, 2.0, axes, weights, batch).toPandas()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 64 * grid.patch_grid(sizes).count()
    for (name, _), rows in got.groupby(["volume_id", "ord"]):
        z, y, x = (int((rows[a] - rows[f"l{a}"]).iloc[0]) for a in AXES)
        want = by_hand((arrays[name][z : z + 4, y : y + 4, x : x + 4] - 0.5) / 2.0, axes) * (1 if weights is None else weights)
        for r in rows.itertuples():
            assert np.allclose(r.probs, want[:, r.lz, r.ly, r.lx], atol=1e-12)


def test_model_equals_the_column_form(spark):
    """A network of single voxels gives the class map of its Column form."""
    vox = volume(spark, {"v": np.random.default_rng(1).normal(size=(10, 9, 8))})

    def load(fold):
        def network(p):
            border, core = 1 / (1 + np.exp(-4 * (p - 1.2))), 1 / (1 + np.exp(-4 * (p - 2.0)))
            return np.log(np.stack([1 - border, border * core, border * (1 - core)], axis=1))

        return network if fold == 3 else None

    model = predict.PatchModel("logistic", load)
    got, want = (segment.class_map(vox, (10, 9, 8), 0.0, 0.5, p, 4, 2).orderBy(*AXES).collect() for p in (model, segment.logistic_classes))
    assert got == want and len({r.cls for r in got}) == 3


def test_model_without_folds(spark):
    with pytest.raises(ValueError, match="none of the folds"):
        predict.networks(predict.PatchModel("missing", lambda fold: None))


def test_models_are_loaded_once():
    loads = []
    model = predict.PatchModel("counted", lambda fold: loads.append(fold) or stencil(0), (0, 1))
    assert predict.networks(model) is predict.networks(model) and loads == [0, 1]


def test_no_patches(spark):
    vox = volume(spark, {"v": np.ones((4, 4, 4))}).where("false")
    none = predict.predict_patches(grid.grid_patches(vox, sizes_row(spark, [("v", (4, 4, 4), (2, 2, 2), (2, 2, 2))])), (2, 2, 2), predict.PatchModel("stencil", stencil))
    assert none.count() == 0 and none.where(F.size("probs") != 3).count() == 0


def resized(a, target):
    """Blurred where it shrinks, then linear between half-pixel centres, an axis after the other and a line at a time."""
    for axis, m in enumerate(target):
        n, out = a.shape[axis], []
        lines = np.moveaxis(a, axis, 0)
        sigma = max(0.0, (n / m - 1) / 2)
        reach = int(4 * sigma + 0.5)
        g = {k: np.exp(-k * k / (2 * sigma * sigma)) if sigma else 1.0 for k in range(-reach, reach + 1)}
        take = lambda i: lines[min(max(i, 0), n - 1)]
        blurred = lambda i: sum(g[k] * take(i + k) for k in g) / sum(g.values())
        for d in range(m):
            at = min(max((d + 0.5) * n / m - 0.5, 0), n - 1)
            low = int(at)
            out.append((1 - (at - low)) * blurred(low) + (at - low) * blurred(min(low + 1, n - 1)))
        a = np.moveaxis(np.array(out), 0, axis)
    return a


@pytest.mark.parametrize("target", [(2, 6, 4), (8, 3, 1)])
def test_resized_patches(spark, target):
    rng = np.random.default_rng(2)
    arrays = {"a": rng.normal(size=(6, 7, 4)), "b": rng.normal(size=(4, 6, 4))}
    sizes = sizes_row(spark, [(k, a.shape, (4, 6, 4), (2, 3, 2)) for k, a in arrays.items()])
    patches = grid.grid_patches(volume(spark, arrays), sizes)
    corner = {(r.volume_id, r.ord): (r.z0, r.y0, r.x0) for r in patches.select("volume_id", "ord", "z0", "y0", "x0").distinct().collect()}
    got = predict.resize_patches(patches, (4, 6, 4), target, batch=2).toPandas()
    assert len(got) == len(corner) * np.prod(target)
    for (name, k), rows in got.groupby(["volume_id", "ord"]):
        z, y, x = corner[name, k]
        want = resized(arrays[name][z : z + 4, y : y + 6, x : x + 4], target)
        assert np.allclose(rows.v, want[rows.lz, rows.ly, rows.lx], atol=1e-12)


def test_chunked_pairs_must_match(spark):
    sizes = sizes_row(spark, [("v", (12, 8, 8), (4, 4, 4), (4, 4, 4))]).select("*", *(F.lit(8).alias(f"c_{a}") for a in AXES))
    half = sizes.select("volume_id", *((F.col(f"{k}_{a}") / 2).cast("int").alias(f"{k}_{a}") for a in AXES for k in "npsc"))
    pairs = grid.paired_grids(grid.chunked_grid(sizes), grid.chunked_grid(half))
    assert pairs.count() == 2 * 8 and pairs.where("2 * t_z0 <> z0 or chunk_id is null").count() == 0
    with pytest.raises(Exception, match="different numbers"):
        grid.paired_grids(grid.chunked_grid(sizes), grid.chunked_grid(half.withColumn("s_x", F.lit(1)))).collect()
