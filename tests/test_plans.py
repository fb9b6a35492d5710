"""Padding by all modes, tiles against whole slices, metadata and manifests."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainlake.functions import scalars as S
from grainlake.operators import grid, overlap, predict
from grainlake.operators.grid import AXES
from grainlake.plans import tiled
from grainlake.queries import layered
from grainlake.sources import files, metadata


def volume(spark, arrays):
    return spark.createDataFrame([(name, *map(int, at), float(a[tuple(at)])) for name, a in arrays.items() for at in np.argwhere(np.ones(a.shape))], "volume_id string, z int, y int, x int, v double")


def shapes_of(spark, arrays):
    return spark.createDataFrame([(k, *a.shape) for k, a in arrays.items()], "volume_id string, n_z int, n_y int, n_x int")


def arrays_of(df):
    out = {}
    for name, rows in df.toPandas().groupby("volume_id"):
        a = np.full(tuple(rows[list("zyx")].max() + 1), np.nan)
        a[rows.z, rows.y, rows.x] = rows.v
        out[name] = a
    return out


@pytest.mark.parametrize("mode", ["constant", "edge", "reflect", "symmetric", "wrap"])
def test_padding_and_back(spark, mode):
    rng = np.random.default_rng(6)
    arrays = {"a": rng.random((3, 7, 5)), "b": rng.random((1, 9, 2))}
    vox, shapes = volume(spark, arrays), shapes_of(spark, arrays)
    padded = grid.pad(vox, shapes, (10, 8, 5), (1, 3, 4), mode=mode)
    got = arrays_of(padded)
    for k, a in arrays.items():
        want = [-(-max(n, least) // m) * m for n, least, m in zip(a.shape, (10, 8, 5), (1, 3, 4))]
        width = [((w - n) // 2, w - n - (w - n) // 2) for w, n in zip(want, a.shape)]
        assert np.array_equal(got[k], np.pad(a, width, mode))
    assert padded.count() == sum(a.size for a in got.values())
    back = arrays_of(grid.unpad(padded, grid.pad_bounds(shapes, (10, 8, 5), (1, 3, 4))))
    assert all(np.array_equal(back[k], a) for k, a in arrays.items())


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="unknown mode"):
        grid.pad(volume(spark, {"a": np.ones((1, 1, 1))}), shapes_of(spark, {"a": np.ones((1, 1, 1))}), (2, 2, 2), mode="mean")


@pytest.mark.parametrize("tile,step", [((1, 4, 6), 0.5), ((1, 9, 20), 1.0)])
def test_tiles_equal_whole_slices(spark, tile, step):
    rng = np.random.default_rng(7)
    arrays = {"a": rng.normal(size=(4, 9, 11)), "b": rng.normal(size=(1, 3, 7))}
    got = tiled.predict_tiled(volume(spark, arrays), shapes_of(spark, arrays), predict.PatchModel("layered", layered), tile, step, axes=(1, 2), extra_slices=1).collect()
    assert len(got) == sum(a.size for a in arrays.values())
    want = {}
    for k, a in arrays.items():
        layers = np.pad(a, ((1, 1), (0, 0), (0, 0)))
        want[k] = predict.softmax(layered(0)(np.stack([layers[:-2], a, layers[2:]])[None]))[0]
    for r in got:
        assert np.allclose(r.probs, want[r.volume_id][:, r.z, r.y, r.x], atol=1e-9) and r.cls == np.argmax(want[r.volume_id][:, r.z, r.y, r.x])


def test_whole_volume_in_one_tile(spark):
    a = np.random.default_rng(8).normal(size=(5, 4, 6))
    from grainlake.queries import stencil

    got = tiled.predict_tiled(volume(spark, {"a": a}), shapes_of(spark, {"a": a}), predict.PatchModel("stencil", stencil), a.shape).collect()
    want = predict.probabilities(predict.PatchModel("stencil", stencil), a[None])[0]
    assert all(np.allclose(r.probs, want[:, r.z, r.y, r.x], atol=1e-9) for r in got) and len(got) == a.size


def test_metadata(spark, tmp_path):
    meta = spark.createDataFrame([("a", 0.1, 6.0), ("b", 0.5, 2.0)], "volume_id string, spacing double, particle_size double")
    files.save_files(metadata.metadata_files(meta, F.lit("metadata.json")), str(tmp_path))
    assert json.loads((tmp_path / "metadata.json").read_text()) == {"a": {"spacing": 0.1, "particle_size": 6.0}, "b": {"spacing": 0.5, "particle_size": 2.0}}
    back = metadata.read_metadata(spark, str(tmp_path / "metadata.json"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, meta.collect()))
    volumes = spark.createDataFrame([("a",), ("b",), ("c",)], "volume_id string")
    with pytest.raises(Exception, match="no metadata for volume c"):
        metadata.with_metadata(volumes, back).write.format("noop").mode("overwrite").save()
    chosen = metadata.select_names(volumes, ["b"])
    assert [tuple(r) for r in metadata.with_metadata(chosen, back).collect()] == [("b", 0.5, 2.0)] and metadata.select_names(volumes, None).count() == 3
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(Exception, match="(?i)malformed"):
        metadata.read_metadata(spark, str(tmp_path / "bad.json")).collect()


def test_spacing(spark):
    line = spark.createDataFrame([("a", 100.0, 50.0, 25.0)], "volume_id string, spacing_z double, spacing_y double, spacing_x double")
    assert tuple(metadata.change_spacing(line, micron2mm=True).first())[1:] == (0.1, 0.05, 0.025)
    assert tuple(metadata.change_spacing(line, (1, 2, 3), True).first())[1:] == (1.0, 2.0, 3.0)
    with pytest.raises(ValueError, match="must be given"):
        metadata.change_spacing(line)


def test_manifest(spark, tmp_path):
    names = spark.createDataFrame([("x_10_0000.nii.gz",), ("x_2_0000.nii.gz",), ("x_2_0000.nii.gz",)], "name string")
    train = metadata.identifiers(names)
    metadata.save_manifest(metadata.manifest(train, train.where("false"), "Task 1", ["CT", "MR"], {0: "background", 1: "core"}, release="1"), str(tmp_path))
    got = json.loads((tmp_path / "dataset.json").read_text())
    assert got["training"] == [{"image": f"./imagesTr/{k}.nii.gz", "label": f"./labelsTr/{k}.nii.gz"} for k in ("x_10", "x_2")]
    assert got["numTraining"] == 2 and got["numTest"] == 0 and got["test"] == [] and got["modality"] == {"0": "CT", "1": "MR"} and got["labels"]["1"] == "core" and got["release"] == "1"
    assert list(got) == sorted(got)


def test_scalars(spark):
    rows = spark.createDataFrame([(float("nan"),), (None,), (2.5,)], "v double").select(S.nan_to_zero(F.col("v")).alias("v"), S.features_per_level(32, 4).alias("f"))
    assert [(r.v, r.f) for r in rows.collect()] == [(0.0, [32, 64, 128, 256]), (0.0, [32, 64, 128, 256]), (2.5, [32, 64, 128, 256])]


def test_region_thresholds_on_sums(spark):
    """Thresholds hold for weighted sums as they are, or divided by the weights; the last region wins."""
    rows = [("v", 0, 0, x, p) for x, probs in enumerate((([0.6, 0.2, 0.1], [0.6, 0.2, 0.1]), ([0.2, 0.3, 0.9], [0.1, 0.3, 0.3]), ([0.1, 0.1, 0.1], [0.2, 0.2, 0.2]))) for p in probs]
    sums = overlap.class_sums(spark.createDataFrame(rows, "volume_id string, z int, y int, x int, probs array<double>"), 3, weight=F.lit(2.0))
    assert {r.x: r.total for r in sums.collect()} == {0: 4.0, 1: 4.0, 2: 4.0}
    by = lambda **o: {r.x: r.cls for r in overlap.classify(sums, (2, 3, 1), **o).collect()}
    assert by() == {0: 2, 1: 1, 2: 0} and by(normalise=False) == {0: 3, 1: 1, 2: 1}
    assert {r.x: r.cls for r in overlap.classify(sums).collect()} == {0: 0, 1: 2, 2: 0}
    assert len(AXES) == 3
