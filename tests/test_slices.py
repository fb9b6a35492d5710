"""TIFF slices, blocks, and files of rows."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainlake.sources import blocks, files, nifti, tiff


def lines_of(spark, arrays):
    return spark.createDataFrame([(k, z, y, [float(v) for v in a[z, y]]) for k, a in arrays.items() for z in range(a.shape[0]) for y in range(a.shape[1])], "volume_id string, z int, y int, line array<double>")


def same(df, arrays):
    return {(r.volume_id, r.z, r.y): r.line for r in df.collect()} == {(k, z, y): a[z, y].tolist() for k, a in arrays.items() for z in range(a.shape[0]) for y in range(a.shape[1])}


@pytest.mark.parametrize("dtype,compress", [("uint8", False), ("int16", True), ("float32", True), ("float64", False), ("uint32", False)])
def test_slices_come_back_in_natural_order(spark, tmp_path, dtype, compress):
    rng = np.random.default_rng(1)
    arrays = {"a": rng.integers(0, 90, (23, 3, 5)), "b.x": rng.integers(0, 90, (1, 4, 2))}
    tiff.save_tiff(lines_of(spark, arrays), str(tmp_path / "t"), dtype, compress)
    assert sorted(p.name for p in (tmp_path / "t" / "a").iterdir() if p.suffix == ".tiff") == sorted(f"{k}.tiff" for k in range(23))
    assert same(tiff.load_tiff(spark, str(tmp_path / "t")), arrays)


def test_files_of_other_writers():
    """Big-endian, several strips, deflated, with a field that is stored outside its entry."""
    a = np.arange(35, dtype=">u2").reshape(7, 5)
    strips = [zlib.compress(a[k : k + 3].tobytes()) for k in (0, 3, 6)]
    data, at = b"".join(strips), np.cumsum([8, *map(len, strips)])
    lists = 8 + len(data)
    raw = struct.pack(">2sHI", b"MM", 42, lists + 24) + data + struct.pack(">3I3I", *at[:3], *map(len, strips))
    tags = [(256, 3, 1, 5), (257, 3, 1, 7), (258, 3, 1, 16), (259, 3, 1, 8), (262, 3, 1, 1), (273, 4, 3, lists), (277, 3, 1, 1), (278, 3, 1, 3), (279, 4, 3, lists + 12)]
    raw += struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, f, n) + (struct.pack(">HH", v, 0) if f == 3 else struct.pack(">I", v)) for t, f, n, v in tags) + bytes(4)
    assert (tiff.decode(raw) == a).all()
    for image in (a.astype("i4"), a.astype("f8") / 7):
        assert (tiff.decode(tiff.encode(image)) == image).all() and tiff.decode(tiff.encode(image, True)).dtype == image.dtype
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.decode(b"GIF89a  ")
    with pytest.raises(ValueError, match="shorter"):
        tiff.decode(tiff.encode(a.astype("u2"))[:-4].replace(struct.pack("<I", 70), struct.pack("<I", 60)))


@pytest.mark.parametrize("edge", [2, 4, 64])
def test_blocks_and_back(spark, tmp_path, edge):
    rng = np.random.default_rng(5)
    arrays = {"a": rng.random((5, 7, 9)), "b": rng.random((4, 1, 3))}
    blocks.save_blocks(lines_of(spark, arrays), str(tmp_path), edge)
    table = spark.read.parquet(str(tmp_path))
    assert same(blocks.blocks_to_lines(table), arrays)
    assert table.where("volume_id = 'a'").count() == np.prod([-(-n // edge) for n in (5, 7, 9)])
    got = {(r.z, r.y, r.x): r.v for r in blocks.box_of_blocks(table.where("volume_id = 'a'"), (1, 2, 3), (4, 7, 8), edge).collect()}
    assert got == {(z, y, x): arrays["a"][z, y, x] for z in range(1, 4) for y in range(2, 7) for x in range(3, 8)}
    missing = blocks.lines_to_blocks(lines_of(spark, arrays).where("not (z = 0 and y = 0)"), 64).where("volume_id = 'a'").first()
    assert missing.data[:9] == [0.0] * 9 and missing.data[9:18] == arrays["a"][0, 1].tolist()


def test_nothing(spark, tmp_path):
    none = lines_of(spark, {"a": np.zeros((1, 1, 1))}).where("false")
    assert blocks.lines_to_blocks(none).count() == 0 and blocks.blocks_to_lines(blocks.lines_to_blocks(none)).count() == 0
    tiff.save_tiff(none, str(tmp_path / "t"))


def test_slices_to_nifti(spark, tmp_path):
    arrays = {"a": np.random.default_rng(3).integers(-9, 9, (12, 2, 3))}
    tiff.save_tiff(lines_of(spark, arrays), str(tmp_path / "t"), "int16")
    sizes = spark.createDataFrame([("a", 12, 2, 3, 1.0, 1.0, 1.0)], "volume_id string, n_z int, n_y int, n_x int, spacing_z double, spacing_y double, spacing_x double")
    nifti.save_nifti(tiff.load_tiff(spark, str(tmp_path / "t")).join(sizes, "volume_id"), str(tmp_path / "n"), dtype="int16")
    assert same(nifti.load_lines(spark, str(tmp_path / "n")), arrays)
    tiff.save_tiff(nifti.load_lines(spark, str(tmp_path / "n")), str(tmp_path / "back"), "int16")
    assert same(tiff.load_tiff(spark, str(tmp_path / "back")), arrays)


def test_files_and_their_listing(spark, tmp_path):
    rows = spark.createDataFrame([("b10.txt", "x"), ("b9.txt", "yy"), ("a.md", ""), ("sub/c.txt", "z")], "name string, content string")
    files.save_files(rows, str(tmp_path))
    files.save_files(rows.where("name = 'b9.txt'").withColumn("content", F.lit("new")), str(tmp_path))
    assert (tmp_path / "b9.txt").read_text() == "new" and (tmp_path / "sub" / "c.txt").read_text() == "z"
    assert [r["name"] for r in files.subfiles(spark, str(tmp_path), "b", ".txt").collect()] == ["b10.txt", "b9.txt"]
    assert [p.rsplit("/", 1)[-1] for p, _ in files.listing(str(tmp_path), (".txt",))] == ["b9.txt", "b10.txt"]
