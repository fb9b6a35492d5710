"""Patch grids, patches of voxels, padding and cropping.

A volume is a table ``(volume_id, z, y, x, v)``.  A grid is made from a table of
sizes: ``volume_id`` and, for each axis a in z, y, x, ``n_a`` (its length),
``p_a`` (the patch's) and ``s_a`` (the stride).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def starts(n: Column, p: Column, s: Column, mode: str = "clamped") -> Column:
    """Patch starts along one axis.

    ``basic``: 0, s, 2s, ... while the patch fits.  ``clamped``: also n - p.
    ``adaptive``: 0, s, 2s, ... below n; the last patches are cut off.
    ``even``: as few as cover the axis with steps of at most s, evenly spread.
    """
    if mode == "basic":
        return F.sequence(F.lit(0).cast("int"), (n - p).cast("int"), s.cast("int"))
    if mode == "clamped":
        return F.array_distinct(F.concat(starts(n, p, s, "basic"), F.array((n - p).cast("int"))))
    if mode == "adaptive":
        return F.sequence(F.lit(0).cast("int"), (n - 1).cast("int"), s.cast("int"))
    if mode == "even":
        k = (F.ceil((n - p) / s) + 1).cast("int")
        step = F.when(k > 1, (n - p) / (k - 1)).otherwise(F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.rint(i * step).cast("int"))
    raise ValueError(f"unknown mode {mode}")


def check_sizes(sizes: DataFrame) -> DataFrame:
    """The sizes, or an error at run time: a patch must fit its volume, a stride its patch."""
    bad = reduce(lambda a, b: a | b, [(F.col(f"p_{a}") > F.col(f"n_{a}")) | (F.col(f"s_{a}") > F.col(f"p_{a}")) | (F.col(f"s_{a}") < 1) for a in AXES])
    fine = F.assert_true(~bad, F.lit("a patch is larger than its volume, or a stride than its patch"))
    return sizes.where(fine.isNull())


def patch_grid(sizes: DataFrame, mode: str = "clamped") -> DataFrame:
    """``(volume_id, ord, z0, z1, y0, y1, x0, x1)``: patches in C order, stops exclusive."""
    df = sizes
    for a in AXES:
        df = df.withColumn(f"starts_{a}", starts(F.col(f"n_{a}"), F.col(f"p_{a}"), F.col(f"s_{a}"), mode)).withColumn(f"k_{a}", F.size(f"starts_{a}"))
    for a in AXES:
        df = df.select("*", F.posexplode(f"starts_{a}").alias(f"i_{a}", f"{a}0"))
    order = (F.col("i_z").cast("long") * F.col("k_y") + F.col("i_y")) * F.col("k_x") + F.col("i_x")
    stops = [F.least(F.col(f"{a}0") + F.col(f"p_{a}"), F.col(f"n_{a}")).cast("int").alias(f"{a}1") for a in AXES]
    return df.select("volume_id", order.alias("ord"), *(c for a, stop in zip(AXES, stops) for c in (f"{a}0", stop)))


def chunked_grid(sizes: DataFrame) -> DataFrame:
    """Clamped patches within clamped chunks (``c_a`` long, overlapping by a patch), numbered chunk by chunk.

    ``(volume_id, ord, chunk_id, z0, ..., x1)``.  A chunk must be a multiple of its patch.
    """
    odd = reduce(lambda a, b: a | b, [F.col(f"c_{a}") % F.col(f"p_{a}") != 0 for a in AXES])
    sizes = sizes.where(F.assert_true(~odd, F.lit("a chunk is no multiple of its patch")).isNull())
    outer = sizes.select("volume_id", *(F.col(f"n_{a}") for a in AXES), *(F.col(f"c_{a}").alias(f"p_{a}") for a in AXES), *((F.col(f"c_{a}") - F.col(f"p_{a}")).alias(f"s_{a}") for a in AXES))
    chunks = patch_grid(outer).select("volume_id", F.col("ord").alias("chunk_id"), *(F.col(f"{a}0").alias(f"o_{a}") for a in AXES))
    df = chunks.join(sizes, "volume_id")
    for a in AXES:
        df = df.withColumn(f"starts_{a}", starts(F.col(f"c_{a}"), F.col(f"p_{a}"), F.col(f"s_{a}"))).withColumn(f"k_{a}", F.size(f"starts_{a}"))
    per_chunk = F.col("k_z").cast("long") * F.col("k_y") * F.col("k_x")
    for a in AXES:
        df = df.select("*", F.posexplode(f"starts_{a}").alias(f"i_{a}", f"l_{a}"))
    own = (F.col("i_z").cast("long") * F.col("k_y") + F.col("i_y")) * F.col("k_x") + F.col("i_x")
    bounds = [c for a in AXES for c in ((F.col(f"o_{a}") + F.col(f"l_{a}")).alias(f"{a}0"), (F.col(f"o_{a}") + F.col(f"l_{a}") + F.col(f"p_{a}")).alias(f"{a}1"))]
    # every chunk of a volume has equally many patches, so no running sum is needed
    return df.select("volume_id", (F.col("chunk_id") * per_chunk + own).alias("ord"), "chunk_id", *bounds)


def paired_grids(source: DataFrame, target: DataFrame) -> DataFrame:
    """Patches of two grids joined by their ordinal; an error at run time if a volume's numbers differ.

    Of chunked grids both must have a patch in the same chunk; ``chunk_id`` stays.
    """
    keys = ["volume_id", *(["chunk_id"] if "chunk_id" in source.columns else []), "ord"]
    a = source.select(*keys, *(F.col(f"{x}{i}").alias(f"{x}{i}") for x in AXES for i in (0, 1)))
    b = target.select(*keys, *(F.col(f"{x}{i}").alias(f"t_{x}{i}") for x in AXES for i in (0, 1)))
    both = a.join(b, keys, "full")
    same = F.assert_true(F.col("z0").isNotNull() & F.col("t_z0").isNotNull(), F.lit("the grids have different numbers of patches"))
    return both.where(same.isNull())


def extract_patches(voxels: DataFrame, patches: DataFrame, block: int = 64) -> DataFrame:
    """``(volume_id, ord, z, y, x, lz, ly, lx, v)``: each patch's voxels, with patch-local positions.

    A range join as an equi-join: patches are listed under each block of
    ``block`` voxels per axis that they touch, voxels have one block each.
    """
    p = patches
    for a in AXES:
        p = p.select("*", F.explode(F.sequence(F.floor(F.col(f"{a}0") / block).cast("int"), F.floor((F.col(f"{a}1") - 1) / block).cast("int"))).alias(f"b_{a}"))
    v = voxels.select("*", *(F.floor(F.col(a) / block).cast("int").alias(f"b_{a}") for a in AXES))
    inside = reduce(lambda a, b: a & b, [(F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1")) for a in AXES])
    joined = v.join(p, ["volume_id", *(f"b_{a}" for a in AXES)]).where(inside)
    carried = [c for c in voxels.columns if c not in ("volume_id", *AXES)]
    return joined.select("volume_id", "ord", *AXES, *((F.col(a) - F.col(f"{a}0")).alias(f"l{a}") for a in AXES), *carried)


def _starts_at(a: str, mode: str) -> tuple[Column, Column]:
    """The (index, start) of the patches along an axis that hold a position, by arithmetic, and how many starts the axis has."""
    if mode == "even":
        return _even_starts_at(a)
    at, n, p, s = (F.col(c).cast("int") for c in (a, f"n_{a}", f"p_{a}", f"s_{a}"))
    last = F.floor((n - p) / s).cast("int")
    low, high = F.greatest(F.ceil((at - p + 1) / s), F.lit(0)).cast("int"), F.least(F.floor(at / s).cast("int"), last)
    pair = lambda i, start: F.struct(i.cast("int").alias("i"), start.cast("int").alias("start"))
    none = F.array().cast("array<struct<i:int,start:int>>")
    found = F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda i: pair(i, i * s))).otherwise(none)
    if mode == "basic":
        return found, last + 1
    if mode != "clamped":
        raise ValueError(f"starts of mode {mode} are no arithmetic series")
    odd = (n - p) % s != 0
    return F.concat(found, F.when(odd & (at >= n - p), F.array(pair(last + 1, n - p))).otherwise(none)), last + 1 + odd.cast("int")


def _even_starts_at(a: str) -> tuple[Column, Column]:
    """``_starts_at`` of an evenly spread axis: starts are rounded multiples of its step."""
    at, n, p = (F.col(c).cast("int") for c in (a, f"n_{a}", f"p_{a}"))
    many = (F.ceil((n - p) / F.col(f"s_{a}")) + 1).cast("int")
    # one start alone is 0, whatever the step
    step = (n - p) / F.greatest(many - 1, F.lit(1))
    wide = F.when(many > 1, step).otherwise(p.cast("double"))
    low = F.greatest(F.floor((at - p) / wide), F.lit(0)).cast("int")
    high = F.greatest(F.least(F.ceil((at + 1) / wide), many - 1), low).cast("int")
    near = F.transform(F.sequence(low, high), lambda i: F.struct(i.alias("i"), F.rint(i * step).cast("int").alias("start")))
    return F.filter(near, lambda e: (e["start"] <= at) & (at < e["start"] + p) & (e["i"] < many)), many


def grid_patches(voxels: DataFrame, sizes: DataFrame, mode: str = "clamped") -> DataFrame:
    """``(volume_id, ord, z0, y0, x0, z, y, x, lz, ly, lx, ...)``: the voxels of each patch of a ``basic``, ``clamped`` or ``even`` grid.

    A voxel finds its own patches by arithmetic on the starts, a few more than
    ceil(p / s) an axis, so no voxel meets a patch that does not hold it and
    nothing but the row of sizes is joined.  ``ord`` is that of ``patch_grid``.
    """
    carried = [c for c in voxels.columns if c not in ("volume_id", *AXES)]
    df = voxels.join(sizes.select("volume_id", *(f"{k}_{a}" for a in AXES for k in "nps")), "volume_id")
    found = {a: _starts_at(a, mode) for a in AXES}
    df = df.select("volume_id", *AXES, *carried, *(found[a][1].alias(f"k_{a}") for a in AXES), *(found[a][0].alias(f"f_{a}") for a in AXES))
    for a in AXES:
        df = df.select("*", F.explode(f"f_{a}").alias(f"e_{a}")).drop(f"f_{a}")
    order = (F.col("e_z.i").cast("long") * F.col("k_y") + F.col("e_y.i")) * F.col("k_x") + F.col("e_x.i")
    local = [(F.col(a) - F.col(f"e_{a}.start")).alias(f"l{a}") for a in AXES]
    return df.select("volume_id", order.alias("ord"), *(F.col(f"e_{a}.start").alias(f"{a}0") for a in AXES), *AXES, *local, *carried)


def full_grid(shapes: DataFrame) -> DataFrame:
    """Every position of each volume: ``shapes`` has ``volume_id, n_z, n_y, n_x``."""
    df = shapes
    for a in AXES:
        df = df.select("*", F.explode(F.sequence(F.lit(0), (F.col(f"n_{a}") - 1).cast("int"))).alias(a))
    return df.select("volume_id", *AXES)


def pad_bounds(shapes: DataFrame, least: Sequence[int | Column], multiple: Sequence[int] = (1, 1, 1)) -> DataFrame:
    """``shapes`` with ``w_a``, each axis' padded length, and ``d_a``, what goes below; the odd voxel goes above; never cropped."""
    s = shapes
    for a, low, m in zip(AXES, least, multiple):
        want = F.greatest(F.col(f"n_{a}"), low if isinstance(low, Column) else F.lit(low))
        want = F.ceil(want / m) * m
        s = s.withColumn(f"w_{a}", want.cast("int")).withColumn(f"d_{a}", F.floor((F.col(f"w_{a}") - F.col(f"n_{a}")) / 2).cast("int"))
    return s


def _images(a: str, mode: str) -> Column:
    """All positions of the padded axis that take their value from position ``a``."""
    at, n, w, d = (F.col(c) for c in (a, f"n_{a}", f"w_{a}", f"d_{a}"))
    span = lambda low, high: F.when(low <= high, F.sequence(low.cast("int"), F.greatest(low, high).cast("int"))).otherwise(F.array().cast("array<int>"))
    if mode == "edge":
        below = F.when(at == 0, span(F.lit(0), d - 1)).otherwise(F.array().cast("array<int>"))
        above = F.when(at == n - 1, span(d + n, w - 1)).otherwise(F.array().cast("array<int>"))
        return F.concat(below, F.array((d + at).cast("int")), above)
    if mode not in ("reflect", "symmetric", "wrap"):
        raise ValueError(f"unknown mode {mode}")
    # the axis repeats with a period, in which a position comes once or mirrored as well
    period = F.greatest(2 * n - 2, F.lit(1)) if mode == "reflect" else 2 * n if mode == "symmetric" else n
    series = lambda first: F.filter(F.transform(span(-F.ceil(w / period), F.ceil(w / period)), lambda k: (first + k * period).cast("int")), lambda t: (t >= 0) & (t < w))
    if mode == "wrap":
        return series(d + at)
    return F.array_distinct(F.concat(series(d + at), series(d - at if mode == "reflect" else d - at - 1)))


def moved(voxels: DataFrame, bounds: DataFrame) -> DataFrame:
    """Voxels at their positions in the padded volume, with no rows for the margin: ``bounds`` is that of ``pad_bounds``."""
    df = voxels.join(bounds.select("volume_id", *(f"d_{a}" for a in AXES)), "volume_id")
    return df.select("volume_id", *((F.col(a) + F.col(f"d_{a}")).cast("int").alias(a) for a in AXES), *(c for c in voxels.columns if c not in ("volume_id", *AXES)))


def pad(voxels: DataFrame, shapes: DataFrame, least: Sequence[int | Column], multiple: Sequence[int] = (1, 1, 1), fill: float = 0.0, mode: str = "constant") -> DataFrame:
    """Each volume padded to ``least`` per axis or more, and to a multiple, with all its value columns.

    ``constant`` fills with ``fill``, and with it gives a row to positions that
    had none; ``edge``, ``reflect``, ``symmetric`` and ``wrap`` repeat voxels of
    the volume: each voxel lists the positions that take its value, so nothing
    but the row of sizes is joined.
    """
    s = pad_bounds(shapes, least, multiple)
    values = [c for c in voxels.columns if c not in ("volume_id", *AXES)]
    if mode != "constant":
        df = voxels.join(s.select("volume_id", *(f"{k}_{a}" for a in AXES for k in "nwd")), "volume_id")
        for a in AXES:
            df = df.select("*", F.explode(_images(a, mode)).alias(f"t_{a}"))
        return df.select("volume_id", *(F.col(f"t_{a}").alias(a) for a in AXES), *values)
    grid = full_grid(s.select("volume_id", *(F.col(f"w_{a}").alias(f"n_{a}") for a in AXES)))
    return grid.join(moved(voxels, s), ["volume_id", *AXES], "left").select("volume_id", *AXES, *(F.coalesce(c, F.lit(float(fill))).alias(c) for c in values))


def unpad(voxels: DataFrame, bounds: DataFrame) -> DataFrame:
    """The way back from ``pad``, for any columns: ``bounds`` is that of ``pad_bounds``."""
    df = voxels.join(bounds.select("volume_id", *(f"{k}_{a}" for a in AXES for k in "dn")), "volume_id")
    inside = reduce(lambda x, y: x & y, [(F.col(a) >= F.col(f"d_{a}")) & (F.col(a) < F.col(f"d_{a}") + F.col(f"n_{a}")) for a in AXES])
    rest = [c for c in voxels.columns if c not in ("volume_id", *AXES)]
    return df.where(inside).select("volume_id", *((F.col(a) - F.col(f"d_{a}")).cast("int").alias(a) for a in AXES), *rest)


def crop(voxels: DataFrame, offsets: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    """The box at ``offsets`` of the given shape, its positions from 0."""
    inside = reduce(lambda a, b: a & b, [(F.col(a) >= o) & (F.col(a) < o + n) for a, o, n in zip(AXES, offsets, shape)])
    moved = [(F.col(a) - o).cast("int").alias(a) for a, o in zip(AXES, offsets)]
    return voxels.where(inside).select("volume_id", *moved, *(c for c in voxels.columns if c not in ("volume_id", *AXES)))


def remove_halo(patch_voxels: DataFrame, patches: DataFrame, shapes: DataFrame, halo: tuple[int, int, int]) -> DataFrame:
    """Patch voxels without the halo at faces that lie inside the volume."""
    df = patch_voxels.join(patches, ["volume_id", "ord"]).join(shapes, "volume_id")
    keep = reduce(
        lambda a, b: a & b,
        [
            (F.col(f"l{a}") >= F.when(F.col(f"{a}0") > 0, h).otherwise(0)) & (F.col(f"l{a}") < F.col(f"{a}1") - F.col(f"{a}0") - F.when(F.col(f"{a}1") < F.col(f"n_{a}"), h).otherwise(0))
            for a, h in zip(AXES, halo)
        ],
    )
    return df.where(keep).select(patch_voxels.columns)


def running_mean(df: DataFrame, keys: list[str], order: list[str], value: str, weight: str) -> DataFrame:
    """Each row with the weighted mean of its group up to it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_mean", F.sum(F.col(value) * F.col(weight)).over(w) / F.sum(weight).over(w))
