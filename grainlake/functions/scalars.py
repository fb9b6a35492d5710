"""Column functions: scalar arithmetic of volumes, class scores, and names of files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def standardize(v: Column, mean: float, std: float) -> Column:
    """``(v - mean) / std``; a zero std is not guarded against."""
    return (v - F.lit(float(mean))) / F.lit(float(std))


def nan_to_zero(v: Column) -> Column:
    return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


def pixel_to_mm(length: Column, spacing: Column) -> Column:
    return length * spacing


def mm_to_pixel(length: Column, spacing: Column) -> Column:
    return length / spacing


def size_conversion_factor(source_size: Column, source_spacing: Column, target_size: Column, target_spacing: Column) -> Column:
    return (target_spacing / source_spacing) * (source_size / target_size)


def round3(x: Column) -> Column:
    """Rounded half to even at three decimals."""
    return F.rint(x * 1000) / 1000


def patch_size(factor: Column, target_patch: Column) -> Column:
    """The source patch for a target patch: the factor is rounded to three decimals first."""
    return F.rint(target_patch * round3(factor)).cast("long")


def even_edge(patch: Column) -> Column:
    """Odd patch edges grow by one."""
    return patch + patch % 2


def softmax(scores: Column) -> Column:
    """Softmax of an array of scores."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def argmax(scores: Column) -> Column:
    """Index of the largest entry, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def region_class(probabilities: Column, order: Sequence[int], threshold: float = 0.5) -> Column:
    """The class of the last entry above the threshold, in the given order of classes; else 0."""
    out = F.lit(0)
    for i, c in enumerate(order):
        out = F.when(probabilities[i] > threshold, F.lit(int(c))).otherwise(out)
    return out


def one_hot(label: Column, classes: int, ignore: int | None = None) -> Column:
    """0/1 per class; an ignored label fills all entries with itself."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == label).cast("int"))
    return hot if ignore is None else F.when(label == ignore, F.array_repeat(F.lit(int(ignore)), classes)).otherwise(hot)


def features_per_level(first: int, levels: int) -> Column:
    """``first * 2**k`` for each level."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: (F.lit(first) * F.pow(F.lit(2.0), k)).cast("long"))


def feature_map_size(edges: Sequence[Column], pools: Sequence[Sequence[int]], first: int, most: int, modalities: int, classes: int, convs: int = 2, deep_supervision: bool = False) -> Column:
    """Numbers that an encoder and decoder hold for a patch with these edges: what its memory grows with.

    ``pools`` has the factors by which each level shrinks the axes.  Features
    double from ``first`` with each level, up to ``most``; a level holds ``convs``
    maps on either side and one from the level below, the last one ``convs``;
    with ``deep_supervision`` inner levels but the last two hold classes as well.
    """
    edges, held = list(edges), F.lit(0).cast("long")
    for level in range(len(pools) + 1):
        if level:
            edges = [F.floor(e / f) for e, f in zip(edges, pools[level - 1])]
        maps = (convs if level == len(pools) > 0 else 2 * convs + 1) * min(first << level, most)
        if level == 0:
            maps += modalities + classes
        elif deep_supervision and level < len(pools) - 1:
            maps += classes
        held = held + maps * reduce(lambda a, b: a * b, edges, F.lit(1).cast("long"))
    return held


def flip(position: Column, size: Column, flipped: Column) -> Column:
    """A position along a flipped axis; flipping twice gives it back."""
    return F.when(flipped, size - 1 - position).otherwise(position)


def natural_key(name: Column) -> Column:
    """A key by which names sort with their digit runs as numbers."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p))


def stem(name: Column) -> Column:
    """A file name up to its first dot."""
    return F.split_part(name, F.lit("."), F.lit(1))


def without_suffix(name: Column, n: int) -> Column:
    """A name without its last n characters."""
    return F.substr(name, F.lit(1), F.greatest(F.length(name) - n, F.lit(0)))
