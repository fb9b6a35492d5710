import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainlake.operators import grid, particles
from grainlake.operators.graph import connected_components


def voxels(spark, cells):
    return spark.createDataFrame([("v", *map(int, c)) for c in cells], "volume_id string, z int, y int, x int, cls int")


def ids(df, column):
    return {(r.z, r.y, r.x): r[column] for r in df.collect()}


def test_components_of_random_voxels(spark):
    rng = np.random.default_rng(3)
    cells = np.argwhere(rng.random((12, 12, 12)) < 0.12)
    df = voxels(spark, [(*c, 1) for c in cells])
    got = ids(particles.components(df, (12, 12, 12), 26, block=5), "component")
    left, want = {tuple(map(int, c)) for c in cells}, {}
    while left:
        first = min(left)
        todo, seen = [first], {first}
        while todo:
            z, y, x = todo.pop()
            for o in itertools.product((-1, 0, 1), repeat=3):
                n = (z + o[0], y + o[1], x + o[2])
                if n in left and n not in seen:
                    seen.add(n)
                    todo.append(n)
        for s in seen:
            want[s] = (first[0] * 12 + first[1]) * 12 + first[2]
        left -= seen
    assert got == want


def test_graph_components_of_random_edges(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(7, None)]
    got = {r.u: r.v for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(a):
        while root.get(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    nodes = {n for e in edges for n in e if n is not None}
    assert got == {n: find(n) for n in nodes if find(n) != n}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_coreless_component_leaves_a_gap(spark):
    cells = [(0, 0, 0, 2), (0, 0, 1, 2), (5, 5, 5, 1), (5, 5, 6, 2), (5, 5, 7, 2)]
    got = ids(particles.instances(voxels(spark, cells), (10, 10, 10)), "label")
    # the one-voxel core is too thin to stay, so this component is without a core as well
    assert got == {(0, 0, 0): 2, (0, 0, 1): 2, (5, 5, 5): 4, (5, 5, 6): 4, (5, 5, 7): 4}
    only = voxels(spark, [(1, 1, x, 1) for x in range(3)])
    assert set(ids(particles.instances(only, (10, 10, 10)), "label").values()) == {1}
    dense = ids(particles.instances(voxels(spark, cells), (10, 10, 10), faithful_gaps=False), "label")
    assert set(dense.values()) == {1, 2}


def test_growth_tie_goes_to_the_highest(spark):
    fg = spark.createDataFrame([("v", 0, 0, x, 0) for x in range(5)], "volume_id string, z int, y int, x int, component long")
    seeds = fg.where("x in (0, 4)").withColumn("seed", F.when(F.col("x") == 0, 1).otherwise(3).cast("long"))
    got = ids(particles.grow(seeds, fg), "seed")
    assert [got[0, 0, x] for x in range(5)] == [1, 1, 3, 3, 3]


def test_empty_class_map(spark):
    assert particles.instances(particles.empty_classes(spark), (4, 4, 4)).count() == 0


def test_size_filter_counts_unused_labels(spark):
    counts = spark.createDataFrame([("v", 1, 10), ("v", 2, 2), ("v", 5, 3)], "volume_id string, label long, voxels long")
    assert {r.label for r in particles.size_filter(counts, 1.0).collect()} == {1, 5}
    assert particles.size_filter(counts, None).count() == 3


def test_sizes_are_checked(spark):
    row = {"volume_id": 1} | {f"{k}_{a}": v for a in "zyx" for k, v in (("n", 4), ("p", 8), ("s", 4))}
    with pytest.raises(Exception, match="larger than its volume"):
        grid.patch_grid(grid.check_sizes(spark.createDataFrame([row]))).collect()


def test_min_max_of_hard_groups(spark):
    from grainlake.operators.scaling import min_max

    rows = [("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 2.0), ("a", 3, None), ("b", 0, 5.0), ("b", 1, 5.0), (None, 0, 0.0), (None, 1, 4.0), ("c", 0, None)]
    table = spark.createDataFrame(rows, "volume_id string, _low int, v double")
    got = min_max(table.withColumnRenamed("_low", "low"))
    assert got.columns == ["volume_id", "low", "v"]
    want = [("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, 0.5), ("a", 3, None), ("b", 0, 0.0), ("b", 1, 0.0), (None, 0, 0.0), (None, 1, 1.0), ("c", 0, None)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert min_max(table.withColumnRenamed("_low", "low").where("false")).count() == 0
