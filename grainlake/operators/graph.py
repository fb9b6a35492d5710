"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

#: Edges that a task reduces to a forest before any round is taken.
EDGES = 500_000


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i with j: each member's label is the smallest position it reaches."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, jumped := label[label]):
            label = jumped


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a partition as stars around the smallest node of each of its components."""
    edges = [p for p in parts if len(p)]
    if edges:
        node, place = np.unique(np.concatenate([p[c].to_numpy() for c in ("u", "v") for p in edges]), return_inverse=True)
        label = merge_labels(np.arange(len(node)), *np.split(place, 2))
        inner = np.flatnonzero(label != np.arange(len(node)))
        yield pd.DataFrame({"u": node[inner], "v": node[label[inner]]})


def _large_star(e: DataFrame, keys: list[str]) -> DataFrame:
    """Every larger neighbour of a node points to the smallest node it can see from there."""
    both = e.select(*keys, "u", "v").union(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(least, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(e: DataFrame, keys: list[str]) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them."""
    least = e.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    out = e.join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(least.select(*keys, "u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, name: str = "components", keys: tuple[str, ...] = ()) -> DataFrame:
    """``(u, v)`` edges to ``(u, v)`` where v is the smallest node reachable from u.

    Components are found separately for each value of ``keys``.  The large-star
    and small-star steps alternate until the edges no longer change; every round
    is written to the shared folder, so that the lineage stays short.  Nodes
    that are the smallest of their component, or have no edge, get no row.  Rows
    with a null end are left out, repeated and reversed edges and self-links
    change nothing, and an empty table gives an empty one.
    """
    k = list(keys)
    e = edges.where("u is not null and v is not null and u <> v")
    e = materialise(e.select(*k, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    if not k:
        # a task's edges become a forest first, so that a dense component costs no more than its nodes
        tasks = max(1, e.count() // EDGES)
        e = materialise(e.coalesce(tasks).mapInPandas(_forest, e.schema), name)
        if tasks == 1:
            return e
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64(*k, "u", "v").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            return e
        mark = now
        e = materialise(_small_star(_large_star(e, k), k), name)
