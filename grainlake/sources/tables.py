"""Volumes made of general tables, so that every operator runs on growing data.

``embeddings`` vectors of 64 numbers are cubes of 4 x 4 x 4 voxels, tiled ten by
ten in y and x and upwards in z by their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_Y, EDGE_X = 40, 40


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def voxels_of_embeddings(embeddings: DataFrame) -> DataFrame:
    """``(volume_id, z, y, x, v)``."""
    tile = embeddings.select("vec_id", F.posexplode("embedding").alias("d", "e"))
    return tile.select(
        F.lit("embeddings").alias("volume_id"),
        (F.floor(F.col("vec_id") / 100) * 4 + F.floor(F.col("d") / 16)).cast("int").alias("z"),
        (F.floor(F.col("vec_id") / 10) % 10 * 4 + F.floor(F.col("d") / 4) % 4).cast("int").alias("y"),
        (F.col("vec_id") % 10 * 4 + F.col("d") % 4).cast("int").alias("x"),
        F.col("e").cast("double").alias("v"),
    )


def shape_of_embeddings(embeddings: DataFrame) -> tuple[int, int, int]:
    """The volume's shape, from the highest id; (0, 40, 40) without rows."""
    top = embeddings.agg(F.max("vec_id")).first()[0]
    return (0 if top is None else (top // 100 + 1) * 4, EDGE_Y, EDGE_X)


def voxels_of_events(events: DataFrame) -> DataFrame:
    """A volume of day, hour and user group: the sum of values, rounded to six decimals."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2000-01-01").cast("date"))
    keyed = events.select(day.alias("z"), F.hour("ts").alias("y"), (F.col("user_id") % 32).cast("int").alias("x"), "value")
    return keyed.groupBy("z", "y", "x").agg(F.round(F.sum("value"), 6).alias("v")).select(F.lit("events").alias("volume_id"), "z", "y", "x", "v")


def sizes_of_parts(part: DataFrame, patch: int = 16, stride: int = 8) -> DataFrame:
    """A table of grid sizes, one volume per part."""
    lengths = {"z": 16 + F.col("p_size"), "y": 16 + F.col("p_size") % 17, "x": 16 + F.col("p_partkey") % 13}
    named = [x for a, n in lengths.items() for x in (n.cast("int").alias(f"n_{a}"), F.lit(patch).alias(f"p_{a}"), F.lit(stride).alias(f"s_{a}"))]
    return part.select(F.col("p_partkey").alias("volume_id"), *named)


def meta_of_parts(part: DataFrame) -> DataFrame:
    """``(volume_id, spacing, particle_size)`` in millimetres."""
    return part.select(F.col("p_partkey").alias("volume_id"), (F.col("p_size") / 1000.0).alias("spacing"), (F.col("p_retailprice") / 1000.0).alias("particle_size"))


def cases_of_embeddings(embeddings: DataFrame, cases: int = 5) -> DataFrame:
    """``(volume_id, z, y, x, v)``: columns of 4 x 4 x 4 cubes, one volume for each remainder of the id."""
    tile = embeddings.select("vec_id", F.posexplode("embedding").alias("d", "e"))
    return tile.select(
        F.concat(F.lit("case_"), (F.col("vec_id") % cases).cast("string")).alias("volume_id"),
        (F.floor(F.col("vec_id") / cases) * 4 + F.floor(F.col("d") / 16)).cast("int").alias("z"),
        (F.floor(F.col("d") / 4) % 4).cast("int").alias("y"),
        (F.col("d") % 4).cast("int").alias("x"),
        F.col("e").cast("double").alias("v"),
    )


def sizes_of_cases(voxels: DataFrame) -> DataFrame:
    """A row per volume of ``cases_of_embeddings``: sizes, and a spacing of 0.25, 0.5 and 0.125 millimetres."""
    n = voxels.groupBy("volume_id").agg((F.max("z") + 1).alias("n_z"))
    spacing = [F.lit(s).alias(f"spacing_{a}") for a, s in zip("zyx", (0.25, 0.5, 0.125))]
    return n.select("volume_id", "n_z", F.lit(4).alias("n_y"), F.lit(4).alias("n_x"), *spacing)
