"""Values scaled by statistics of their group, without a window that gathers a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def min_max(table: DataFrame, by: Sequence[str] = ("volume_id",), value: str = "v", constant: float | None = 0.0) -> DataFrame:
    """``table`` with ``value`` scaled to 0..1 within each group of ``by``; ``constant`` where all values of a group are equal.

    Bounds are partial aggregates, joined back by group, so a volume of any
    size is spread over tasks.  Null values stay null and do not count, null
    groups are groups of their own, an empty table stays empty.
    """
    names = [f"_group_{i}" for i in range(len(by))]
    bounds = table.groupBy(*(F.col(c).alias(n) for c, n in zip(by, names))).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    same = F.lit(True)
    for c, n in zip(by, names):
        same &= F.col(c).eqNullSafe(F.col(n))
    low, high = F.col("_low"), F.col("_high")
    scaled = F.when(F.col(value).isNull(), None).when(low == high, F.lit(constant)).otherwise((F.col(value) - low) / (high - low))
    return table.join(bounds, same).withColumn(value, scaled).select(*table.columns)
