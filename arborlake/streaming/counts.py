"""Voxel counts over a stream of points, kept as points arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_voxel_counts(points: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0, z0: float = 0.0) -> DataFrame:
    """Count per voxel of a stream (``x, y, z``) on a grid with a fixed origin; use output mode ``update`` or ``complete``.

    A stream has no least coordinate yet, so the origin is given. State is one count per voxel.
    """
    index = [F.floor((F.col(a) - o) / F.lit(float(size))).alias(f"v{a}") for a, o in (("x", x0), ("y", y0), ("z", z0))]
    return points.groupBy(*index).agg(F.count(F.lit(1)).alias("n"))
