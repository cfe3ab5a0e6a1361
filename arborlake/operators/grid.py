"""Voxels and cells: keys, filters, thinning, per-cell values, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint

AXES = ("x", "y", "z")


def bounds(cloud: DataFrame) -> DataFrame:
    """One row: count, bounds, area and density of a cloud."""
    ends = [f(a).alias(f"{a}_{n}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]
    area = (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))
    found = cloud.agg(F.count(F.lit(1)).alias("n_points"), *ends).withColumn("area_ha", area / 1e4)
    return found.withColumn("points_m2", F.col("n_points") / F.greatest(area, F.lit(1.0)))


def with_voxels(cloud: DataFrame, size: float, axes: Sequence[str] = AXES, names: Sequence[str] = ("vx", "vy", "vz")) -> DataFrame:
    """Add voxel indices. The grid starts at the least coordinates of the points given.

    The origin is one row, so its join is a broadcast of a few numbers.
    """
    origin = cloud.agg(*[F.min(a).alias(f"__{a}") for a in axes])
    index = {n: F.floor((F.col(a) - F.col(f"__{a}")) / F.lit(float(size))) for a, n in zip(axes, names)}
    return cloud.join(F.broadcast(origin)).withColumns(index).drop(*[f"__{a}" for a in axes])


def voxel_counts(cloud: DataFrame, size: float) -> DataFrame:
    return with_voxels(cloud, size).groupBy("vx", "vy", "vz").agg(F.count(F.lit(1)).alias("n"))


def remove_isolated(cloud: DataFrame, size: float = 0.5, least: int = 4) -> DataFrame:
    """Keep the points whose voxel holds at least ``least`` points.

    Voxels are counted, with partial counts in each task, and joined back by a semi-join: unlike a
    window over voxels this never holds a crowded voxel's points together.
    """
    keyed = with_voxels(cloud, size)
    full = keyed.groupBy("vx", "vy", "vz").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return keyed.join(full, ["vx", "vy", "vz"], "left_semi").drop("vx", "vy", "vz")


def thin(cloud: DataFrame, size: float, id_col: str = "pid") -> DataFrame:
    """The point with the smallest id of each voxel: an original point, not a mean."""
    keyed = with_voxels(cloud, size)
    row = F.min_by(F.struct(*cloud.columns), id_col)
    return keyed.groupBy("vx", "vy", "vz").agg(row.alias("p")).select("p.*")


def with_cells(cloud: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """Add cell indices ``ix, iy`` of a grid that starts ``margin`` before the least x and y."""
    origin = cloud.agg(F.min("x").alias("__x"), F.min("y").alias("__y"))
    ix, iy = (F.floor((F.col(a) - F.col(f"__{a}") + F.lit(float(margin))) / F.lit(float(size))) for a in ("x", "y"))
    return cloud.join(F.broadcast(origin)).withColumns({"ix": ix, "iy": iy}).drop("__x", "__y")


def upper_medians(rows: DataFrame, keys: Sequence[str], value: str, bins: int = 1 << 16) -> DataFrame:
    """``keys, v``: the middle value of each group, and of two middle values the larger one; nulls don't count.

    An exact selection in two steps, neither of which holds a group together. Counts in equal bins over the whole range
    of values, summed in each task first, tell which bin holds the middle and which of its values it is. Then the values of
    that bin alone are counted. ``rows`` is read three times and should be stored or cheap to read.
    """
    keys = list(keys)
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    ends = known.agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    share = F.coalesce(F.try_divide(F.col("__v") - F.col("__low"), F.col("__high") - F.col("__low")), F.lit(0.0))
    binned = known.join(F.broadcast(ends)).select(*keys, "__v", F.least(F.floor(share * bins), F.lit(bins - 1)).alias("__bin"))
    counts = binned.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    group = W.partitionBy(*keys)
    upto = group.orderBy("__bin").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.select(*keys, "__bin", "__n", F.sum("__n").over(upto).alias("__upto"), F.floor(F.sum("__n").over(group) / 2).alias("__rank"))
    # the place of the middle among the values of its bin, from 0
    before = F.col("__upto") - F.col("__n")
    middle = ranked.where((before <= F.col("__rank")) & (F.col("__rank") < F.col("__upto"))).select(*keys, "__bin", (F.col("__rank") - before).alias("__nth"))
    values = binned.groupBy(*keys, "__bin", "__v").agg(F.count(F.lit(1)).alias("__n"))
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys] + [F.col("__bin") == F.col("__in")]
    inside = values.join(middle.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__bin").alias("__in"), "__nth"), same)
    upto = W.partitionBy(*keys).orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    summed = inside.select(*keys, "__v", "__nth", F.sum("__n").over(upto).alias("__upto"))
    return summed.where(F.col("__upto") > F.col("__nth")).groupBy(*keys).agg(F.min("__v").alias("v"))


def cell_surface(cloud: DataFrame, size: float, mode: str = "min", margin: float = 0.0) -> DataFrame:
    """``ix, iy, v``: the lowest, highest or upper-median z of each cell."""
    placed = with_cells(cloud, size, margin)
    if mode == "median":
        return upper_medians(checkpoint(placed.select("ix", "iy", "z")), ["ix", "iy"], "z")
    return placed.groupBy("ix", "iy").agg({"min": F.min, "max": F.max}[mode](F.col("z")).alias("v"))


def densest_cell(cloud: DataFrame, size: float = 2.0) -> DataFrame:
    """Centre of the cell with most points, the smallest index among equals: where the scanner stood."""
    origin = cloud.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    most = (
        with_cells(cloud, size).groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ix", "iy").limit(1)
    )
    return most.join(F.broadcast(origin)).select(
        (F.col("x0") + (F.col("ix") + 0.5) * size).alias("x"), (F.col("y0") + (F.col("iy") + 0.5) * size).alias("y"), "n"
    )


def bilinear(points: DataFrame, raster: DataFrame, size: float, values: Sequence[str], x0: Column, y0: Column) -> DataFrame:
    """Add ``values`` of a raster (``ix, iy, ...``), interpolated between the four cells around a point.

    Coordinates are held inside the raster. Each cell is packed with its three neighbours first, a
    shuffle of the raster alone, so that points meet the raster in one equi-join.
    """
    ends = raster.agg(F.max("ix").alias("__nx"), F.max("iy").alias("__ny"), F.min("ix").alias("__ox"), F.min("iy").alias("__oy"))
    moved = raster.select(
        F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)])).alias("d"), "ix", "iy", *values
    )
    at = [
        F.max(F.when((F.col("d.dx") == dx) & (F.col("d.dy") == dy), F.col(v))).alias(f"__{v}{dx}{dy}")
        for v in values
        for dx in (0, 1)
        for dy in (0, 1)
    ]
    patch = moved.groupBy((F.col("ix") - F.col("d.dx")).alias("__ix"), (F.col("iy") - F.col("d.dy")).alias("__iy")).agg(*at)
    held = points.join(F.broadcast(ends)).withColumns(
        {
            "__fx": F.greatest(F.col("__ox").cast("double"), F.least(F.col("__nx").cast("double"), (F.col("x") - x0) / F.lit(float(size)))),
            "__fy": F.greatest(F.col("__oy").cast("double"), F.least(F.col("__ny").cast("double"), (F.col("y") - y0) / F.lit(float(size)))),
        }
    )
    held = held.withColumns({"__ix": F.least(F.floor("__fx"), F.greatest("__ox", F.col("__nx") - 1)), "__iy": F.least(F.floor("__fy"), F.greatest("__oy", F.col("__ny") - 1))})
    wx, wy = F.col("__fx") - F.col("__ix"), F.col("__fy") - F.col("__iy")

    def value(v: str) -> Column:
        def part(dx: int, dy: int) -> Column:
            w = (wx if dx else 1 - wx) * (wy if dy else 1 - wy)
            return F.when(w == 0, 0.0).otherwise(w * F.col(f"__{v}{dx}{dy}"))

        return part(0, 0) + part(0, 1) + part(1, 0) + part(1, 1)

    return held.join(patch, ["__ix", "__iy"], "left").select(*points.columns, *[value(v).alias(v) for v in values])


def moving_mean(cells: DataFrame, value: str, window: int) -> DataFrame:
    """Mean over a square of ``window`` cells around each cell, with zeros outside: ``ix, iy, mean``.

    Two passes of running sums, along x and then y, each a window over one line of cells.
    """
    half = window // 2
    along_x = W.partitionBy("iy").orderBy("ix").rangeBetween(-half, half)
    along_y = W.partitionBy("ix").orderBy("iy").rangeBetween(-half, half)
    summed = cells.withColumn("__s", F.sum(value).over(along_x)).withColumn("__s", F.sum("__s").over(along_y))
    return summed.select("ix", "iy", (F.col("__s") / F.lit(float(window * window))).alias("mean"))


def layers(cloud: DataFrame, low: float, high: float, thick: float, step: float) -> DataFrame:
    """One row per point and horizontal layer that holds it: adds ``layer`` and ``layer_mid``.

    Layers begin at ``low`` every ``step`` and hold heights from their begin up to ``thick`` more.
    """
    n = int((high - thick + 1e-6 - low) / step) + 1
    every = F.array(*[F.struct(F.lit(i).alias("layer"), F.lit(low + i * step).alias("h0")) for i in range(n)])
    inside = F.filter(every, lambda s: (F.col("h") >= s["h0"]) & (F.col("h") < s["h0"] + thick))
    rows = cloud.where((F.col("h") >= low) & (F.col("h") < low + (n - 1) * step + thick)).withColumn("__l", F.explode(inside))
    return rows.withColumns({"layer": F.col("__l.layer"), "layer_mid": F.col("__l.h0") + thick / 2}).drop("__l")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin, n``: counts in equal bins, the upper end in the last bin; values outside are left out."""
    c = F.col(value)
    index = F.least(F.lit(bins - 1).cast("long"), F.floor((c - low) / F.lit((high - low) / bins)))
    return df.where(c.between(low, high)).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
