"""Per-tree measures: heights, diameter at breast height, crown, quality."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SurveyConfig
from ..functions.geometry import lean_degrees, perpendicular_basis
from ..kernels.hull import hull_2d, hull_corners, hull_volume, polygon
from .circles import ransac_circles


def heights(points: DataFrame, percentile: float = 99.5, least: int = 20) -> DataFrame:
    """``tree_id, n_points, height_m, height_max_m``; heights are null below ``least`` points."""
    enough = F.count(F.lit(1)) >= least
    return points.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.when(enough, F.percentile("h", F.lit(percentile / 100))).alias("height_m"),
        F.when(enough, F.max("h")).alias("height_max_m"),
    )


def across_axis(rows: DataFrame) -> DataFrame:
    """Add ``u, v``: where ``x, y, z`` lies in the plane across the row's axis (``axis_x/y/z``) through ``mid_x/y/z``."""
    e1, e2 = perpendicular_basis(*(F.col(f"axis_{a}") for a in "xyz"))
    away = [F.col(a) - F.col(f"mid_{a}") for a in "xyz"]
    return rows.withColumns({n: away[0] * e[0] + away[1] * e[1] + away[2] * e[2] for n, e in (("u", e1), ("v", e2))})


def slice_plane(points: DataFrame, axes: DataFrame, heights_at: tuple[float, ...], thick: float) -> DataFrame:
    """Points of the slices around given heights, projected across each tree's axis: adds ``pos, at, u, v``.

    ``axes`` has ``tree_id``, ``axis_x/y/z`` and the axis's origin ``mid_x/y/z``. Each point is
    tested against all heights in one pass.
    """
    every = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(float(h)).alias("at")) for i, h in enumerate(heights_at)])
    near = F.filter(every, lambda s: F.abs(F.col("h") - s["at"]) <= thick / 2)
    sliced = points.withColumn("__s", F.explode(near)).withColumns({"pos": F.col("__s.pos"), "at": F.col("__s.at")}).drop("__s")
    return across_axis(sliced.join(axes, "tree_id"))


def search_radius(stack_diameter: Column) -> Column:
    """How far from the axis a stem's points are looked for."""
    return F.greatest(F.lit(0.25), 2.5 * stack_diameter)


def diameter_slices(points: DataFrame, axes: DataFrame, height: float = 1.3, thick: float = 0.12) -> DataFrame:
    """The points that each tree's diameter was looked for in: ``tree_id, pid, u, v, near``.

    ``axes`` has ``dbh_height_used``, null for the usual ``height``, and ``stack_diameter``; ``near`` tells the points
    inside the search radius from those outside.
    """
    at = F.coalesce("dbh_height_used", F.lit(height))
    sliced = points.select("tree_id", "pid", "x", "y", "z", "h").join(axes, "tree_id").where(F.abs(F.col("h") - at) <= thick / 2)
    return across_axis(sliced).select("tree_id", "pid", "u", "v", (F.hypot("u", "v") < search_radius(F.col("stack_diameter"))).alias("near"))


def breast_height_diameters(points: DataFrame, seeds: DataFrame, cfg: SurveyConfig) -> DataFrame:
    """Diameter per tree from the first height of the fallbacks whose slice holds a fine circle.

    ``seeds``: ``tree_id, stack_diameter, stack_rmse, stack_arc`` and the axis. Trees without a
    fine circle have the diameter of their stack. All heights are fitted side by side, one group
    per tree and height; the first in order is then taken.
    """
    reach = search_radius(F.col("stack_diameter"))
    axis = seeds.select("tree_id", "stack_diameter", *[f"{n}_{a}" for n in ("axis", "mid") for a in "xyz"])
    sliced = slice_plane(points.select("tree_id", "pid", "x", "y", "z", "h"), axis, cfg.dbh_fallback_heights, cfg.dbh_slice_thickness)
    by_slice = F.count(F.lit(1)).over(W.partitionBy("tree_id", "pos"))
    full = sliced.withColumn("__n", by_slice).where("__n >= 12").where(F.hypot("u", "v") < reach).withColumn("__n", by_slice).where("__n >= 12")
    ready = full.select("pid", F.col("u").alias("x"), F.col("v").alias("y"), F.least(reach, F.lit(cfg.stem_max_diameter / 2)).alias("most_r"), "tree_id", "pos", "at")
    fits = ransac_circles(ready, ["tree_id", "pos", "at"], cfg).where(F.col("rmse") <= cfg.stem_max_rmse * 1.5)
    first = fits.groupBy("tree_id").agg(F.min_by(F.struct("at", "cx", "cy", "r", "rmse", "arc", "n"), "pos").alias("fit"))
    fitted = F.col("fit").isNotNull()
    return seeds.join(first, "tree_id", "left").select(
        "tree_id",
        F.when(fitted, 200 * F.col("fit.r")).otherwise(100 * F.col("stack_diameter")).alias("dbh_cm"),
        F.col("fit.at").alias("dbh_height_used"),
        F.when(fitted, 100 * F.col("fit.rmse")).otherwise(100 * F.col("stack_rmse")).alias("dbh_rmse_cm"),
        F.when(fitted, F.col("fit.arc")).otherwise(F.col("stack_arc")).alias("dbh_arc"),
        F.coalesce("fit.n", F.lit(0)).alias("dbh_n_pts"),
        lean_degrees(F.col("axis_z")).alias("stem_lean_deg"),
        F.when(fitted, "axis_fit").otherwise("stack_interp").alias("dbh_source"),
        F.col("fit.cx").alias("fit_u"),
        F.col("fit.cy").alias("fit_v"),
        F.when(fitted, 2 * F.col("fit.r") / F.greatest("stack_diameter", F.lit(1e-6))).otherwise(1.0).alias("dbh_vs_stack"),
    )


def crown_base(points: DataFrame, trees: DataFrame) -> DataFrame:
    """``tree_id, crown_base_m``: begin of the lowest half-metre above 1 m whose outer points are far from the stem.

    A half-metre counts with 20 points and a 90th percentile of their distance beyond four
    diameters, 0.75 m at least. ``trees``: ``tree_id, sx, sy, dbh_cm``.
    """
    placed = points.join(trees, "tree_id")
    top = points.groupBy("tree_id").agg(F.max("h").alias("top"))
    part = F.floor((F.col("h") - 1.0) / 0.5)
    out = F.greatest(F.lit(0.75), 4 * F.col("dbh_cm") / 100)
    parts = (
        placed.where("h >= 1.0")
        .groupBy("tree_id", part.alias("part"))
        .agg(F.count(F.lit(1)).alias("n"), F.percentile(F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")), F.lit(0.9)).alias("p90"), F.first(out).alias("out"))
        .join(top, "tree_id")
        .where((F.col("n") >= 20) & (F.col("p90") > F.col("out")) & (1.0 + 0.5 * F.col("part") < F.col("top")))
    )
    base = parts.groupBy("tree_id").agg((1.0 + 0.5 * F.min("part")).alias("crown_base_m"))
    return trees.select("tree_id").join(base, "tree_id", "left")


def crown_width(points: DataFrame, trees: DataFrame) -> DataFrame:
    """``tree_id, crown_diameter_m``: twice the 95th percentile of the distance from the stem, of 30 crown points at least.

    The crown is what is above ``crown_base_m``, or everything where that is null.
    """
    placed = points.join(trees.select("tree_id", "sx", "sy", "crown_base_m"), "tree_id")
    crown = placed.where(F.col("crown_base_m").isNull() | (F.col("h") >= F.col("crown_base_m")))
    far = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
    found = crown.groupBy("tree_id").agg(F.when(F.count(F.lit(1)) >= 30, 2 * F.percentile(far, F.lit(0.95))).alias("crown_diameter_m"))
    return trees.select("tree_id").join(found, "tree_id", "left")


#: Points of a tree in a batch beyond which only their hull's corners are shuffled.
_MANY = 500


def _hull_kernel(key: str) -> Callable[[pa.Table], pa.Table]:
    def measure(group: pa.Table) -> pa.Table:
        p = np.column_stack([group[c].to_numpy() for c in "xyz"])
        corners = hull_2d(p[:, :2])
        volume = hull_volume(p)
        area = polygon(corners)[0] if len(corners) > 2 and volume is not None else None
        return pa.table({key: group[key].slice(0, 1), "crown_area_m2": pa.array([area], pa.float64()), "crown_volume_m3": pa.array([volume], pa.float64())})

    return measure


def _corners_of_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a tree with many points in a batch, the hull's corners; other points pass."""
    for batch in batches:
        codes = batch.column("tree_id").dictionary_encode()
        tree = codes.indices.to_numpy(zero_copy_only=False)
        many = np.flatnonzero(np.bincount(tree, minlength=1) > _MANY)
        yield batch.filter(pa.array(~np.isin(tree, many)))
        p = np.column_stack([batch.column(c).to_numpy() for c in "xyz"])
        for t in many:
            corners = hull_corners(p[tree == t])
            key = pa.array([codes.dictionary[int(t)].as_py()] * len(corners), batch.schema.field("tree_id").type)
            yield pa.RecordBatch.from_arrays([key, *(pa.array(corners[:, k], pa.float64()) for k in range(3))], schema=batch.schema)


def crown_hulls(points: DataFrame, trees: DataFrame) -> DataFrame:
    """``tree_id, crown_area_m2, crown_volume_m3``: convex hulls of 30 crown points at least; null for flat ones.

    Each task first reduces a tree's many points to their own hull's corners, so that the group of a
    tree, which ends in one task, holds corners.
    """
    base = trees.select("tree_id", "crown_base_m")
    crown = points.join(base, "tree_id").where(F.col("crown_base_m").isNull() | (F.col("h") >= F.col("crown_base_m"))).select("tree_id", "x", "y", "z")
    full = crown.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 30")
    kind = dict(points.dtypes)["tree_id"]
    corners = crown.join(full, "tree_id", "left_semi").mapInArrow(_corners_of_many, f"tree_id {kind}, x double, y double, z double")
    found = corners.groupBy("tree_id").applyInArrow(_hull_kernel("tree_id"), f"tree_id {kind}, crown_area_m2 double, crown_volume_m3 double")
    return trees.select("tree_id").join(found, "tree_id", "left")


def derived_columns(trees: DataFrame) -> DataFrame:
    """Add ``basal_area_m2`` and ``h_d_ratio``."""
    half = F.col("dbh_cm") / 200
    return trees.withColumns({"basal_area_m2": math.pi * half * half, "h_d_ratio": F.try_divide(F.col("height_m"), F.col("dbh_cm") / 100)})


def quality(min_height: float = 2.0) -> Column:
    """``good``, ``fair`` or ``poor``; null measures make a tree poor."""
    # The thresholds of the two classes.
    ratio = F.col("dbh_vs_stack")
    common = (F.col("dbh_source") == "axis_fit") & (F.col("height_m") >= min_height)
    good = common & (F.col("dbh_arc") >= 0.60) & (F.col("dbh_rmse_cm") <= 2.0) & (F.col("n_stem_layers") >= 6) & ratio.between(1 / 1.6, 1.6)
    fair = common & (F.col("dbh_arc") >= 0.35) & (F.col("dbh_rmse_cm") <= 3.0) & ratio.between(1 / 2.2, 2.2)
    return F.when(good, "good").when(fair, "fair").otherwise("poor")


def measure_trees(points: DataFrame, seeds: DataFrame, cfg: SurveyConfig) -> DataFrame:
    """The tree table: one row per seed, also for those without points."""
    own = points.select("tree_id", "pid", "x", "y", "z", "h")
    tall = seeds.select("tree_id", "x", "y", F.col("n_layers").alias("n_stem_layers")).join(heights(own, cfg.height_percentile), "tree_id", "left")
    stems = tall.withColumn("n_points", F.coalesce("n_points", F.lit(0))).join(breast_height_diameters(own, seeds, cfg), "tree_id")
    at = stems.select("tree_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "dbh_cm")
    enough = own.join(stems.where("n_points >= 30").select("tree_id"), "tree_id", "left_semi")
    based = at.join(crown_base(enough, at), "tree_id")
    return (
        stems.join(based.select("tree_id", "crown_base_m"), "tree_id")
        .join(crown_width(enough, based), "tree_id")
        .join(crown_hulls(enough, based), "tree_id")
        .transform(derived_columns)
        .withColumn("quality", quality(cfg.min_tree_height))
    )
