"""Stems: circles per layer, stacked into chains, accepted or rejected with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SurveyConfig
from ..functions.geometry import angle_bin, main_direction
from ..plans.lineage import checkpoint
from .circles import circle_members, ransac_circles
from .graph import components, density_clusters
from .grid import layers, thin
from .neighbours import close_pairs, neighbour_join


def algebraic_circles(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Algebraic least-squares circle per group: ``keys, cx, cy, r, n``.

    Sums of products around the group's mean are all it takes, so this is one aggregation with
    partial sums. A group whose points lie in line has nulls.
    """
    own = points.groupBy(*keys).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    u, v = F.col(x) - F.col("__mx"), F.col(y) - F.col("__my")
    q = u * u + v * v
    sums = {"uu": u * u, "uv": u * v, "vv": v * v, "uq": u * q, "vq": v * q, "q": q}
    moved = points.join(own, list(keys))
    found = moved.groupBy(*keys, "__mx", "__my").agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(n) for n, e in sums.items()])
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    a = F.try_divide((F.col("uq") * F.col("vv") - F.col("vq") * F.col("uv")) / 2, det)
    b = F.try_divide((F.col("vq") * F.col("uu") - F.col("uq") * F.col("uv")) / 2, det)
    return found.select(
        *keys, (F.col("__mx") + a).alias("cx"), (F.col("__my") + b).alias("cy"), F.sqrt(a * a + b * b + F.col("q") / F.col("n")).alias("r"), "n"
    )


def arc_coverage(points: DataFrame, keys: Sequence[str], dx: Column, dy: Column, bins: int = 36) -> DataFrame:
    """Share of direction bins with a point, per group."""
    return points.groupBy(*keys).agg((F.count_distinct(angle_bin(dx, dy, bins)) / F.lit(float(bins))).alias("arc"))


def layer_circles(cloud: DataFrame, cfg: SurveyConfig) -> tuple[DataFrame, DataFrame]:
    """Circles of the dense clusters of each layer, ``circle_id, layer, h, cx, cy, r, rmse, arc``, and their points, ``circle_id, pid``."""
    sliced = layers(cloud, cfg.stem_slice_lo, cfg.stem_slice_hi, cfg.stem_layer_thick, cfg.stem_layer_step)
    keyed = checkpoint(sliced.select("pid", "x", "y", "z", "layer", "layer_mid"))
    thinned = checkpoint(_thin_layers(keyed, cfg.stem_voxel * 2))
    clusters = density_clusters(thinned, cfg.stem_dbscan_eps, cfg.stem_dbscan_min_pts, keys=["layer"]).where("cluster is not null")
    grouped = thinned.join(clusters.select("pid", "layer", "cluster"), ["pid", "layer"])
    full = grouped.groupBy("layer", "cluster").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= cfg.stem_dbscan_min_pts)
    ready = checkpoint(grouped.join(full, ["layer", "cluster"], "left_semi"))
    fits = ransac_circles(ready, ["layer", "layer_mid", "cluster"], cfg, cfg.stem_max_diameter / 2)
    fine = fits.where((F.col("rmse") <= cfg.stem_max_rmse) & (F.col("inlier_frac") >= cfg.ransac_min_inlier_frac))
    named = checkpoint(fine.withColumn("circle_id", F.col("cluster") * 1000 + F.col("layer")))
    circles = named.select("circle_id", "layer", F.col("layer_mid").alias("h"), "cx", "cy", "r", "rmse", "arc")
    return circles, circle_members(ready, named, ["layer", "cluster"], cfg.ransac_tol)


def _thin_layers(points: DataFrame, size: float) -> DataFrame:
    """One point per voxel of each layer; the grid of a layer starts at that layer's least coordinates."""
    origin = points.groupBy("layer").agg(*[F.min(a).alias(f"__{a}") for a in "xyz"])
    voxel = [F.floor((F.col(a) - F.col(f"__{a}")) / size).alias(f"v{a}") for a in "xyz"]
    keyed = points.join(F.broadcast(origin), "layer").select(*points.columns, *voxel)
    return keyed.groupBy("layer", "vx", "vy", "vz").agg(F.min_by(F.struct(*points.columns), "pid").alias("p")).select("p.*")


def link_circles(circles: DataFrame, cfg: SurveyConfig) -> DataFrame:
    """Pairs of circles of adjacent layers that continue each other: ``a, b``.

    The centres are at most a distance plus a share of the lower radius apart, and the radii differ
    by a bounded ratio. The search radius is that of the largest circle allowed.
    """
    slim = circles.select("circle_id", "layer", F.col("cx").alias("x"), F.col("cy").alias("y"), "r")
    lower = slim.withColumn("layer", F.col("layer") + 1)
    reach = cfg.stem_link_dist + cfg.link_radius_slope * cfg.stem_max_diameter / 2
    pairs = neighbour_join(lower, slim, reach, keys=["layer"])
    ratio = F.col("r") / F.col("n_r")
    near = F.col("dist") <= cfg.stem_link_dist + cfg.link_radius_slope * F.col("r")
    alike = ratio.between(1 / cfg.stem_link_radius_ratio, cfg.stem_link_radius_ratio)
    return pairs.where(near & alike).select(F.col("circle_id").alias("a"), F.col("n_circle_id").alias("b"))


def chains(circles: DataFrame, stacks: DataFrame) -> DataFrame:
    """The best circle per stack and layer, by least rmse, then id: ``stack`` and the circle's columns."""
    joined = circles.join(stacks.select(F.col("node").alias("circle_id"), F.col("root").alias("stack")), "circle_id")
    kept = [c for c in joined.columns if c not in ("stack", "layer")]
    best = joined.groupBy("stack", "layer").agg(F.min_by(F.struct(*kept), F.struct("rmse", "circle_id")).alias("c"))
    return best.select("stack", "layer", "c.*")


def interpolate_along(chain: DataFrame, key: str, height: float, values: Sequence[str]) -> DataFrame:
    """``values`` of each chain at a height: linear between the rows around it, constant beyond the ends."""
    order = W.partitionBy(key).orderBy("h")
    nxt = chain.withColumns({f"__{c}": F.lead(c).over(order) for c in ("h", *values)}).withColumn("__first", F.row_number().over(order) == 1)
    here = F.when(F.col("__first") & (F.col("h") >= height), True).when((F.col("h") <= height) & (F.coalesce("__h", F.lit(float("inf"))) > height), True)
    share = F.when((F.col("h") >= height) | F.col("__h").isNull(), 0.0).otherwise((height - F.col("h")) / (F.col("__h") - F.col("h")))
    at = [(F.col(v) + share * F.coalesce(F.col(f"__{v}") - F.col(v), F.lit(0.0))).alias(v) for v in values]
    return nxt.where(here).select(key, *at)


def stack_table(chain: DataFrame, cfg: SurveyConfig) -> DataFrame:
    """One row per stack, accepted or not: ``stack, n_layers, x, y, stack_diameter, stack_rmse, stack_arc,
    axis_x, axis_y, axis_z, mid_x, mid_y, mid_z, reason`` (``ok, short, tilted, size``).

    The axis is the first principal direction of the centres, upward.
    """
    moments = chain.groupBy("stack").agg(
        F.count(F.lit(1)).alias("n_layers"),
        F.avg("rmse").alias("stack_rmse"),
        F.avg("arc").alias("stack_arc"),
        *[F.avg(c).alias(f"mid_{a}") for a, c in zip("xyz", ("cx", "cy", "h"))],
        *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in (("cx", "cx"), ("cy", "cy"), ("h", "h"), ("cx", "cy"), ("cx", "h"), ("cy", "h"))],
    )
    axis = main_direction(*[F.col(f"c_{n}") for n in ("cx_cx", "cy_cy", "h_h", "cx_cy", "cx_h", "cy_h")])
    up = F.when(F.col("axis.z") < 0, -1.0).otherwise(1.0)
    frame = moments.withColumn("axis", axis).withColumns({f"axis_{a}": F.col(f"axis.{a}") * up for a in "xyz"})
    at = interpolate_along(chain, "stack", cfg.dbh_height, ["r", "cx", "cy"])
    joined = frame.join(at, "stack").withColumn("stack_diameter", 2 * F.col("r"))
    reason = (
        F.when(F.col("n_layers") < cfg.stem_min_layers, "short")
        .when(F.abs("axis_z") < cfg.stem_min_verticality, "tilted")
        .when(~F.col("stack_diameter").between(cfg.stem_min_diameter, cfg.stem_max_diameter), "size")
        .otherwise("ok")
    )
    return joined.select(
        "stack", F.col("n_layers").cast("int").alias("n_layers"), F.col("cx").alias("x"), F.col("cy").alias("y"), "stack_diameter", "stack_rmse", "stack_arc",
        *[f"axis_{a}" for a in "xyz"], *[f"mid_{a}" for a in "xyz"], reason.alias("reason"),
    )


def merge_close(seeds: DataFrame, radius: float, id_col: str = "stack") -> DataFrame:
    """Merge seeds that chains of distances up to ``radius`` connect: the one with most layers stands for all.

    Adds ``merged_into``; of equal seeds the smallest id wins.
    """
    groups = components(seeds.select(F.col(id_col).alias("node")), close_pairs(seeds, radius, id_col))
    keyed = seeds.join(groups.withColumnRenamed("node", id_col), id_col)
    best = keyed.groupBy("root").agg(F.max_by(id_col, F.struct("n_layers", -F.col(id_col))).alias("merged_into"))
    return keyed.join(best, "root").drop("root")


def detect_stems(cloud: DataFrame, cfg: SurveyConfig) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Stems of a cloud (``pid, x, y, z, h``): seeds, their chains, all stacks with reasons, and the points of the stems, ``tree_id, pid``.

    Seeds are numbered by position, so that numbers don't depend on partitions.
    """
    circles, members = layer_circles(cloud, cfg)
    stacks = components(circles.select(F.col("circle_id").alias("node")), link_circles(circles, cfg))
    chain = checkpoint(chains(circles, stacks))
    table = checkpoint(stack_table(chain, cfg))
    merged = merge_close(table.where("reason = 'ok'"), cfg.merge_distance)
    kept = merged.where("stack = merged_into").drop("merged_into", "reason")
    seeds = checkpoint(kept.withColumn("tree_id", (F.row_number().over(W.orderBy("x", "y", "stack")) - 1).cast("int")))
    into = merged.select("stack", F.col("merged_into")).join(seeds.select(F.col("stack").alias("merged_into"), "tree_id"), "merged_into")
    linked = checkpoint(chain.join(into.select("stack", "tree_id", "merged_into"), "stack"))
    return seeds, linked, table, members.join(linked.select("circle_id", "tree_id"), "circle_id").select("tree_id", "pid").distinct()
