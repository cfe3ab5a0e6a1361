"""From stems to whole trees: labels spread from stems through a graph of near points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SurveyConfig
from ..plans.lineage import checkpoint
from .graph import geodesic_labels, growth_graph
from .grid import thin
from .neighbours import nearest_one


#: Metres of the tiles that paths are followed in by one task.
_TILE = 5.0


def seed_nodes(nodes: DataFrame, seed_points: DataFrame, radius: float) -> DataFrame:
    """``node, label``: the node nearest each stem point; a node near several stems goes to the smallest."""
    near = nearest_one(seed_points, nodes.withColumnRenamed("pid", "nid"), radius, "pid", "nid")
    return near.where("nid is not null").groupBy(F.col("nid").alias("node")).agg(F.min("tree_id").alias("label"))


def segment_trees(cloud: DataFrame, seed_points: DataFrame, cfg: SurveyConfig) -> DataFrame:
    """Add ``tree_id`` to a cloud (``pid, x, y, z, h``): null where no stem is near along the graph.

    ``seed_points`` are the stems' points with ``tree_id``. Points lower than the least vegetation
    height have no tree. A point takes its voxel's nearest labelled node, up to three voxels away.
    """
    high = checkpoint(cloud.where(F.col("h") > cfg.veg_min_height))
    nodes = checkpoint(thin(high, cfg.seg_voxel).select("pid", "x", "y", "z"))
    edges = growth_graph(nodes, cfg.graph_k, cfg.graph_max_edge, cfg.graph_z_weight)
    seeds = seed_nodes(nodes, seed_points.select("pid", "x", "y", "z", "tree_id"), cfg.seg_voxel * 3**0.5)
    tiles = [F.floor(F.col(a) / _TILE).cast("long") for a in "xy"]
    labels = geodesic_labels(edges, seeds, nodes.select(F.col("pid").alias("node"), F.xxhash64(*tiles).alias("part")))
    labelled = nodes.join(labels.select(F.col("node").alias("pid"), F.col("label").alias("tree_id")), "pid").withColumnRenamed("pid", "nid")
    found = nearest_one(high.select("pid", "x", "y", "z"), labelled, 3 * cfg.seg_voxel, "pid", "nid", carry=["tree_id"])
    return cloud.join(found.select("pid", "tree_id"), "pid", "left")
