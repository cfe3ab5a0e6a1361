"""The frames behind figures and pages: filters, samples, colours, boxes, tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import bilinear


def table_page(trees: DataFrame, qualities: Sequence[str], dbh: tuple[float, float], least_arc: float, sort: str, descending: bool = False, limit: int = 500) -> DataFrame:
    """The rows a user sees: nulls count as zero in filters and come last in either order; ties by id."""
    kept = trees.where(
        F.col("quality").isin(*qualities) & F.coalesce("dbh_cm", F.lit(0.0)).between(*dbh) & (F.coalesce("dbh_arc", F.lit(0.0)) >= least_arc)
    )
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return kept.orderBy(key, "tree_id").limit(limit)


def fixed_sample(points: DataFrame, n: int, id_col: str = "pid", seed: int = 42) -> DataFrame:
    """Exactly ``n`` points, or all: those with the least keyed hash, a top-n that merges from task to task."""
    return points.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(n)


def colour_codes(points: DataFrame, trees: DataFrame) -> DataFrame:
    """Add ``tree_colour`` (1 to 20, 0 without a tree) and ``quality_colour`` (1 to 3, 0 without a tree)."""
    code = F.when(F.col("quality") == "good", 1).when(F.col("quality") == "fair", 2).otherwise(3)
    known = points.join(trees.select("tree_id", "quality"), "tree_id", "left")
    has = F.col("tree_id").isNotNull()
    return known.withColumns(
        {
            "tree_colour": F.when(has, F.pmod("tree_id", F.lit(20)) + 1).otherwise(0).cast("int"),
            "quality_colour": F.when(has, code).otherwise(0).cast("int"),
        }
    ).drop("quality")


def neighbour_box(points: DataFrame, trees: DataFrame, tree_id: int, half: float = 8.0) -> DataFrame:
    """Points of other trees in the box around one tree."""
    centre = trees.where(F.col("tree_id") == tree_id).select(F.col("x").alias("__x"), F.col("y").alias("__y"))
    near = points.where((F.col("tree_id") != tree_id) & F.col("tree_id").isNotNull()).join(F.broadcast(centre))
    inside = (F.abs(F.col("x") - F.col("__x")) < half) & (F.abs(F.col("y") - F.col("__y")) < half)
    return near.where(inside).drop("__x", "__y")


def cross_section(points: DataFrame, y: float, half: float) -> DataFrame:
    return points.where(F.abs(F.col("y") - y) < half)


def evenly_spaced(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Rows at even steps through an order, first and last among them; adds ``place`` (0 up).

    Ranks come from one sort of the table given, which has a row per tree.
    """
    ranked = df.withColumn("place", F.row_number().over(W.orderBy(*order)) - 1).join(F.broadcast(df.agg(F.count(F.lit(1)).alias("__n"))))
    steps = F.least(F.lit(n), F.col("__n").cast("int"))
    picks = F.transform(F.sequence(F.lit(0), steps - 1), lambda i: F.floor(i * (F.col("__n") - 1) / F.greatest(steps - 1, F.lit(1))).cast("int"))
    return ranked.where(F.array_contains(picks, F.col("place"))).drop("__n")


def stratified_folds(df: DataFrame, label: str, order: Sequence[Column | str], folds: int = 5) -> DataFrame:
    """Add ``fold``: rows of each label dealt in turn, in the order given."""
    return df.withColumn("fold", F.pmod(F.row_number().over(W.partitionBy(label).orderBy(*order)) - 1, F.lit(folds)))


def sample_size(asked: int, least: int = 5_000, most: int = 500_000) -> int:
    """The number of points that a figure may show."""
    return max(least, min(most, asked))


def stem_map(trees: DataFrame, colour: str) -> DataFrame:
    """Stems seen from above: ``tree_id, x, y, marker, colour``; trees without a value to colour by are left out."""
    marker = F.greatest(F.lit(5.0), F.least(F.lit(45.0), F.col("dbh_cm"))) * 0.55
    shown = trees.where(F.col(colour).isNotNull())
    return shown.select("tree_id", "x", "y", marker.alias("marker"), F.col(colour).cast("string").alias("colour"))


def ground_section(terrain: DataFrame, y: float, ends: DataFrame, size: float, samples: int = 400) -> DataFrame:
    """The ground along a line of constant ``y``: ``nth, x, ground``, null where it isn't valid all around.

    ``terrain`` has ``ix, iy, dtm, valid``; ``ends`` is one row of ``x_low, x_high`` (the line) and ``x0, y0`` (where the grid starts).
    """
    nth = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("nth")
    line = ends.select(nth, "*").withColumns(
        {"x": F.col("x_low") + F.col("nth") * (F.col("x_high") - F.col("x_low")) / (samples - 1), "y": F.lit(float(y))}
    )
    on = bilinear(line, terrain, size, ["dtm", "valid"], F.col("x0"), F.col("y0"))
    return on.select("nth", "x", F.when(F.col("valid") > 0.99, F.col("dtm")).alias("ground"))


def inventory_histograms(trees: DataFrame, bins: int = 30, arc_bins: int = 25) -> DataFrame:
    """``field, quality, bin, n``: diameters and heights in equal bins over their range, and arcs from 0 to 1 by quality."""
    parts = []
    for field, group, n in (("dbh_cm", None, bins), ("height_m", None, bins), ("dbh_arc", "quality", arc_bins)):
        known = trees.where(F.col(field).isNotNull())
        if group is None:
            ends = known.agg(F.min(field).alias("low"), F.max(field).alias("high"))
        else:
            ends = known.sparkSession.range(1).select(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
        share = F.coalesce(F.try_divide(F.col(field) - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
        at = F.least(F.lit(n - 1).cast("long"), F.floor(share * n))
        named = (F.lit(None).cast("string") if group is None else F.col(group)).alias("quality")
        parts.append(known.join(F.broadcast(ends)).groupBy(F.lit(field).alias("field"), named, at.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, parts)
