"""Stand figures: area, summary, groups."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.hull import hull_2d, polygon
from ..plans.lineage import checkpoint
from .descriptors import medians
from .kmeans import best_centres, nearest_centre


def _corners(batches):
    """The hull of each batch's points; a hull of hulls is the hull of all."""
    for batch in batches:
        p = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        c = hull_2d(p) if len(p) else p.reshape(0, 2)
        yield pa.RecordBatch.from_arrays([pa.array(c[:, 0], pa.float64()), pa.array(c[:, 1], pa.float64())], names=["x", "y"])


def hull_corners(points: DataFrame) -> np.ndarray:
    """Corners of the convex hull of ``x, y``: each task sends only its own hull's corners."""
    own = points.select("x", "y").where("x is not null and y is not null").mapInArrow(_corners, "x double, y double")
    return hull_2d(np.array([(r.x, r.y) for r in own.toLocalIterator()]).reshape(-1, 2))


def stand_area_ha(trees: DataFrame) -> float:
    """Area under trees: the hull of the stems that aren't poor, widened by half a crown radius.

    With fewer than three such stems all count; stems in line have the area of their bounds.
    """
    fine = trees.where("quality <> 'poor'")
    used = fine if fine.limit(3).count() == 3 else trees
    wide = trees.agg(F.median("crown_diameter_m")).first()[0]
    buffer = 1.5 if wide is None else wide / 4
    corners = hull_corners(used)
    if len(corners) < 3:
        r = used.agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
        return (r.w or 0.0) * (r.h or 0.0) / 1e4
    area, around = polygon(corners)
    return (area + around * buffer + math.pi * buffer * buffer) / 1e4


def stand_summary(trees: DataFrame, area_ha: float, dtm_area_ha: float | None = None) -> DataFrame:
    """One row of stand figures, from a single aggregation."""
    usable, good = F.col("quality").isin("good", "fair"), F.col("quality") == "good"
    both = F.col("dbh_cm").isNotNull() & F.col("height_m").isNotNull()

    def corr(on):
        n = F.count_if(both & on)
        return F.when(n > 3, F.corr(F.when(both & on, F.col("dbh_cm")), F.when(both & on, F.col("height_m"))))

    area = F.lit(float(area_ha))
    return trees.agg(
        F.lit(dtm_area_ha).cast("double").alias("dtm_area_ha"),
        area.alias("stand_area_ha"),
        F.count(F.lit(1)).alias("n_trees"),
        *[F.count_if(F.col("quality") == q).alias(f"n_{q}") for q in ("good", "fair", "poor")],
        (F.count(F.lit(1)) / area).alias("stems_ha"),
        (F.count_if(usable) / area).alias("stems_usable_ha"),
        F.avg(F.when(usable, F.col("dbh_cm"))).alias("dbh_mean_cm"),
        F.median(F.when(usable, F.col("dbh_cm"))).alias("dbh_median_cm"),
        F.avg(F.when(good, F.col("dbh_cm"))).alias("dbh_good_mean_cm"),
        F.avg(F.when(usable, F.col("height_m"))).alias("height_mean_m"),
        F.median(F.when(usable, F.col("height_m"))).alias("height_median_m"),
        (F.sum(F.when(usable, F.col("basal_area_m2"))) / area).alias("basal_area_m2_ha"),
        corr(F.lit(True)).alias("height_dbh_corr"),
        corr(good).alias("height_dbh_corr_good"),
    )


def range_by_quality(trees: DataFrame) -> DataFrame:
    return trees.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.median("dist_from_scan_centre_m").alias("median_range_m"))


def group_profile(trees: DataFrame) -> DataFrame:
    """Size and rounded medians of each structural group; trees without a group are left out."""
    names = ("dbh_cm", "height_m", "crown_diameter_m", "crown_base_m", "h_d_ratio")
    grouped = trees.where("structural_group is not null").groupBy("structural_group")
    return grouped.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.median(c), 2).alias(c) for c in names])


def structural_groups(features: DataFrame, trees: DataFrame, k: int = 4, seed: int = 42, restarts: int = 20, keep: float = 0.95) -> DataFrame:
    """``tree_id, structural_group`` of the trees that aren't poor, by k-means on the main components, the best of ``restarts`` starts.

    Missing descriptors take the median. Groups are numbered by median height, so that numbers
    mean the same in each run. Fewer trees than groups give nulls.
    """
    fine = features.join(trees.where("quality <> 'poor'").select("tree_id"), "tree_id", "left_semi").drop("n_points")
    names = [c for c in fine.columns if c != "tree_id"]
    fine = checkpoint(fine)
    filled = fine.na.fill(medians(fine, names)).coalesce(min(8, fine.sparkSession.sparkContext.defaultParallelism))
    if filled.count() < k:
        return trees.select("tree_id", F.lit(None).cast("int").alias("structural_group"))
    vectors = VectorAssembler(inputCols=names, outputCol="raw").transform(filled)
    scaled = StandardScaler(inputCol="raw", outputCol="std", withMean=True).fit(vectors).transform(vectors)
    found = PCA(k=len(names), inputCol="std", outputCol="all").fit(scaled)
    explained = np.cumsum(found.explainedVariance.toArray())
    n = int(np.searchsorted(explained, keep) + 1)
    main = F.slice(vector_to_array("all"), 1, min(n, len(names)))
    ready = checkpoint(found.transform(scaled).select(F.col("tree_id").cast("long").alias("id"), "tree_id", "height_m", main.alias("features")))
    centres, _ = best_centres(ready.select("id", "features"), k, restarts, seed)
    labelled = checkpoint(nearest_centre(ready, centres).select("tree_id", "height_m", "prediction"))
    order = labelled.groupBy("prediction").agg(F.median("height_m").alias("m")).orderBy("m", "prediction").collect()
    number = F.create_map(*[F.lit(x) for i, r in enumerate(order) for x in (r["prediction"], i)])
    return trees.select("tree_id").join(labelled.select("tree_id", number[F.col("prediction")].alias("structural_group")), "tree_id", "left")
