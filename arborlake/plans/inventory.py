"""The whole inventory: cloud in, tables out."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SurveyConfig
from ..operators import descriptors, grid, growth, stand, stems, terrain, trees
from ..sources.tables import file_identity
from .lineage import checkpoint
from .status import RunStatus


@dataclass
class Inventory:
    """What a run found. Frames are lazy but cut from their lineage."""

    cloud: DataFrame
    terrain: DataFrame
    seeds: DataFrame
    trees: DataFrame
    features: DataFrame
    summary: DataFrame


def cached_terrain(spark: SparkSession, cloud: DataFrame, cfg: SurveyConfig, folder: str | None, identity: str, force: bool = False) -> DataFrame:
    """The terrain from the cache, or built and put there; the key covers the input and all terrain settings."""
    if folder is None:
        return checkpoint(terrain.terrain_of(cloud, cfg))
    path = f"{folder}/terrain_{cfg.terrain_key(identity)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        terrain.terrain_of(cloud, cfg).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run(
    spark: SparkSession,
    cloud: DataFrame,
    cfg: SurveyConfig | None = None,
    cache: str | None = None,
    identity: str = "",
    groups: int = 4,
    force: bool = False,
    step: Callable[[float, str], None] = lambda progress, message: None,
) -> Inventory:
    """Inventory of a cloud (``pid, x, y, z``). Raises ``ValueError`` when no stem is found. ``step`` is told how far the run is."""
    cfg = cfg or SurveyConfig()
    step(0.02, "noise filter")
    points = checkpoint(grid.remove_isolated(cloud.select("pid", "x", "y", "z"), cfg.noise_voxel, cfg.noise_min_pts))
    step(0.10, "terrain")
    ground = cached_terrain(spark, points, cfg, cache, identity, force)
    high = checkpoint(terrain.with_heights(points, ground, cfg))
    step(0.35, "stems")
    seeds, _, _, members = stems.detect_stems(high.where("h is not null"), cfg)
    if seeds.isEmpty():
        raise ValueError("no stems found: check stem heights, diameters and point density")
    step(0.50, "trees")
    own = members.groupBy("pid").agg(F.min("tree_id").alias("tree_id"))
    labelled = checkpoint(growth.segment_trees(high, high.join(own, "pid"), cfg))
    step(0.70, "measures")
    table = trees.measure_trees(labelled.where("tree_id is not null"), seeds, cfg)
    scanner = grid.densest_cell(points).select(F.col("x").alias("__sx"), F.col("y").alias("__sy"))
    far = F.hypot(F.col("x") - F.col("__sx"), F.col("y") - F.col("__sy"))
    table = checkpoint(table.join(F.broadcast(scanner)).withColumn("dist_from_scan_centre_m", far).drop("__sx", "__sy"))
    step(0.85, "descriptors and groups")
    features = checkpoint(descriptors.feature_table(labelled.where("tree_id is not null"), table))
    table = checkpoint(table.join(stand.structural_groups(features, table, groups), "tree_id", "left"))
    area = terrain.terrain_stats(ground, cfg.dtm_res).first()["valid_area_ha"]
    return Inventory(labelled, ground, seeds, table, features, stand.stand_summary(table, stand.stand_area_ha(table), area))


def write_outputs(found: Inventory, folder: str, labelled_cloud: bool = True) -> None:
    """Tables as CSV and Parquet, and the labelled cloud as LAS."""
    for name, df in (("trees", found.trees), ("tree_features", found.features), ("summary", found.summary)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    if labelled_cloud:
        from ..sources.las import register

        register(found.cloud.sparkSession)
        cloud = found.cloud.where("tree_id is not null").select("x", "y", "z", F.col("tree_id").cast("long"), F.col("h").cast("float").alias("height_norm"))
        cloud.write.format("las").mode("overwrite").option("path", f"{folder}/labelled_las").save()


def main(argv: list[str] | None = None) -> None:
    from ..sources.las import register

    ask = argparse.ArgumentParser(description="Tree inventory of a LAS cloud")
    ask.add_argument("las")
    ask.add_argument("--out", default="outputs")
    ask.add_argument("--cache")
    ask.add_argument("--groups", type=int, default=4)
    ask.add_argument("--force", action="store_true")
    args = ask.parse_args(argv)
    spark = SparkSession.builder.appName("arborlake").getOrCreate()
    register(spark)
    cloud = spark.read.format("las").option("path", args.las).load()
    cfg = SurveyConfig(las_path=args.las, out_dir=args.out)
    with RunStatus(spark, f"{args.out}/status") as status:
        found = run(spark, cloud, cfg, args.cache, file_identity(spark, args.las), args.groups, args.force, status.step)
        status.step(0.95, "outputs")
        write_outputs(found, args.out)
        status.done(f"{found.trees.count()} trees")
    found.summary.show(vertical=True)


if __name__ == "__main__":
    main()
