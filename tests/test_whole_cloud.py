"""Queries without SQL must hand the whole cloud to their operator, whatever the tree ids."""

import pytest
from pyspark.sql import functions as F

from arborlake.plans import fixtures as fx
from arborlake.plans import queries as q

from .conftest import SF

ROLES = {"cloth_ground": "true", "terrain_model": "true", "stem_detection": "true", "tree_segmentation": "role <> 'ground'"}


@pytest.mark.parametrize("name", sorted(ROLES))
def test_reads_every_tree(spark, tmp_path, monkeypatch, name):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.withColumn("l_suppkey", F.col("l_suppkey") + 200).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(q.terrain, "ground_points", lambda points, cfg: points)
    monkeypatch.setattr(q.terrain, "build_terrain", lambda ground, points, cfg: points)
    monkeypatch.setattr(q.stems, "detect_stems", lambda points, cfg: (points,))
    monkeypatch.setattr(q.growth, "segment_trees", lambda points, seeds, cfg: points.join(seeds.select("pid", "tree_id"), "pid", "left"))
    handed = q.QUERIES[name](spark, str(tmp_path))
    whole = fx.cloud(spark, str(tmp_path)).where(ROLES[name])
    assert handed.count() == whole.count() > 0
    if name == "tree_segmentation":
        seeds = whole.where("h between 0.6 and 2.6").count()
        assert handed.where("tree_id is not null").count() == seeds > 0
