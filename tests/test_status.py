"""Runs that tell how far they are, and inputs told apart from edited ones of the same name."""

import os

import pytest

from arborlake.config import SurveyConfig
from arborlake.plans import inventory
from arborlake.plans.status import RunStatus, run_states
from arborlake.sources.tables import file_identity


def state(spark, folder):
    return {r.run_id: (r.state, r.progress, r.message, r.error) for r in run_states(spark, folder).collect()}


def test_states_of_runs(spark, tmp_path):
    folder = f"{tmp_path}/status"
    run = RunStatus(spark, folder, "first")
    assert state(spark, folder) == {"first": ("queued", 0.0, "queued", None)}
    with run:
        run.step(0.3, "terrain")
        assert state(spark, folder)["first"] == ("running", 0.3, "terrain", None)
        assert spark.getTags() == {"first"}
        run.done("7 trees")
    assert state(spark, folder)["first"] == ("done", 1.0, "7 trees", None) and spark.getTags() == set()
    with pytest.raises(ValueError), RunStatus(spark, folder, "second") as other:
        other.step(0.4, "stems")
        raise ValueError("no stems found")
    assert state(spark, folder)["second"] == ("error", 0.4, "failed", "ValueError: no stems found")
    assert len(state(spark, folder)) == 2


def test_an_edited_file_rebuilds_the_terrain(spark, tmp_path, monkeypatch):
    path, built = tmp_path / "cloud.las", []
    path.write_bytes(b"a" * 100)
    monkeypatch.setattr(inventory.terrain, "terrain_of", lambda cloud, cfg: built.append(1) or cloud)
    cloud, cfg = spark.range(3), SurveyConfig()
    cached = lambda: inventory.cached_terrain(spark, cloud, cfg, f"{tmp_path}/cache", file_identity(spark, str(path)))
    assert cached().count() == cached().count() == 3 and len(built) == 1
    path.write_bytes(b"b" * 101)
    assert cached().count() == 3 and len(built) == 2
    os.utime(path, (1, 1))
    cached()
    assert len(built) == 3
    assert file_identity(spark, str(tmp_path)).count("cloud.las") == 1
