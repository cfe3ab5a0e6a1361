"""Distance transforms and tiles of rasters against the whole raster in one piece."""

import numpy as np
import pandas as pd
import pytest

from arborlake.config import SurveyConfig
from arborlake.kernels.raster import drop_cloth, moving_median, nearest_known
from arborlake.operators import raster, terrain


def cells_of(spark, grid, x0=0, y0=0):
    at = np.argwhere(~np.isnan(grid))
    return spark.createDataFrame(pd.DataFrame({"ix": at[:, 0] + x0, "iy": at[:, 1] + y0, "v": grid[tuple(at.T)]}), "ix long, iy long, v double")


def as_grid(df, frame, column):
    x0, x1, y0, y1 = frame
    out = np.full((x1 - x0 + 1, y1 - y0 + 1), np.nan)
    rows = df.toPandas()
    assert len(rows) == out.size == len(set(zip(rows["ix"], rows["iy"])))
    out[rows["ix"] - x0, rows["iy"] - y0] = rows[column].astype(float)
    return out


def nearest(grid):
    """By all known cells: least distance, then fewest iy away, smaller iy, smaller ix."""
    known = np.argwhere(~np.isnan(grid))
    far, value = np.empty(grid.shape), np.empty(grid.shape)
    for i, j in np.ndindex(grid.shape):
        d = ((known - (i, j)) ** 2).sum(1)
        best = np.lexsort((known[:, 0], known[:, 1], np.abs(known[:, 1] - j), d))[0]
        far[i, j], value[i, j] = d[best] ** 0.5, grid[tuple(known[best])]
    return value, far


@pytest.mark.parametrize("share", [0.002, 0.05])
@pytest.mark.parametrize("block", [1, 1 << 18])
def test_nearest_fill_over_wide_gaps(spark, monkeypatch, share, block):
    """Few cells, negative indexes, ties, and rows of one or of many to a task."""
    monkeypatch.setattr(raster, "_BLOCK", block)
    rng = np.random.default_rng(int(share * 1000))
    grid = np.where(rng.random((90, 70)) < share, rng.random((90, 70)), np.nan)
    grid[40, 3], grid[40, 9] = 1.0, 2.0
    frame = (-7, 82, 100, 169)
    found = raster.nearest_fill(cells_of(spark, grid, -7, 100), frame)
    value, far = nearest(grid)
    assert np.allclose(as_grid(found, frame, "far"), far)
    assert (as_grid(found, frame, "v") == value).all()
    assert (as_grid(found, frame, "seen") == ~np.isnan(grid)).all()


def test_nearest_fill_without_cells(spark):
    frame = (0, 3, 0, 2)
    found = raster.nearest_fill(cells_of(spark, np.full((4, 3), np.nan)), frame)
    assert found.count() == 12 and found.where("v is null and far is null and not seen").count() == 12
    assert raster.frame_of(cells_of(spark, np.full((1, 1), np.nan))) is None


def test_every_tile_has_its_cells(spark):
    """Two cells in a frame of 40 x 40: tiles far from both are there too."""
    grid = np.full((40, 40), np.nan)
    grid[0, 0] = grid[39, 39] = 1.0
    frame = (0, 39, 0, 39)
    kernel = lambda grids, own: {"v": np.nan_to_num(grids["v"], nan=-1.0)}
    found = raster.on_tiles(cells_of(spark, grid), frame, 8, 3, kernel, ("v",), ("v",))
    assert (as_grid(found, frame, "v") == np.nan_to_num(grid, nan=-1.0)).all()


@pytest.mark.parametrize("margin", [2, 5, 30])
def test_tiles_with_a_margin_of_the_reach(spark, margin):
    rng = np.random.default_rng(margin)
    grid, frame = rng.random((50, 37)), (0, 49, 0, 36)
    kernel = lambda grids, own: {"m": moving_median(np.nan_to_num(grids["v"]), 2 * margin + 1)}
    found = as_grid(raster.on_tiles(cells_of(spark, grid), frame, 8, margin, kernel, ("v",), ("m",)), frame, "m")
    whole = moving_median(grid, 2 * margin + 1)
    inside = (slice(margin, -margin or None),) * 2
    assert (found[inside] == whole[inside]).all() and (found == whole).all()


def two_plots(spark, gap=60.0):
    """A slope with bushes, scanned in two plots far apart."""
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0, 9, 5000), rng.uniform(0, 9, 5000)
    x = np.where(np.arange(5000) % 2 == 0, x, x + gap)
    z = 0.1 * x + 0.3 * np.sin(y) + np.where(rng.random(5000) < 0.2, rng.uniform(0.5, 3, 5000), 0)
    return spark.createDataFrame(pd.DataFrame({"pid": np.arange(5000), "x": x, "y": y, "z": z}))


def test_cloth_and_terrain_do_not_depend_on_tiles(spark):
    cloud = two_plots(spark)
    got = {}
    for name, tiles in (("whole", {"tile_cells": 10_000}), ("tiled", {"tile_cells": 40, "tile_margin": 24}), ("small", {"tile_cells": 24, "tile_margin": 33})):
        cfg = SurveyConfig(csf_iterations=60, **tiles)
        cloth = terrain.cloth_surface(cloud, cfg).toPandas().sort_values(["ix", "iy"], ignore_index=True)
        ground = terrain.ground_points(cloud, cfg)
        model = terrain.build_terrain(ground, cloud, cfg).toPandas().sort_values(["ix", "iy"], ignore_index=True)
        got[name] = cloth, model, ground.count()
    for name in ("tiled", "small"):
        pd.testing.assert_frame_equal(got[name][0], got["whole"][0], check_exact=True)
        pd.testing.assert_frame_equal(got[name][1], got["whole"][1], check_exact=True)
        assert got[name][2] == got["whole"][2] > 3000
    model = got["whole"][1]
    assert len(model) == (model["ix"].max() + 1) * (model["iy"].max() + 1) and model["ix"].max() > 270
    assert model["dtm"].notna().all()
    told = terrain.terrain_stats(spark.createDataFrame(model), 0.25).first()
    assert told.n_cells == len(model) and abs(told.observed_share - model["observed"].mean()) < 1e-12 and 0.05 < told.observed_share < 0.5
    assert told.n_spikes == model["spike"].sum() and told.valid_area_ha > 0.01


def test_cloth_comes_to_rest_in_the_same_turn(spark):
    """Early rest, inside a round of turns and at its end, against the kernel on the whole raster."""
    cloud = two_plots(spark, 20.0)
    for tol, least in ((0.02, 3), (0.05, 8)):
        cfg = SurveyConfig(csf_iterations=80, csf_tol=tol, csf_min_iterations=least, tile_cells=20, tile_margin=15)
        found = terrain.cloth_surface(cloud, cfg)
        turned = cloud.selectExpr("pid", "x", "y", "-z as z")
        cells = terrain.cell_surface(turned, cfg.csf_cloth_res, "max", margin=2 * cfg.csf_cloth_res).toPandas()
        frame = (cells.ix.min() - 2, cells.ix.max() + 2, cells.iy.min() - 2, cells.iy.max() + 2)
        grid = np.full((frame[1] - frame[0] + 1, frame[3] - frame[2] + 1), np.nan)
        grid[cells.ix - frame[0], cells.iy - frame[2]] = cells.v
        want = drop_cloth(nearest_known(grid)[0], cells.v.max() + 1.0, cfg.csf_rigidness, cfg.csf_time_step, cfg.csf_iterations, tol, least)
        assert (as_grid(found, frame, "cloth") == want).all()


def test_no_points(spark):
    cloud, cfg = two_plots(spark).limit(0), SurveyConfig()
    assert terrain.cloth_surface(cloud, cfg).count() == 0
    assert terrain.build_terrain(cloud, cloud, cfg).count() == 0
