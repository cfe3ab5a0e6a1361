"""Figures of the growing graph's steps: no table of pairs, few links between tiles, and the same results."""

import heapq
from functools import partial

import numpy as np
import pytest

from arborlake.kernels import near
from arborlake.operators import graph, neighbours, stems, terrain, tiles
from arborlake.plans import fixtures, lineage, queries
from arborlake.plans.queries import QUERIES

from .conftest import SF


def _brute_labels(at, labels, reach):
    best, queue = {}, [(0.0, int(v), i) for i, v in enumerate(labels) if v >= 0]
    heapq.heapify(queue)
    while queue:
        far, label, i = heapq.heappop(queue)
        if i in best:
            continue
        best[i] = (label, far)
        steps = np.abs(at - at[i])
        for j in np.flatnonzero(steps.max(1) <= reach):
            heapq.heappush(queue, (far + steps[j].sum(), label, int(j)))
    return best


def test_geodesics_of_points_cross_tiles(spark, monkeypatch):
    monkeypatch.setattr(graph, "cut_tiles", partial(tiles.cut_tiles, rows=64))
    rng = np.random.default_rng(3)
    at = np.floor(rng.random((1500, 3)) * [4000, 60, 20])
    labels = np.where(rng.random(len(at)) < 0.02, rng.integers(0, 9, len(at)), -1)
    rows = [(i, int(v) if v >= 0 else None, *map(float, p)) for i, (v, p) in enumerate(zip(labels, at, strict=True))]
    points = spark.createDataFrame(rows, "node long, label long, x double, y double, z double")
    found = {r["node"]: (r["label"], r["dist"]) for r in graph.geodesic_labels_near(points, 20.0).collect()}
    assert found == _brute_labels(at, labels, 20.0)
    assert graph.geodesic_labels_near(points.withColumn("label", points["label"] * None), 20.0).count() == 0


def test_geodesic_query_joins_no_pairs(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a row for each point and cell around it")

    monkeypatch.setattr(neighbours, "neighbour_join", refuse)
    assert QUERIES["geodesic_labels"](spark, SF).count() > 0


def test_cell_parts_over_tiles(spark):
    """Parts that wind through many tiles, each named by its least cell."""
    rng = np.random.default_rng(5)
    cells = {(int(x), int(y)) for x, y in rng.integers(-20, 30, (1700, 2))}
    plain, left = {}, set(cells)
    while left:
        least = min(left)
        stack, part = [least], {least}
        while stack:
            x, y = stack.pop()
            for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if c in left and c not in part:
                    part.add(c)
                    stack.append(c)
        plain |= dict.fromkeys(part, least[0] * (1 << 31) + least[1])
        left -= part
    frame = spark.createDataFrame(sorted(cells), "ix long, iy long")
    for tile in (4, 512):
        assert {(r["ix"], r["iy"]): r["part"] for r in terrain.cell_parts(frame, tile).collect()} == plain
    assert terrain.largest_part(terrain.cell_parts(frame.limit(0))).count() == 0


def test_cells_need_no_rounds_over_all(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("rounds over all cells")

    monkeypatch.setattr(graph, "components", refuse)
    monkeypatch.setattr(terrain, "components", refuse, raising=False)
    assert QUERIES["raster_components"](spark, SF).count() > 0


def test_terrain_reads_the_cloud_once(spark, monkeypatch):
    cloud, made = fixtures.cloud(spark, SF), []
    monkeypatch.setattr(queries.graph, "checkpoint", lambda df: made.append(df.columns) or lineage.checkpoint(df))
    monkeypatch.setattr(queries.terrain, "ground_points", lambda points, cfg: points)
    monkeypatch.setattr(queries.terrain, "build_terrain", lambda ground, points, cfg: points)
    assert QUERIES["terrain_model"](spark, SF).count() == cloud.count()
    assert made == [["pid", "x", "y", "z"]]


def test_edges_both_ways_come_from_tiles(spark, monkeypatch):
    """The same edges as the neighbours of each point and their reverse, and no table of edges stored or dealt again."""
    rng = np.random.default_rng(8)
    at = np.concatenate([np.floor(rng.random((1500, 3)) * [90, 30, 6]) / 10, np.floor(rng.random((300, 3)) * [90, 3, 1])  / 10])
    points = spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(rng.permutation(len(at)), at, strict=True)], "pid long, x double, y double, z double")
    plain = {(r["src"], r["dst"]): r["w"] for r in neighbours.nearest_k(points, 4, 0.25, "pid", scale=(1.0, 1.0, 0.35)).collect()}
    plain |= {(b, a): w for (a, b), w in plain.items()}
    monkeypatch.setattr(graph, "checkpoint", None)
    monkeypatch.setattr(neighbours, "cut_tiles", partial(tiles.cut_tiles, rows=200))
    found = graph.growth_graph(points, 4, 0.25, 0.35).collect()
    assert len(found) == len(plain) and {(r["a"], r["b"]): r["w"] for r in found} == plain


def test_order_of_neighbours_with_ties():
    rng = np.random.default_rng(2)
    i, d, ids = np.sort(rng.integers(5, 200, 9000)), rng.integers(0, 40, 9000) / 100, rng.integers(0, 1 << 40, 9000)
    d[::7] += 1e-13
    np.testing.assert_array_equal(near.in_order(i, d, ids, 0.4), np.lexsort((ids, d, i)))
    assert len(near.in_order(i[:0], d[:0], ids[:0], 0.4)) == 0


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_segmentation_numbers_the_cloud_once(spark, monkeypatch):
    given = []
    monkeypatch.setattr(queries.growth, "segment_trees", lambda points, seeds, cfg: given.extend((points, seeds)) or seeds)
    QUERIES["tree_segmentation"](spark, SF)
    assert len(given) == 2 and not any("Window" in _plan(df) for df in given)


def test_stem_layers_are_thinned_once(spark, monkeypatch):
    class Seen(Exception):
        pass

    def seen(points, *_, **__):
        raise Seen("Aggregate" in _plan(points))

    monkeypatch.setattr(stems, "density_clusters", seen)
    with pytest.raises(Seen) as told:
        QUERIES["stem_detection"](spark, SF)
    assert told.value.args == (False,)
