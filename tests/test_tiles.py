"""Tiles that follow the points, and neighbours found in them, against all pairs."""

import numpy as np
import pandas as pd
import pytest

from arborlake.kernels import near
from arborlake.operators import graph, neighbours
from arborlake.operators.tiles import cut_tiles, dealt


def scene(seed=1, n=3000):
    """A dense stem, a sparse plain, points on a line, and points at one place."""
    rng = np.random.default_rng(seed)
    dense = rng.normal([5, 5, 1], [0.03, 0.03, 1], (n // 2, 3))
    plain = rng.uniform([0, 0, 0], [40, 40, 3], (n // 3, 3))
    line = np.column_stack([np.arange(n // 10) * 0.0625, np.full(n // 10, 20.0), np.zeros(n // 10)])
    same = np.full((40, 3), 30.0)
    return np.concatenate([dense, plain, line, same])


def frame(spark, at, **more):
    columns = {"pid": np.arange(len(at))[::-1].copy(), **{a: at[:, i] for i, a in enumerate("xyz")}, **more}
    return spark.createDataFrame(pd.DataFrame(columns))


def distances(at, other):
    d = at[:, None] - other[None]
    return np.sqrt(d[..., 0] ** 2 + d[..., 1] ** 2 + (d[..., 2] ** 2 if at.shape[1] > 2 else 0))


def plain_nearest(ids, d, other_ids, k, radius, same):
    out = {}
    for i, row in enumerate(d):
        order = np.lexsort((other_ids, row))
        out[int(ids[i])] = [int(other_ids[j]) for j in order if row[j] <= radius and not (same and ids[i] == other_ids[j])][:k]
    return out


@pytest.fixture
def small_tiles(monkeypatch):
    for module in (neighbours, graph):
        monkeypatch.setattr(module, "cut_tiles", lambda p, axes, halo: cut_tiles(p, axes, halo, rows=150))


def test_tiles_are_even_and_own_each_point_once(spark):
    rng = np.random.default_rng(2)
    at = np.concatenate([rng.normal([0, 0, 0], 0.5, (30_000, 3)), rng.uniform(-50, 50, (10_000, 3))])
    points = frame(spark, at)
    tiles = cut_tiles(points, "xyz", 0.01, rows=2000)
    own = dealt(points, tiles, 0.01).where("own").groupBy("tile").count().toPandas()["count"]
    assert own.sum() == len(at) and tiles.count == len(own) >= 16
    assert own.max() <= 2 * own.median()


def test_halos_hold_all_near_points(spark):
    at = scene()
    tiles = cut_tiles(frame(spark, at), "xyz", 0.2, rows=150)
    assert tiles.count > 5
    rows, tile, own = tiles.place(at, 0.2 * (1 + 1e-6))
    seen = {t: set(rows[tile == t].tolist()) for t in np.unique(tile)}
    home = dict(zip(rows[own].tolist(), tile[own].tolist(), strict=True))
    for i, j in zip(*np.nonzero(distances(at, at) <= 0.2), strict=True):
        assert j in seen[home[i]]


@pytest.mark.parametrize("radius", [0.0625, 0.5, 4.0])
def test_nearest_k(spark, small_tiles, radius):
    at = scene()
    points = frame(spark, at)
    ids = np.arange(len(at))[::-1]
    want = plain_nearest(ids, distances(at, at), ids, 7, radius, True)
    found = neighbours.nearest_k(points, 7, radius, "pid", scale=(1, 1, 0.5)).toPandas().sort_values(["src", "dist", "dst"])
    assert found.groupby("src")["dst"].apply(list).to_dict() == {i: j for i, j in want.items() if j}
    step = at[ids[found["src"]]] - at[ids[found["dst"]]]
    assert np.allclose(found["w"], np.sqrt(step[:, 0] ** 2 + step[:, 1] ** 2 + (step[:, 2] * 0.5) ** 2))


def test_nearest_one_keeps_all_rows(spark, small_tiles):
    at, other = scene(), scene(9, 300)
    left, right = frame(spark, at, note=[f"n{i}" for i in range(len(at))]), frame(spark, other, label=np.arange(len(other)) % 5).withColumnRenamed("pid", "nid")
    found = neighbours.nearest_one(left, right, 0.3, "pid", "nid", carry=["label"]).toPandas()
    ids, other_ids = np.arange(len(at))[::-1], np.arange(len(other))[::-1]
    d = distances(at, other)
    want = plain_nearest(ids, d, other_ids, 1, 0.3, False)
    assert len(found) == len(at) and list(found.columns) == ["pid", "x", "y", "z", "note", "nid", "label", "dist"]
    for r in found.itertuples():
        near_id = want[r.pid][0] if want[r.pid] else None
        assert (pd.isna(r.nid) if near_id is None else r.nid == near_id and r.label == other_ids[near_id] % 5)
    assert neighbours.nearest_one(left, right.limit(0), 0.3, "pid", "nid").where("nid is null and dist is null").count() == len(at)
    assert neighbours.nearest_one(left.limit(0), right, 0.3, "pid", "nid").count() == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_density_clusters(spark, small_tiles, monkeypatch, few):
    """Chains across many tiles, border points between clusters, groups of a nullable key; both ways to join tiles."""
    monkeypatch.setattr(graph, "_FEW_LINKS", few)
    at = scene()
    at[:, 2] = 0
    layer = np.where(np.arange(len(at)) % 3 == 0, None, np.arange(len(at)) % 2)
    points = spark.createDataFrame([(int(i), float(x), float(y), None if k is None else int(k)) for i, (x, y, _), k in zip(np.arange(len(at))[::-1], at, layer, strict=True)], "pid long, x double, y double, layer int")
    found = graph.density_clusters(points, 0.3, 4, keys=["layer"]).toPandas()
    assert len(found) == len(at)
    got = {r.pid: (r.core, None if pd.isna(r.cluster) else int(r.cluster)) for r in found.itertuples()}
    ids = np.arange(len(at))[::-1]
    for k in (None, 0, 1):
        rows = np.flatnonzero([x == k if k is not None else x is None for x in layer])
        linked = distances(at[rows, :2], at[rows, :2]) <= 0.3
        core = linked.sum(1) >= 4
        a, b = np.nonzero(linked & core[:, None] & core[None])
        order = np.argsort(ids[rows])
        place = np.argsort(order)
        root = order[near.components(len(rows), place[a], place[b])[place]]
        for i, row in enumerate(rows):
            touching = [ids[rows[root[j]]] for j in np.flatnonzero(linked[i] & core)]
            name = ids[rows[root[i]]] if core[i] else min(touching, default=None)
            assert got[ids[row]] == (core[i], name)


def test_cells_far_apart():
    """Few points over a wide space, where cells are more than fit in 64 bits."""
    at = np.array([[0.0, 0, 0], [1e7, 1e7, 1e7], [1e7, 1e7, 1e7 + 0.005], [-1e7, 5, 5]])
    pairs = {(int(i), int(j)) for i, j, _ in ((a, b, c) for x in near.Cells(at, 0.01).pairs(at) for a, b, c in zip(*x, strict=True))}
    assert pairs == {(0, 0), (1, 1), (2, 2), (3, 3), (1, 2), (2, 1)}


def test_density_finds_pairs_once(monkeypatch):
    """Pairs are searched once where few are kept, and step by step where they are more: with the same clusters."""
    rng = np.random.default_rng(8)
    at, group, ids = rng.uniform(0, 3, (600, 2)), rng.integers(0, 2, 600), rng.permutation(600)
    rows = np.flatnonzero(rng.uniform(size=600) < 0.7)
    searches, whole = [], near.Cells.pairs
    monkeypatch.setattr(near.Cells, "pairs", lambda self, *a, **k: searches.append(1) or whole(self, *a, **k))
    core, name, touching, touched = near.density_clusters(at, group, ids, 0.15, 4, rows)
    assert len(searches) == 1
    monkeypatch.setattr(near, "KEPT", 100)
    again = near.density_clusters(at, group, ids, 0.15, 4, rows)
    assert len(searches) == 4 and all(np.array_equal(a, b) for a, b in zip((core, name, touching, touched), again, strict=True))
    linked = (np.linalg.norm(at[:, None] - at[None], axis=2) <= 0.15) & (group[:, None] == group[None])
    assert (core == (linked.sum(1) >= 4)).all() and 0 < core.sum() < 600
    a, b = np.nonzero(linked & core[:, None] & core[None])
    order = np.argsort(ids)
    place = np.argsort(order)
    named = ids[order[near.components(600, place[a], place[b])[place]]]
    assert (name == named[core]).all()
    told = {(i, n) for i in rows if not core[i] for n in named[linked[i] & core]}
    assert told == set(zip(touching.tolist(), touched.tolist(), strict=True)) and len(touching) == len(told) > 0
    empty = near.density_clusters(at[:0], group[:0], ids[:0], 0.15, 4, rows[:0])
    assert [len(x) for x in empty] == [0, 0, 0, 0]
