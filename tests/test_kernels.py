"""Kernels and geometry against closed forms and brute force."""

from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborlake.kernels.assignment import best_matching
from arborlake.kernels.circle import arc_share, best_circle, robust_fit, through_three, votes
from arborlake.kernels.hull import hull_2d, hull_volume, polygon
from arborlake.kernels.raster import drop_cloth, moving_median, nearest_known, smooth


@pytest.mark.parametrize("r", [0.05, 0.15, 0.4])
@pytest.mark.parametrize("arc", [1.0, 0.5])
def test_circle_from_noise(r, arc):
    rng = np.random.default_rng(3)
    a = rng.uniform(0, 2 * np.pi * arc, 150)
    p = np.column_stack((1 + r * np.cos(a), 2 + r * np.sin(a))) + rng.normal(0, 0.002, (150, 2))
    p = np.vstack((p, rng.uniform(0, 3, (30, 2))))
    fit = best_circle(p, 0.02, 300, 0.02, 0.75, seed=1)
    assert abs(fit.r - r) < 0.005
    assert abs(fit.x - 1) < 0.01 and abs(fit.y - 2) < 0.01
    assert abs(arc_share(p[fit.inside], fit.x, fit.y) - arc) < 0.15


def test_circle_needs_points():
    assert best_circle(np.zeros((7, 2)), 0.02, 10, 0.02, 1, 0) is None
    assert best_circle(np.column_stack((np.arange(20.0), np.zeros(20))), 0.02, 50, 0.02, 1, 0) is None


def test_votes_in_slices(monkeypatch):
    rng = np.random.default_rng(5)
    p, circles = rng.uniform(-1, 1, (500, 2)), rng.uniform(0, 1, (7, 3))
    whole = [(np.abs(np.hypot(p[:, 0] - x, p[:, 1] - y) - r) < 0.05).sum() for x, y, r in circles]
    monkeypatch.setattr("arborlake.kernels.circle._DISTANCES", 70)
    assert votes(p, circles, 0.05).tolist() == whole


def test_three_points_and_refinement():
    p = np.array([[1.0, 0], [0, 1], [-1, 0]])
    x, y, r = through_three(p[:1], p[1:2], p[2:])
    assert np.allclose((x[0], y[0], r[0]), (0, 0, 1))
    a = np.linspace(0, 6, 40)
    q = np.column_stack((np.cos(a), np.sin(a)))
    assert np.allclose(robust_fit(q, 0.1, -0.1, 0.8), (0, 0, 1, 0), atol=1e-6)
    assert arc_share(q[:0], 0, 0) == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(3, 40), st.integers(0, 10**6))
def test_hull_holds_all_points(n, seed):
    p = np.random.default_rng(seed).integers(-20, 20, (n, 2)).astype(float)
    c = hull_2d(p)
    if len(c) >= 3:
        nxt = np.roll(c, -1, axis=0)
        for q in p:
            side, to = nxt - c, q - c
            assert (side[:, 0] * to[:, 1] - side[:, 1] * to[:, 0] >= -1e-9).all()
        assert polygon(c)[0] > 0


def test_hull_volumes():
    box = np.array([[x, y, z] for x in (0, 2) for y in (0, 3) for z in (0, 4)], float)
    inner = np.random.default_rng(0).uniform(0.1, 1.9, (200, 3))
    assert np.isclose(hull_volume(np.vstack((box, inner))), 24)
    flat = np.column_stack((np.random.default_rng(1).uniform(size=(20, 2)), np.zeros(20)))
    assert hull_volume(flat) is None
    ball = np.random.default_rng(2).normal(size=(1500, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    assert 0.97 * 4 / 3 * np.pi < hull_volume(ball) < 4 / 3 * np.pi


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 30, (n, m)).astype(float)
    pairs = best_matching(cost)
    assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
    small, large = (cost, (n, m)) if n <= m else (cost.T, (m, n))
    best = min(sum(small[i, j] for i, j in enumerate(p)) for p in permutations(range(large[1]), large[0]))
    assert np.isclose(sum(cost[i, j] for i, j in pairs), best)


def test_nearest_known_matches_brute_force():
    rng = np.random.default_rng(5)
    grid = np.where(rng.random((17, 23)) < 0.1, rng.random((17, 23)), np.nan)
    filled, far = nearest_known(grid)
    known = np.argwhere(~np.isnan(grid))
    for i in range(17):
        for j in range(23):
            d = np.hypot(*(known - (i, j)).T)
            assert np.isclose(far[i, j], d.min())
            assert filled[i, j] in grid[tuple(known[np.isclose(d, d.min())].T)]
    assert np.isinf(nearest_known(np.full((3, 3), np.nan))[1]).all()


def test_raster_filters():
    flat = np.full((30, 30), 2.0)
    assert np.allclose(smooth(flat, 1.0), 2) and np.allclose(moving_median(flat, 5), 2)
    spike = flat.copy()
    spike[10, 10] = 9
    assert moving_median(spike, 5)[10, 10] == 2


def test_cloth_rests_on_a_plane():
    x, y = np.meshgrid(np.arange(40.0), np.arange(30.0), indexing="ij")
    plane = 0.02 * x + 0.01 * y
    cloth = drop_cloth(plane, plane.max() + 1, 3, 0.65, 500, 0.005, 20)
    assert (cloth >= plane - 1e-9).all() and np.abs(cloth - plane).max() < 0.05
