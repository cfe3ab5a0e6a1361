"""Raster steps on one tile, in NumPy. Null cells are NaN."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Fixed value: the published method's.
GRAVITY = 9.8


def nearest_along(reach: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The second pass of a distance transform, along the last axis: least sum of squares, and the value it comes from.

    ``reach`` is the squared distance that each cell knows across the lines, infinite for none. Of equal sums
    the one from the nearest column is taken, then that of the smaller.
    """
    n = reach.shape[1]
    best, filled = reach.copy(), value.copy()
    for d in range(1, n):
        if d * d >= best.max():
            break
        for to, of in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
            far = reach[:, of] + d * d
            nearer = far < best[:, to]
            best[:, to] = np.where(nearer, far, best[:, to])
            filled[:, to] = np.where(nearer, value[:, of], filled[:, to])
    return best, filled


def nearest_known(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fill unknown cells from the nearest known cell, and the distance to it in cells (infinite without any).

    First the nearest known cell in each column, then the least sum of squares over columns.
    """
    known = ~np.isnan(grid)
    nx, ny = grid.shape
    rows = np.arange(nx)[:, None]
    above = np.maximum.accumulate(np.where(known, rows, -(10**7)), axis=0)
    below = np.minimum.accumulate(np.where(known, rows, 10**7)[::-1], axis=0)[::-1]
    pick = np.where(rows - above <= below - rows, above, below)
    reach = np.abs(pick - rows).astype(float) ** 2
    value = np.take_along_axis(np.where(known, grid, 0.0), np.clip(pick, 0, nx - 1), 0)
    best, filled = nearest_along(np.where(reach > 1e12, np.inf, reach), value)
    lost = np.isinf(best)
    return np.where(lost, np.nan, filled), np.sqrt(best)


def fall(surface: np.ndarray, cloth: np.ndarray, last: np.ndarray, loose: np.ndarray, turns: int, rigidness: int, time_step: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The cloth, the cloth before and which nodes are loose after each turn: nodes fall until they touch, springs even
    out the rest. A turn carries what happens ``rigidness`` cells far."""
    drop = GRAVITY * time_step**2
    sides = np.pad(np.ones(surface.shape), 1)
    around = [(slice(0, -2), slice(1, -1)), (slice(2, None), slice(1, -1)), (slice(1, -1), slice(0, -2)), (slice(1, -1), slice(2, None))]
    degree = np.maximum(sum(sides[a] for a in around), 1)
    for _ in range(turns):
        fallen = np.where(loose, 2 * cloth - last - drop, cloth)
        last, touching = cloth, fallen < surface
        cloth = np.maximum(fallen, surface)
        loose = loose & ~touching
        for _ in range(rigidness):
            heights, free = np.pad(cloth, 1, mode="edge"), np.pad(loose, 1)
            pull = sum(sides[a] * np.where(free[a], 0.5, 1.0) * (heights[a] - cloth) for a in around)
            cloth = np.maximum(np.where(loose, cloth + pull / degree, cloth), surface)
        yield cloth, last, loose


def drop_cloth(surface: np.ndarray, top: float, rigidness: int, time_step: float, rounds: int, tol: float, least_rounds: int) -> np.ndarray:
    """A cloth that falls from ``top`` onto a surface, until it moves less than ``tol`` anywhere."""
    cloth = np.full(surface.shape, top)
    for turn, (cloth, last, _) in enumerate(fall(surface, cloth, cloth.copy(), np.ones(surface.shape, bool), rounds, rigidness, time_step)):
        if turn > least_rounds and np.abs(cloth - last).max() < tol:
            break
    return cloth


def moving_median(grid: np.ndarray, window: int) -> np.ndarray:
    """Median of the square around each cell; the border repeats its last cells."""
    half = window // 2
    padded = np.pad(grid, half, mode="edge")
    out = np.empty_like(grid)
    for i in range(0, len(grid), 16):
        strip = np.lib.stride_tricks.sliding_window_view(padded[i : i + 16 + 2 * half], (window, window))
        flat = strip.reshape(*strip.shape[:2], -1)
        out[i : i + 16] = np.partition(flat, flat.shape[-1] // 2, axis=-1)[..., flat.shape[-1] // 2]
    return out


def smooth(grid: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, cut at four deviations; the border mirrors."""
    reach = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    taps /= taps.sum()
    for axis in (0, 1):
        pad = [(reach, reach) if a == axis else (0, 0) for a in (0, 1)]
        padded = np.pad(grid, pad, mode="symmetric")
        n = grid.shape[axis]
        grid = sum(t * np.take(padded, np.arange(k, k + n), axis) for k, t in enumerate(taps))
    return grid
