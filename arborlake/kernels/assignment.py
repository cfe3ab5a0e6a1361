"""Exact assignment inside one small component of a bipartite graph."""

from __future__ import annotations

import numpy as np


def best_matching(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost; each row and column at most once, all of the shorter side.

    Shortest augmenting paths with potentials, one row at a time.
    """
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        least, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, column, reached = row, -1, 0.0
        while at >= 0:
            gain = reached + c[at] - u[at] - v
            better = ~done & (gain < least)
            least[better], back[better] = gain[better], column
            column = int(np.where(done, np.inf, least).argmin())
            reached = least[column]
            done[column] = True
            at = owner[column]
        u[row] += reached
        for j in np.flatnonzero(done):
            if j != column:
                u[owner[j]] += reached - least[j]
                v[j] -= reached - least[j]
        while column >= 0:
            before = back[column]
            owner[column] = row if before < 0 else owner[before]
            column = before
    pairs = [(int(i), j) for j, i in enumerate(owner) if i >= 0]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)
