"""Convex hulls of one group's points, in NumPy."""

from __future__ import annotations

import numpy as np


def hull_2d(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise; fewer than three when the points lie in line."""
    p = np.unique(np.asarray(p, float), axis=0)
    if len(p) < 3:
        return p

    def turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
        return float((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))

    def chain(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and turn(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def polygon(corners: np.ndarray) -> tuple[float, float]:
    """Area and perimeter."""
    if len(corners) < 3:
        return 0.0, 0.0
    nxt = np.roll(corners, -1, axis=0)
    area = 0.5 * abs(float(np.sum(corners[:, 0] * nxt[:, 1] - nxt[:, 0] * corners[:, 1])))
    return area, float(np.hypot(*(nxt - corners).T).sum())


def hull_faces(p: np.ndarray) -> np.ndarray | None:
    """Triangles of the convex hull in space, as rows of three indices of ``p``; None for points in a plane.

    Starts from a wide tetrahedron and adds the point furthest outside until none is outside, so it takes
    a step for each corner, not for each point.
    """
    if len(p) < 4:
        return None
    size = float(np.ptp(p, axis=0).max())
    eps = 1e-10 * max(size, 1e-9)
    a = int(p[:, 0].argmin())
    b = int(((p - p[a]) ** 2).sum(1).argmax())
    c = int((np.cross(p - p[a], p[b] - p[a]) ** 2).sum(1).argmax())
    normal = np.cross(p[b] - p[a], p[c] - p[a])
    high = (p - p[a]) @ normal
    d = int(np.abs(high).argmax())
    if abs(high[d]) <= eps * max(np.linalg.norm(normal), 1e-30):
        return None
    middle = p[[a, b, c, d]].mean(0)

    def outward(faces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Faces turned so that their normals point away from the middle, the normals and their heights."""
        n = np.cross(p[faces[:, 1]] - p[faces[:, 0]], p[faces[:, 2]] - p[faces[:, 0]])
        n /= np.maximum(np.linalg.norm(n, axis=1), 1e-300)[:, None]
        inward = ((middle - p[faces[:, 0]]) * n).sum(1) > 0
        faces = np.where(inward[:, None], faces[:, ::-1], faces)
        n = np.where(inward[:, None], -n, n)
        return faces, n, (n * p[faces[:, 0]]).sum(1)

    faces, normals, heights = outward(np.array([(a, b, c), (a, b, d), (a, c, d), (b, c, d)]))
    left = np.arange(len(p))
    while len(left):
        above = p[left] @ normals.T - heights
        furthest = above.max(1)
        left, above, furthest = left[furthest > eps], above[furthest > eps], furthest[furthest > eps]
        if not len(left):
            break
        k = int(furthest.argmax())
        seen = above[k] > eps
        # edges of seen faces that no other seen face shares are the rim
        edges = np.sort(np.vstack([faces[seen][:, [i, (i + 1) % 3]] for i in range(3)]), axis=1)
        rim, times = np.unique(edges, axis=0, return_counts=True)
        rim = rim[times == 1]
        more = outward(np.column_stack((rim, np.full(len(rim), left[k]))))
        faces, normals, heights = (np.concatenate((old[~seen], new)) for old, new in zip((faces, normals, heights), more, strict=True))
        left = np.delete(left, k)
    return faces


def hull_volume(p: np.ndarray) -> float | None:
    """Volume of the convex hull in space, or None for points in a plane."""
    p = np.unique(np.asarray(p, float), axis=0)
    faces = hull_faces(p)
    if faces is None:
        return None
    return float(np.abs(np.linalg.det(p[faces] - p[faces[0, 0]])).sum() / 6)


def hull_corners(p: np.ndarray) -> np.ndarray:
    """The points that are corners of the hull in space; all distinct ones where they lie in a plane."""
    p = np.unique(np.asarray(p, float), axis=0)
    faces = hull_faces(p)
    return p if faces is None else p[np.unique(faces)]
