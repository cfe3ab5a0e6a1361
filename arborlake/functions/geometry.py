"""Geometry as column expressions, so that it stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def perpendicular_basis(ax: Column, ay: Column, az: Column) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """Two unit vectors that span the plane across an axis."""
    n = F.sqrt(ax * ax + ay * ay + az * az)
    ax, ay, az = ax / n, ay / n, az / n
    steep = F.abs(az) < 0.9
    hx, hz = F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0)
    cx, cy, cz = ay * hz, az * hx - ax * hz, -ay * hx
    m = F.sqrt(cx * cx + cy * cy + cz * cz)
    e1 = (cx / m, cy / m, cz / m)
    e2 = (ay * e1[2] - az * e1[1], az * e1[0] - ax * e1[2], ax * e1[1] - ay * e1[0])
    return e1, e2


def lean_degrees(az: Column) -> Column:
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(az))))


def symmetric_eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix, largest first, by the trigonometric formula."""
    q = (xx + yy + zz) / 3
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)
    p = F.sqrt(p2 / 6)
    dx, dy, dz = (xx - q) / p, (yy - q) / p, (zz - q) / p
    ex, ey, ez = xy / p, xz / p, yz / p
    det = dx * (dy * dz - ez * ez) - ex * (ex * dz - ez * ey) + ey * (ex * ez - dy * ey)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    flat = p2 <= 1e-24
    big = F.when(flat, q).otherwise(q + 2 * p * F.cos(phi))
    low = F.when(flat, q).otherwise(q + 2 * p * F.cos(phi + 2 * math.pi / 3))
    return [big, 3 * q - big - low, low]


def main_direction(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    """Unit vector (a struct of x, y, z) of a symmetric 3 x 3 matrix's largest eigenvalue, upright where all directions are alike.

    Rows of the matrix less that eigenvalue are orthogonal to the vector, so it is the cross product of two of
    them: the longest of the three, since two rows may be in line.
    """
    big = symmetric_eigenvalues(xx, yy, zz, xy, xz, yz)[0]
    rows = F.array(*[F.array(*r) for r in ((xx - big, xy, xz), (xy, yy - big, yz), (xz, yz, zz - big))])

    def longest(r: Column) -> Column:
        def of(i: int, j: int) -> Column:
            x, y, z = (r[i][a] * r[j][b] - r[i][b] * r[j][a] for a, b in ((1, 2), (2, 0), (0, 1)))
            return F.struct(F.sqrt(x * x + y * y + z * z).alias("long"), x.alias("x"), y.alias("y"), z.alias("z"))

        return F.array_max(F.array(of(0, 1), of(0, 2), of(1, 2)))

    best = F.transform(F.array(rows), longest)
    upright = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))

    def unit(v: Column) -> Column:
        # two nearly equal large eigenvalues leave no direction to tell
        flat = v["long"].isNull() | F.isnan(v["long"]) | (v["long"] <= 1e-12 * big * big)
        return F.when(flat, upright).otherwise(F.struct(*[(v[a] / v["long"]).alias(a) for a in "xyz"]))

    return F.get(F.transform(best, unit), F.lit(0))


def angle_bin(dx: Column, dy: Column, bins: int = 36) -> Column:
    """The bin of the direction (dx, dy) among equal bins around the circle."""
    turn = (F.atan2(dy, dx) + math.pi) / (2 * math.pi)
    return F.pmod(F.floor(turn * bins), F.lit(bins))
