"""Circles that many points of a group agree on (random sample consensus), however many points a group has.

The candidates of a group are circles through triplets from a sample of its points, those of the least keyed hash. A group of
moderate size is fitted in one task. A crowded one, a wall in the slice of a stem, is dealt to slices: each slice counts
its own points' votes, and the fit is refined by steps whose sums are added up over slices.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SurveyConfig
from ..functions.geometry import angle_bin
from ..kernels.circle import LEAST_POINTS, SOFT, STEPS, arc_share, best_circle, candidates, votes
from ..plans.lineage import checkpoint, forget, stored

#: Points of a group that one task holds; a group of more is crowded.
CROWDED = 1 << 16
#: Crowded groups that are sent to all tasks; each has CROWDED points at least. With more, they are joined by shuffle.
_SENT = 10_000


def _seed(seed: int, key: Sequence[object]) -> int:
    return crc32(repr((seed, *key)).encode())


def _fit(keys: Sequence[str], tol: float, tries: int, least_r: float, seed: int) -> Callable[[pa.Table], pa.Table]:
    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("__h", "ascending"), ("pid", "ascending")])
        p = np.column_stack([group[c].to_numpy().astype(float) for c in ("x", "y")])
        key = [group[k][0].as_py() for k in keys]
        found = best_circle(p, tol, tries, least_r, group["most_r"][0].as_py(), _seed(seed, key))
        one = [] if found is None else [(found.x, found.y, found.r, found.rmse, int(found.inside.sum()), float(found.inside.mean()), arc_share(p[found.inside], found.x, found.y))]
        columns = zip(*one, strict=True) if one else [()] * 7
        kinds = (*[pa.float64()] * 4, pa.int32(), pa.float64(), pa.float64())
        names = ("cx", "cy", "r", "rmse", "n", "inlier_frac", "arc")
        return pa.table({**{k: group[k].slice(0, len(one)) for k in keys}, **{c: pa.array(v, t) for c, v, t in zip(names, columns, kinds, strict=True)}})

    return fit


def _same(keys: Sequence[str], other: str = "__of_") -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(other + k)) for k in keys]


def _meet(points: DataFrame, groups: DataFrame, keys: Sequence[str], few: bool) -> DataFrame:
    """``points`` with the columns of their group."""
    renamed = groups.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    return points.join(F.broadcast(renamed) if few else renamed, _same(keys)).drop(*[f"__of_{k}" for k in keys])


def _off(x: str = "cx", y: str = "cy", r: str = "r") -> Column:
    return F.abs(F.hypot(F.col("x") - F.col(x), F.col("y") - F.col(y)) - F.col(r))


def _crowded_circles(points: DataFrame, counts: DataFrame, keys: list[str], tol: float, tries: int, least_r: float, seed: int, few: bool) -> DataFrame:
    """As ``_fit``, of groups in slices. ``points`` has ``__h``; ``counts`` has the crowded groups and their ``__n``."""
    types = dict(points.dtypes)
    shape = ", ".join(f"`{k}` {types[k]}" for k in keys)
    n_slices = F.ceil(F.col("__n") / F.lit(CROWDED)).cast("int")
    met = _meet(points, counts, keys, few)
    sliced = checkpoint(met.withColumn("slice", F.pmod(F.xxhash64("pid", F.lit("slice")), n_slices).cast("long")))
    # some four times the points that candidates take, whatever the group's size
    low = F.pmod(F.col("__h"), F.lit(1 << 52)) / F.lit(float(1 << 52)) * F.col("__n") < 12 * tries

    def through(group: pa.Table) -> pa.Table:
        group = group.sort_by([("__h", "ascending"), ("pid", "ascending")])
        p = np.column_stack([group[c].to_numpy().astype(float) for c in ("x", "y")])
        circles = candidates(p, tries, least_r, group["most_r"][0].as_py(), _seed(seed, [group[k][0].as_py() for k in keys]))
        at = pa.array(np.zeros(len(circles), np.int64))
        columns = {"nth": pa.array(np.arange(len(circles)), pa.int32())} | {c: circles[:, i] for i, c in enumerate(("cx", "cy", "r"))}
        return pa.table({**{k: group[k].take(at) for k in keys}, **columns})

    circles = checkpoint(sliced.where(low).groupBy(*keys).applyInArrow(through, f"{shape}, nth int, cx double, cy double, r double"))
    each = _meet(counts.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), n_slices.cast("long") - 1)).alias("slice")), circles, keys, few)

    def count(part: pa.Table, tried: pa.Table) -> pa.Table:
        p = np.column_stack([part[c].to_numpy().astype(float) for c in ("x", "y")])
        n = votes(p, np.column_stack([tried[c].to_numpy() for c in ("cx", "cy", "r")]), tol)
        return tried.select([*keys, "nth", "cx", "cy", "r"]).append_column("votes", pa.array(n, pa.int64()))

    sides = sliced.groupBy(*keys, "slice").cogroup(each.groupBy(*keys, "slice"))
    voted = sides.applyInArrow(count, f"{shape}, nth int, cx double, cy double, r double, votes long")
    total = voted.groupBy(*keys, "nth", "cx", "cy", "r").agg(F.sum("votes").alias("votes")).where(F.col("votes") >= LEAST_POINTS)
    best = total.groupBy(*keys).agg(F.max_by(F.struct("cx", "cy", "r"), F.struct("votes", -F.col("nth"))).alias("c"))
    state, path = stored(best.select(*keys, "c.*", F.lit(1.0).alias("step")))
    voters = checkpoint(_meet(sliced.select(*keys, "x", "y"), state, keys, few).where(_off() < tol).select(*keys, "x", "y"))
    for _ in range(STEPS):
        dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
        far = F.greatest(F.hypot(dx, dy), F.lit(1e-12))
        placed = _meet(voters, state.where("step >= 1e-10"), keys, few).withColumns({"off": far - F.col("r"), "jx": -dx / far, "jy": -dy / far})
        w = 1 / F.sqrt(1 + F.col("off") * F.col("off") / SOFT**2)
        j = {"x": F.col("jx"), "y": F.col("jy"), "r": F.lit(-1.0), "o": F.col("off")}
        pairs = ("xx", "xy", "xr", "yy", "yr", "rr", "xo", "yo", "ro")
        sums = placed.groupBy(*keys, "cx", "cy", "r").agg(*[F.sum(w * j[a[0]] * j[a[1]]).alias(a) for a in pairs])
        a, b, c, d, e, f = (F.col(n) + (1e-12 if n[0] == n[1] else 0.0) for n in pairs[:6])
        u, v, t = (-F.col(n) for n in pairs[6:])
        det = a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)
        step = {
            "sx": (u * (d * f - e * e) - b * (v * f - t * e) + c * (v * e - t * d)) / det,
            "sy": (a * (v * f - t * e) - u * (b * f - c * e) + c * (b * t - c * v)) / det,
            "sr": (a * (d * t - e * v) - b * (b * t - c * v) + u * (b * e - c * d)) / det,
        }
        moved = sums.withColumns(step).select(
            *keys, *[(F.col(x) + F.col(s)).alias(x) for x, s in (("cx", "sx"), ("cy", "sy"), ("r", "sr"))], F.greatest(*[F.abs(s) for s in step]).alias("step")
        )
        old = path
        state, path = stored(moved.unionByName(state.where("step < 1e-10")))
        forget(points.sparkSession, old)
        if state.where("step >= 1e-10").isEmpty():
            break
    fitted = state.select(*keys, "cx", "cy", F.abs("r").alias("r"))
    limits = sliced.groupBy(*keys).agg(F.max("most_r").alias("top"))
    fitted = checkpoint(_meet(limits, fitted, keys, few).where((F.col("r") > least_r) & (F.col("r") < F.col("top"))))
    rmse = _meet(voters, fitted, keys, few).groupBy(*keys).agg(F.sqrt(F.avg(_off() * _off())).alias("rmse"))
    inside = _off() < tol
    turn = F.when(inside, angle_bin(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    told = _meet(sliced.select(*keys, "x", "y"), fitted, keys, few).groupBy(*keys, "cx", "cy", "r").agg(
        F.count(F.when(inside, 1)).cast("int").alias("n"), F.avg(inside.cast("double")).alias("inlier_frac"), (F.size(F.collect_set(turn)) / 36.0).alias("arc")
    )
    return _meet(told, rmse, keys, few).select(*keys, "cx", "cy", "r", "rmse", "n", "inlier_frac", "arc")


def ransac_circles(points: DataFrame, keys: Sequence[str], cfg: SurveyConfig, most_r: float | None = None) -> DataFrame:
    """Robust circle per group of points (``pid, x, y``, and ``most_r`` unless given); groups without one have no row.

    Returns ``keys, cx, cy, r, rmse, n, inlier_frac, arc``. Random numbers are seeded by a group's keys and points are drawn by a hash
    of their ids, so that results don't depend on the order, the place or the slices of the groups. ``rmse`` is over the points
    that voted for the circle, the rest over those within the tolerance of the refined one.
    """
    keys = list(keys)
    top = F.col("most_r") if most_r is None else F.lit(float(most_r))
    rows = points.select(*keys, F.col("pid").cast("long").alias("pid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), top.alias("most_r"))
    rows = checkpoint(rows.withColumn("__h", F.xxhash64("pid", F.lit(cfg.random_seed))))
    types = dict(rows.dtypes)
    least_r = cfg.stem_min_diameter / 2
    crowded = checkpoint(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > CROWDED))
    n = crowded.count()
    few = n <= _SENT
    renamed = crowded.select(*[F.col(k).alias(f"__of_{k}") for k in keys])
    rest = rows.join(F.broadcast(renamed) if few else renamed, _same(keys), "left_anti") if n else rows
    fit = _fit(keys, cfg.ransac_tol, cfg.ransac_iters, least_r, cfg.random_seed)
    shape = ", ".join(f"`{k}` {types[k]}" for k in keys)
    found = rest.groupBy(*keys).applyInArrow(fit, f"{shape}, cx double, cy double, r double, rmse double, n int, inlier_frac double, arc double")
    if not n:
        return found
    return found.unionByName(_crowded_circles(rows, crowded, keys, cfg.ransac_tol, cfg.ransac_iters, least_r, cfg.random_seed, few))


def circle_members(points: DataFrame, circles: DataFrame, keys: Sequence[str], tol: float) -> DataFrame:
    """``circle_id, pid``: the points of each circle's group that lie within the tolerance of it."""
    near = points.select(*keys, "pid", "x", "y").join(circles.select(*keys, "circle_id", "cx", "cy", "r"), list(keys))
    return near.where(_off() < tol).select("circle_id", "pid")
