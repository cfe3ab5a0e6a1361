"""Spatial joins: pairs by equi-joins on grid buckets, nearest neighbours by tiles that follow the points."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import near
from ..plans.lineage import checkpoint
from .tiles import coordinates, cut_tiles, dealt


def _bucket(axis: str, cell: float, prefix: str = "") -> Column:
    return F.floor(F.col(prefix + axis) / F.lit(float(cell))).cast("long")


def neighbour_join(
    left: DataFrame,
    right: DataFrame,
    radius: float,
    axes: Sequence[str] = ("x", "y"),
    keys: Sequence[str] = (),
    prefix: str = "n_",
) -> DataFrame:
    """Pairs of rows within ``radius``, equal in ``keys``: left columns, ``prefix``ed right columns, ``dist``.

    Each right row is put in its grid cell and each left row in all cells around its own, so the
    join is on cells of the size of the radius, and rows far apart never meet.
    """
    around = F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(axes, offset)]) for offset in product((-1, 0, 1), repeat=len(axes))])
    spread = left.withColumn("__o", F.explode(around)).withColumns({f"__b{a}": _bucket(a, radius) + F.col(f"__o.{a}") for a in axes}).drop("__o")
    put = right.select([F.col(c).alias(prefix + c) for c in right.columns])
    put = put.withColumns({f"__b{a}": _bucket(a, radius, prefix) for a in axes}).withColumnsRenamed({prefix + k: k for k in keys})
    squares = sum(((F.col(a) - F.col(prefix + a)) * (F.col(a) - F.col(prefix + a)) for a in axes[1:]), (F.col(axes[0]) - F.col(prefix + axes[0])) * (F.col(axes[0]) - F.col(prefix + axes[0])))
    joined = spread.join(put, [*keys, *[f"__b{a}" for a in axes]]).drop(*[f"__b{a}" for a in axes])
    return joined.withColumn("dist", F.sqrt(squares)).where(F.col("dist") <= radius)


def close_pairs(df: DataFrame, radius: float, id_col: str, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Unordered pairs of different rows within ``radius``: ``a, b, dist`` with a < b."""
    slim = df.select(id_col, *axes)
    pairs = neighbour_join(slim, slim, radius, axes)
    return pairs.where(F.col(id_col) < F.col(f"n_{id_col}")).select(F.col(id_col).alias("a"), F.col(f"n_{id_col}").alias("b"), "dist")


def _halo(radius: float) -> float:
    """A little more than the radius, so that rounding leaves no neighbour outside."""
    return radius * (1 + 1e-6)


def nearest_k(
    df: DataFrame, k: int, radius: float, id_col: str, axes: Sequence[str] = ("x", "y", "z"), scale: Sequence[float] | None = None
) -> DataFrame:
    """Up to ``k`` nearest other rows within ``radius`` of each row: ``src, dst, dist``; ties by id.

    With ``scale``, a factor for each axis, ``w`` is the distance on axes so scaled. Points are dealt to tiles of about
    equal counts, each with a halo of the radius, and searched there by sorted cells.
    """
    slim = checkpoint(df.select(F.col(id_col).cast("long").alias("id"), *axes))
    tiles = cut_tiles(slim, axes, radius)
    factors = np.array(scale or [1.0] * len(axes))

    def search(tile: pa.Table) -> pa.Table:
        at, ids, own = coordinates(tile, axes), tile["id"].to_numpy(), tile["own"].to_numpy()
        mine = np.flatnonzero(own)
        i, j, dist = near.nearest(at[mine], ids[mine], at, ids, k, radius, same=True)
        i = mine[i]
        step = (at[i] - at[j]) * factors
        return pa.table({"src": ids[i], "dst": ids[j], "dist": dist, "w": np.sqrt(sum(step[:, a] * step[:, a] for a in range(len(axes))))})

    found = dealt(slim, tiles, _halo(radius)).groupBy("tile").applyInArrow(search, "src long, dst long, dist double, w double")
    return found.select("src", "dst", "dist", *(["w"] if scale else []))


def nearest_k_both_ways(
    df: DataFrame, k: int, radius: float, id_col: str, axes: Sequence[str] = ("x", "y", "z"), scale: Sequence[float] | None = None
) -> DataFrame:
    """``a, b, w``, once each way, for all ``a`` of whose ``nearest_k`` ``b`` is one, or the other way round; ``w`` as there.

    A tile sees two radii around itself, so that it knows the nearest of all points which may have its own among theirs: it
    tells all edges of its own points, and edges are never shuffled.
    """
    slim = checkpoint(df.select(F.col(id_col).cast("long").alias("id"), *axes))
    halo = _halo(radius)
    tiles = cut_tiles(slim, axes, 2 * halo)
    factors = np.array(scale or [1.0] * len(axes))

    def search(tile: pa.Table) -> pa.Table:
        at, ids, own = coordinates(tile, axes), tile["id"].to_numpy(), tile["own"].to_numpy()
        points, of, _ = tiles.place(at, halo)
        mine = np.sort(points[of == tile["tile"][0].as_py()])
        i, j, _ = near.nearest(at[mine], ids[mine], at, ids, k, radius, same=True)
        i = mine[i]
        a, b = np.concatenate((i, j)), np.concatenate((j, i))
        pairs = np.unique((a * len(at) + b)[own[a]])
        a, b = pairs // len(at), pairs % len(at)
        step = (at[a] - at[b]) * factors
        return pa.table({"a": ids[a], "b": ids[b], "w": np.sqrt(sum(step[:, x] * step[:, x] for x in range(len(axes))))})

    return dealt(slim, tiles, 2 * halo).groupBy("tile").applyInArrow(search, "a long, b long, w double")


def nearest_one(
    left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, carry: Sequence[str] = (), axes: Sequence[str] = ("x", "y", "z")
) -> DataFrame:
    """``left`` with the nearest right row within ``radius``: ``right_id``, ``carry`` and ``dist``, ties by id; null where there is none.

    Both sides are dealt to the same tiles, the right one with a halo of the radius.
    """
    others = checkpoint(right.select(F.col(right_id).cast("long").alias("__id"), *[F.col(c).alias(f"__{c}") for c in carry], *[F.col(a).cast("double").alias(a) for a in axes]))
    left = checkpoint(left)
    spots = left.select(*[F.col(a).cast("double").alias(a) for a in axes]).unionByName(others.select(*axes))
    tiles = cut_tiles(spots, axes, radius)
    kinds = {f.name: f.dataType.simpleString() for f in others.schema.fields}
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields]
    shape += [f"`{right_id}` long", *[f"`{c}` {kinds[f'__{c}']}" for c in carry], "dist double"]

    def search(tile: pa.Table, beside: pa.Table) -> pa.Table:
        rows = tile.drop_columns(["tile", "own"])
        ids = beside["__id"].to_numpy()
        i, j, dist = near.nearest(coordinates(tile, axes), np.zeros(tile.num_rows, np.int64), coordinates(beside, axes), ids, 1, radius, same=False)
        at, far = np.full(tile.num_rows, -1), np.full(tile.num_rows, np.nan)
        at[i], far[i] = j, dist
        taken = beside.take(pa.array(at, mask=at < 0))
        for name, column in ((right_id, "__id"), *((c, f"__{c}") for c in carry)):
            rows = rows.append_column(name, taken[column])
        return rows.append_column("dist", pa.array(far, mask=at < 0))

    sides = dealt(left, tiles).groupBy("tile").cogroup(dealt(others, tiles, _halo(radius)).groupBy("tile"))
    return sides.applyInArrow(search, ", ".join(shape))
