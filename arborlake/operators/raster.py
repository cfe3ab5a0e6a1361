"""Rasters as tables of cells: distance transforms over any gap, and kernels on tiles with margins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..kernels.raster import nearest_along

#: Least and last ix, least and last iy.
Frame = tuple[int, int, int, int]
#: A kernel takes a tile's arrays with its margin, NaN where there is no cell, and which part is the tile's own.
Kernel = Callable[[dict[str, np.ndarray], tuple[slice, slice]], dict[str, np.ndarray]]
#: Cells of the rows that one task holds in a distance transform.
_BLOCK = 1 << 18


def frame_of(cells: DataFrame, pad: int = 0) -> Frame | None:
    """The bounds of the cells, wider by ``pad``; none without cells."""
    r = cells.agg(F.min("ix"), F.max("ix"), F.min("iy"), F.max("iy")).first()
    return None if r[0] is None else (r[0] - pad, r[1] + pad, r[2] - pad, r[3] + pad)


def frame_cells(spark: SparkSession, frame: Frame) -> DataFrame:
    """All cells ``ix, iy`` of a frame."""
    x0, x1, y0, y1 = frame
    rows = spark.range(x0, x1 + 1).select(F.col("id").alias("ix"))
    return rows.select("ix", F.explode(F.sequence(F.lit(y0).cast("long"), F.lit(y1).cast("long"))).alias("iy"))


def nearest_fill(cells: DataFrame, frame: Frame, value: str = "v") -> DataFrame:
    """All cells of the frame, ``ix, iy``, ``value`` of the nearest known cell, ``far``, its distance in cells, and ``seen``.

    Known cells (``value`` not null) have distance 0. Of equally near cells the one fewer iy away is taken, then the one of smaller
    iy, then of smaller ix. Without any known cell ``value`` and ``far`` are null.

    Two passes, as squared distances allow: windows carry the nearest known cell along each line of equal iy, and
    then each line of equal ix takes the lower envelope of what its cells know. Gaps may have any width.
    """
    x0, x1, y0, y1 = frame
    ny = y1 - y0 + 1
    every = frame_cells(cells.sparkSession, frame).join(cells.select("ix", "iy", F.col(value).cast("double").alias("v")), ["ix", "iy"], "left")
    known = F.when(F.col("v").isNotNull(), F.struct(F.col("ix").alias("at"), "v"))
    line = W.partitionBy("iy")
    before = F.last(known, ignorenulls=True).over(line.orderBy("ix").rowsBetween(W.unboundedPreceding, 0))
    after = F.last(known, ignorenulls=True).over(line.orderBy(F.desc("ix")).rowsBetween(W.unboundedPreceding, 0))
    both = every.select("ix", "iy", F.col("v").isNotNull().alias("seen"), before.alias("low"), after.alias("high"))
    low = F.col("high").isNull() | (F.col("ix") - F.col("low.at") <= F.col("high.at") - F.col("ix"))
    near = F.when(F.col("low").isNotNull() & low, F.col("low")).otherwise(F.col("high"))
    lined = both.select("ix", "iy", "seen", near.alias("near")).select("ix", "iy", "seen", F.abs(F.col("ix") - F.col("near.at")).alias("reach"), "near.v")

    def envelope(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("ix", "ascending"), ("iy", "ascending")])
        reach, v = (rows[c].to_numpy().astype(np.float64).reshape(-1, ny) for c in ("reach", "v"))
        best, filled = nearest_along(np.where(np.isnan(reach), np.inf, reach * reach), np.nan_to_num(v))
        lost = np.isinf(best).ravel()
        told = {"v": pa.array(filled.ravel(), mask=lost), "far": pa.array(np.sqrt(best).ravel(), mask=lost)}
        return pa.table({"ix": rows["ix"], "iy": rows["iy"], **told, "seen": rows["seen"]})

    block = F.floor((F.col("ix") - x0) / F.lit(max(1, _BLOCK // ny)))
    found = lined.withColumn("block", block).groupBy("block").applyInArrow(envelope, "ix long, iy long, v double, far double, seen boolean")
    return found.withColumnRenamed("v", value)


def on_tiles(cells: DataFrame, frame: Frame, tile: int, margin: int, kernel: Kernel, inputs: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """Run a kernel on all tiles of a frame: ``ix, iy``, ``outputs`` for each cell of the frame, whether or not it has a row in ``cells``.

    Each tile gets its own cells and those ``margin`` around it, in one Arrow group. A kernel whose results depend on no
    cell farther than the margin gives what it would on the whole frame. ``told``, if a kernel returns it, is an array of the tile's
    own, kept in its first row.
    """
    x0, x1, y0, y1 = frame
    spark = cells.sparkSession
    tiles = {"x": (x1 - x0) // tile + 1, "y": (y1 - y0) // tile + 1}

    def met(axis: str, origin: int) -> Column:
        """The tiles along an axis that a cell belongs to or is in the margin of."""
        at = F.col(f"i{axis}") - origin
        first, last = F.greatest(F.lit(0), F.floor((at - margin) / tile)), F.least(F.lit(tiles[axis] - 1), F.floor((at + margin) / tile))
        return F.explode(F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))))

    spread = cells.select("ix", "iy", *inputs, met("x", x0).alias("tx")).select("*", met("y", y0).alias("ty"))
    each = spark.range(tiles["x"] * tiles["y"]).select(F.floor(F.col("id") / tiles["y"]).alias("tx"), (F.col("id") % tiles["y"]).alias("ty"))
    columns = ["tx", "ty", "ix", "iy", *inputs]
    spread = spread.select(*columns).unionByName(each, allowMissingColumns=True)

    def run(group: pa.Table) -> pa.Table:
        tx, ty = group["tx"][0].as_py(), group["ty"][0].as_py()
        group = group.filter(group["ix"].is_valid())
        left, low = max(x0, x0 + tx * tile - margin), max(y0, y0 + ty * tile - margin)
        right, high = min(x1, x0 + (tx + 1) * tile + margin - 1), min(y1, y0 + (ty + 1) * tile + margin - 1)
        at = group["ix"].to_numpy() - left, group["iy"].to_numpy() - low
        grids = {}
        for name in inputs:
            grids[name] = np.full((right - left + 1, high - low + 1), np.nan)
            grids[name][at] = group[name].to_numpy()
        ix = np.arange(x0 + tx * tile, min(x1, x0 + (tx + 1) * tile - 1) + 1)
        iy = np.arange(y0 + ty * tile, min(y1, y0 + (ty + 1) * tile - 1) + 1)
        own = slice(ix[0] - left, ix[-1] + 1 - left), slice(iy[0] - low, iy[-1] + 1 - low)
        found = kernel(grids, own)
        told = [found["told"].tolist() if "told" in found else None] + [None] * (len(ix) * len(iy) - 1)
        flat = {n: pa.array(found[n][own].astype(np.float64).ravel(), pa.float64(), from_pandas=True) for n in outputs}
        return pa.table({"ix": np.repeat(ix, len(iy)), "iy": np.tile(iy, len(ix)), **flat, "told": pa.array(told, pa.list_(pa.float64()))})

    shape = ", ".join(f"{n} double" for n in outputs)
    return spread.groupBy("tx", "ty").applyInArrow(run, f"ix long, iy long, {shape}, told array<double>")
