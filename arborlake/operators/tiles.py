"""A partition of space that follows the points: k-d tiles of about equal counts, with halos.

Cuts come from a bounded sample of the points, which decides the balance and never the result. A point belongs to one
tile, and is copied to those within ``halo`` of it, so that a tile's task sees all neighbours of its own points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Tiles:
    """A tree of cuts: node ``i`` parts ``axis[i]`` at ``cut[i]`` into the nodes ``low[i]`` (below) and ``high[i]``; axis -1 is a tile."""

    axes: tuple[str, ...]
    axis: list[int]
    cut: list[float]
    low: list[int]
    high: list[int]

    @property
    def count(self) -> int:
        return self.axis.count(-1)

    def place(self, at: np.ndarray, halo: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Point, tile and whether it is the tile's own, for each tile that a point belongs to or is near."""
        axis, cut, low, high = (np.array(v) for v in (self.axis, self.cut, self.low, self.high))
        points, tiles, owned = [], [], []
        rows, node, own = np.arange(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), bool)
        # all points go down the tree level by level; near a cut they go both ways
        while len(rows):
            leaf = axis[node] < 0
            points.append(rows[leaf])
            tiles.append(node[leaf])
            owned.append(own[leaf])
            rows, node, own = rows[~leaf], node[~leaf], own[~leaf]
            x, at_cut = at[rows, axis[node]], cut[node]
            above = x >= at_cut
            down, up = ~(x >= at_cut + halo), x >= at_cut - halo
            own = np.concatenate(((own & ~above)[down], (own & above)[up]))
            node = np.concatenate((low[node[down]], high[node[up]]))
            rows = np.concatenate((rows[down], rows[up]))
        if not points:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return np.concatenate(points), np.concatenate(tiles), np.concatenate(owned)


def cut_tiles(points: DataFrame, axes: Sequence[str], halo: float, rows: int = 50_000, most: int = 1 << 21) -> Tiles:
    """Tiles of about ``rows`` points each, no narrower than four halos; ``points`` is read twice and should be stored.

    Some 16 points for each tile come to the driver, 131,072 at least and ``most`` at most; with more than a sixteenth of
    ``most`` tiles, tiles grow instead.
    """
    total = points.count()
    sample = min(most, max(1 << 17, 16 * total // rows))
    every = max(1, -(-total // sample))
    taken = points.select(*axes).where(F.pmod(F.xxhash64(*points.columns), F.lit(every)) == 0).limit(2 * sample).toArrow()
    at = np.column_stack([taken[a].to_numpy().astype(np.float64) for a in axes]) if taken.num_rows else np.zeros((0, len(axes)))
    at = at[np.isfinite(at).all(1)]
    least = max(16.0, rows * len(at) / max(1, total))
    tiles = Tiles(tuple(axes), [], [], [], [])

    def grow(own: np.ndarray) -> int:
        node = len(tiles.axis)
        for values, empty in ((tiles.axis, -1), (tiles.cut, 0.0), (tiles.low, -1), (tiles.high, -1)):
            values.append(empty)
        if len(own) < 2 * least:
            return node
        wide = np.ptp(own, axis=0)
        axis = int(wide.argmax())
        # halves, or other shares where the count isn't a power of two of the least
        parts = max(2, round(len(own) / least))
        cut = float(np.quantile(own[:, axis], (parts // 2) / parts))
        below = own[:, axis] < cut
        if wide[axis] < 8 * halo or not below.any() or below.all():
            return node
        tiles.axis[node], tiles.cut[node] = axis, cut
        tiles.low[node] = grow(own[below])
        tiles.high[node] = grow(own[~below])
        return node

    grow(at)
    return tiles


def dealt(points: DataFrame, tiles: Tiles, halo: float = 0.0) -> DataFrame:
    """``points`` with ``tile`` and ``own``, once for each tile that a point belongs to or is within ``halo`` of."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.column_stack([batch.column(a).to_numpy(zero_copy_only=False).astype(np.float64) for a in tiles.axes])
            rows, tile, own = tiles.place(at, halo)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(tile, pa.int64()), pa.array(own)], names=[*batch.schema.names, "tile", "own"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(deal, f"{shape}, tile long, own boolean")



def coordinates(tile: pa.Table, axes: Sequence[str]) -> np.ndarray:
    """The points of a tile, (row, axis)."""
    return np.column_stack([tile[a].to_numpy().astype(np.float64) for a in axes])
