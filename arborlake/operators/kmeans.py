"""K-means with many starts side by side: each step is one pass over the rows for all starts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("features")
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, (start, row, centre)."""
    return np.stack([((x[:, None] - c[None]) ** 2).sum(2) for c in centres])


def _chances(ids: np.ndarray, starts: int, turn: int, seed: int) -> np.ndarray:
    """Uniform numbers that depend on a row's id alone, (start, row)."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(starts, dtype=np.uint64)[:, None] * np.uint64(1000) + np.uint64(turn)) * np.uint64(0xD6E8FEB86659FD93)
        h += np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _picker(centres: np.ndarray | None, starts: int, turn: int, seed: int) -> Callable[[Batches], Batches]:
    """The row that each start takes as its next centre, with chances in proportion to the squared distance from those it
    has: of exponential waiting times at these rates the shortest, in each task."""

    def pick(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch)
            rate = np.ones((starts, len(x))) if centres is None else _squares(x, centres).min(2)
            with np.errstate(divide="ignore"):
                wait = -np.log(_chances(batch.column("id").to_numpy(), starts, turn, seed)) / rate
            at = wait.argmin(1)
            columns = [pa.array(np.arange(starts), pa.int32()), pa.array(wait[np.arange(starts), at]), pa.array(x[at].tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["start", "wait", "row"])

    return pick


def _summer(centres: np.ndarray) -> Callable[[Batches], Batches]:
    """Counts, sums and cost by start and centre, of each task's rows."""
    starts, k, d = centres.shape

    def add(batches: Batches) -> Batches:
        n, cost, sums = np.zeros((starts, k), np.int64), np.zeros((starts, k)), np.zeros((starts, k, d))
        for batch in batches:
            x = _vectors(batch)
            if not len(x):
                continue
            far = _squares(x, centres)
            own = far.argmin(2)
            for s in range(starts):
                n[s] += np.bincount(own[s], minlength=k)
                cost[s] += np.bincount(own[s], far[s].min(1), k)
                sums[s] += np.stack([np.bincount(own[s], v, k) for v in x.T], 1)
        names = ["start", "centre", "n", "cost", "sums"]
        columns = [np.repeat(np.arange(starts), k), np.tile(np.arange(k), starts), n.ravel(), cost.ravel(), sums.reshape(-1, d).tolist()]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return add


def _step(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centres after a step, where one without rows stays, and the cost of each start before it."""
    starts, k, d = centres.shape
    parts = rows.mapInArrow(_summer(centres), "start int, centre int, n long, cost double, sums array<double>")
    added = parts.groupBy("start", "centre").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(d)]).toArrow()
    at = added["start"].to_numpy(), added["centre"].to_numpy()
    n, cost, after = np.zeros((starts, k)), np.zeros(starts), centres.copy()
    n[at] = added["n"].to_numpy()
    np.add.at(cost, at[0], added["cost"].to_numpy())
    sums = np.zeros((starts, k, d))
    sums[at] = np.column_stack([added[f"s{i}"].to_numpy() for i in range(d)])
    full = n > 0
    after[full] = sums[full] / n[full][:, None]
    return after, cost


def best_centres(rows: DataFrame, k: int, starts: int = 20, seed: int = 42, most_steps: int = 300, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """Centres of least cost among ``starts`` starts, (centre, dimension), and their cost: the sum of squared distances.

    ``rows`` has ``id`` (long) and ``features`` (array of doubles, all of one length, no nulls) and is read once a step, for
    all starts together; what comes to the driver is a row for each start and centre. Starts are drawn one centre after the other, far
    ones likelier, by hashes of the ids, so that results don't depend on partitions. Steps end when no start's centres move by more
    than ``tol`` of the mean variance.
    """
    centres = None
    for turn in range(k):
        picked = rows.mapInArrow(_picker(centres, starts, turn, seed), "start int, wait double, row array<double>")
        first = picked.groupBy("start").agg(F.min_by("row", F.struct("wait", "row")).alias("row")).orderBy("start").collect()
        new = np.array([r["row"] for r in first])[:, None]
        centres = new if centres is None else np.concatenate((centres, new), 1)
    d = centres.shape[2]
    spread = rows.agg(*[F.var_pop(F.col("features")[i]) for i in range(d)]).first()
    least = tol * float(np.mean(spread))
    for _ in range(most_steps):
        after, _ = _step(rows, centres)
        moved = ((after - centres) ** 2).sum((1, 2))
        centres = after
        if (moved <= least).all():
            break
    _, cost = _step(rows, centres)
    best = int(cost.argmin())
    return centres[best], float(cost[best])


def nearest_centre(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with ``prediction``, the nearest centre, the lower number among equals."""
    far = [sum(((F.col("features")[i] - float(c[i])) ** 2 for i in range(1, len(c))), (F.col("features")[0] - float(c[0])) ** 2) for c in centres]
    least = F.least(*far) if len(far) > 1 else far[0]
    choice = F.lit(len(far) - 1)
    for i in range(len(far) - 2, -1, -1):
        choice = F.when(far[i] == least, F.lit(i)).otherwise(choice)
    return rows.withColumn("prediction", choice)
