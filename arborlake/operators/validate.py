"""Validation against a field survey: one-to-one matching and error figures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.assignment import best_matching
from .graph import components
from .neighbours import neighbour_join


def match_candidates(found: DataFrame, surveyed: DataFrame, most: float) -> DataFrame:
    """Pairs within the distance: ``pred_id, ref_id, dist``. Both inputs have ``id, x, y``."""
    pairs = neighbour_join(found.select("id", "x", "y"), surveyed.select("id", "x", "y"), most)
    return pairs.select(F.col("id").alias("pred_id"), F.col("n_id").alias("ref_id"), "dist")


def _match_kernel(most: float) -> Callable[[pa.Table], pa.Table]:
    def match(group: pa.Table) -> pa.Table:
        pred, ref, dist = (group[c].to_numpy() for c in ("pred_id", "ref_id", "dist"))
        rows, i = np.unique(pred, return_inverse=True)
        cols, j = np.unique(ref, return_inverse=True)
        cost = np.full((len(rows), len(cols)), 10 * most)
        cost[i, j] = dist
        pairs = [(a, b) for a, b in best_matching(cost) if cost[a, b] <= most]
        return pa.table(
            {
                "pred_id": pa.array([rows[a] for a, _ in pairs], pa.int64()),
                "ref_id": pa.array([cols[b] for _, b in pairs], pa.int64()),
                "match_dist_m": pa.array([cost[a, b] for a, b in pairs], pa.float64()),
            }
        )

    return match


def match_trees(found: DataFrame, surveyed: DataFrame, most: float = 2.0) -> DataFrame:
    """One-to-one pairs of least total distance: ``pred_id, ref_id, match_dist_m``.

    Pairs beyond the distance cost ten times as much and are dropped, so the optimum splits over
    the connected components of the pairs within it, and each component is solved in its own group.
    """
    pairs = match_candidates(found, surveyed, most)
    a, b = F.col("pred_id") * 2, F.col("ref_id") * 2 + 1
    nodes = pairs.select(a.alias("node")).unionByName(pairs.select(b.alias("node"))).distinct()
    groups = components(nodes, pairs.select(a.alias("a"), b.alias("b")))
    keyed = pairs.withColumn("node", a).join(groups, "node")
    return keyed.groupBy("root").applyInArrow(_match_kernel(most), "pred_id long, ref_id long, match_dist_m double")


def joined_pairs(pairs: DataFrame, found: DataFrame, surveyed: DataFrame) -> DataFrame:
    """Matched rows side by side, all columns with ``_pred`` and ``_ref`` added, and ``match_dist_m``."""
    left = found.select([F.col(c).alias(f"{c}_pred") for c in found.columns])
    right = surveyed.select([F.col(c).alias(f"{c}_ref") for c in surveyed.columns])
    return pairs.join(left, F.col("pred_id") == F.col("id_pred")).join(right, F.col("ref_id") == F.col("id_ref")).drop("pred_id", "ref_id")


def detection_stats(pairs: DataFrame, n_found: DataFrame, n_surveyed: DataFrame) -> DataFrame:
    """One row: hits, false alarms, misses, precision, recall, F1 and mean distance."""
    hits = pairs.agg(F.count(F.lit(1)).alias("tp"), F.avg("match_dist_m").alias("mean_match_dist_m"))
    all_found = n_found.agg(F.count(F.lit(1)).alias("n_pred"))
    all_ref = n_surveyed.agg(F.count(F.lit(1)).alias("n_ref"))
    row = hits.join(F.broadcast(all_found)).join(F.broadcast(all_ref))
    precision = F.col("tp") / F.greatest("n_pred", F.lit(1))
    recall = F.col("tp") / F.greatest("n_ref", F.lit(1))
    return row.select(
        "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_ref") - F.col("tp")).alias("fn"), precision.alias("precision"), recall.alias("recall"),
        (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))).alias("f1"), "mean_match_dist_m",
    )


def error_stats(matched: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per field: ``field, n, bias, rmse, mae, rel_rmse_pct, r2`` over pairs where both are known.

    r2 is one less the ratio of squared errors to the survey's spread; null without spread. With
    fewer than two pairs only ``n`` is given.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"{n}_pred").cast("double").alias("p"), F.col(f"{n}_ref").cast("double").alias("r")) for n in names]))
    rows = matched.select(sides.alias("s")).select("s.*").where("p is not null and r is not null")
    e = F.col("p") - F.col("r")
    sums = rows.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg("r").alias("mean_r"), F.sum(e * e).alias("sse"), F.var_pop("r").alias("spread"),
    )
    many = F.col("n") >= 2
    return sums.select(
        "field", "n", *[F.when(many, F.col(c)).alias(c) for c in ("bias", "rmse", "mae")],
        F.when(many, F.try_divide(100 * F.col("rmse"), F.col("mean_r"))).alias("rel_rmse_pct"),
        F.when(many & (F.col("spread") > 0), 1 - F.try_divide(F.col("sse"), F.col("spread") * F.col("n"))).alias("r2"),
    )
