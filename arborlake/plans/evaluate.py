"""Compare an inventory with a field survey: pairs, detection and errors, as frames and files."""

from __future__ import annotations

import argparse
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validate
from ..sources import tables
from .lineage import checkpoint

FIELDS = ("dbh_cm", "height_m")


@dataclass
class Agreement:
    """Matched pairs side by side, one row of detection figures, and a row of errors per field."""

    matched: DataFrame
    detection: DataFrame
    errors: DataFrame | None


def column_names(text: str) -> dict[str, str]:
    """New names of a survey's columns, from ``{"old": "new"}``; empty names are left out."""
    return {old: new for old, new in json.loads(text or "{}").items() if old and new}


def _numbered(df: DataFrame, id_col: str) -> DataFrame:
    """Rows with a number ``id``: their own, or one of this run."""
    if id_col in df.columns:
        return df.withColumn("id", F.col(id_col).cast("long"))
    return checkpoint(df.drop("id").withColumn("id", F.monotonically_increasing_id()))


def agreement(trees: DataFrame, survey: DataFrame, most: float = 2.0, quality: Sequence[str] | None = None) -> Agreement:
    """Match trees (of the given ``quality``, or all) with a survey and measure how well they agree."""
    found = _numbered(trees if quality is None else trees.where(F.col("quality").isin(*quality)), "tree_id")
    surveyed = _numbered(survey, "survey_id")
    pairs = checkpoint(validate.match_trees(found, surveyed, most))
    matched = validate.joined_pairs(pairs, found, surveyed)
    shared = [f for f in FIELDS if f in found.columns and f in surveyed.columns]
    errors = validate.error_stats(matched, shared) if shared else None
    return Agreement(matched, validate.detection_stats(pairs, found, surveyed), errors)


def write_agreement(found: Agreement, folder: str) -> None:
    """The matched pairs and the figures as CSV."""
    parts = {"matched_trees": found.matched, "detection": found.detection, "errors": found.errors}
    for name, df in parts.items():
        if df is not None:
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def main(argv: list[str] | None = None) -> None:
    ask = argparse.ArgumentParser(description="Compare an inventory with a field survey")
    ask.add_argument("survey")
    ask.add_argument("--trees", default="outputs/trees.parquet")
    ask.add_argument("--out", default="outputs")
    ask.add_argument("--most", type=float, default=2.0)
    ask.add_argument("--quality", nargs="*")
    ask.add_argument("--names", default="{}", help='JSON of a survey column\'s old and new name')
    args = ask.parse_args(argv)
    spark = SparkSession.builder.appName("arborlake").getOrCreate()
    survey = tables.tree_list(spark, args.survey, column_names(args.names))
    found = agreement(spark.read.parquet(args.trees), survey, args.most, args.quality)
    write_agreement(found, args.out)
    found.detection.show(vertical=True)
    if found.errors is not None:
        found.errors.show()


if __name__ == "__main__":
    main()
