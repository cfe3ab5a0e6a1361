"""Exact deduplication by 128-bit content hash, with the bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, text_or_empty


def content_hash(text: Column) -> Column:
    """The 128-bit hash that the groups are made by."""
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their bytes are; a null text is the empty one. ``keep`` says whether
    the smallest or the largest id of a group stays. Rows of one id and one text are copies of
    each other that share the id, so all of them count in ``group_size`` and are ``kept``
    together. A null id loses to any other. Other columns are ignored.

    The first pass groups by (hash, text), which compares the bytes and merges copies before
    they are shuffled, so a text that a third of the rows hold sends one row from each task. The
    second reads the hash alone: rows meet their group by hash, in a join that may be split where
    it is skewed. Only texts whose hash has several texts, a collision, are joined by text too.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("body"))
    hashed = rows.select("doc_id", "body", hash_of(F.col("body")).alias("h"))
    texts = hashed.groupBy("h", "body").agg(
        best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    groups = checkpoint(
        texts.groupBy("h").agg(
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
            F.count(F.lit(1)).alias("n_texts"),
        )
    )
    signed = hashed.select("doc_id", "h", F.sha2("body", 256).alias("text_sha256"))
    found = signed.join(groups.where("n_texts = 1"), "h")
    if not groups.where("n_texts > 1").isEmpty():
        clash = groups.where("n_texts > 1").select("h")
        told_apart = hashed.join(clash, "h", "left_semi").join(
            texts.join(clash, "h", "left_semi"), ["h", "body"]
        )
        found = found.select("doc_id", "text_sha256", "keep_id", "group_size").unionByName(
            told_apart.select(
                "doc_id", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size"
            )
        )
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
