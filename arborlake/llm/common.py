"""What the text operators share: names, checkpoints and word expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint, forget, shared_folder, stored

__all__ = ["checkpoint", "forget", "shared_folder", "stored"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A run of these bytes parts two words.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_by_hot_key(rows: DataFrame, counted: DataFrame, keys: list[str], n: str, share: float = 1e-3) -> DataFrame:
    """Join ``rows`` with ``counted``, which has one row per key and in ``n`` how many rows have it.

    Keys of more than a ``share`` of all rows, fewer than one divided by that, are broadcast, so their rows
    stay where they are; all others meet by shuffle. Both inputs are read twice and should be stored.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > F.lit(max(1.0, share * total))
    often = F.broadcast(counted.where(hot))
    seldom = rows.join(F.broadcast(counted.where(hot).select(*keys)), keys, "left_anti").join(counted.where(~hot), keys)
    return rows.join(often, keys).unionByName(seldom)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; other letters stay. ``lower`` is the quicker one, right for ASCII texts."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def alnum_words(text: Column) -> Column:
    """The words of a text: runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(text), NOT_ALNUM, -1), "")


def space_word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SPACE_WORD)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def one_text_per_id(rows: DataFrame) -> DataFrame:
    """Of rows that share ``doc_id``, the one whose ``text`` has the least hash; rows are merged in each task first."""
    rest = [c for c in rows.columns if c != "doc_id"]
    best = rows.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.xxhash64("text")).alias("best"))
    return best.select("doc_id", "best.*")
