"""The corpus pipeline: five operators in turn, each on what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import checkpoint, shared_folder, table
from arborlake.llm.decontaminate import find_contamination
from arborlake.llm.line_dedup import remove_repeated_lines
from arborlake.llm.mixing import drawn_words, mix_sources
from arborlake.llm.near_duplicates import near_duplicates
from arborlake.llm.quality import fit_quality, score_quality


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    # whole rows in a struct: columns of theirs may be named like the scores
    packed = docs.select(F.struct(*docs.columns).alias("row"), *[c for c in ("text", "lang", "source") if c in docs.columns])
    return score_quality(packed, model, columns=["row"]).where("keep").select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the later copies of repeated line runs; one that loses all its words goes."""
    left = remove_repeated_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = left.where(~emptied)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; of rows that repeat an id and a text, one."""
    kept = near_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    kept = checkpoint(kept.agg(F.count(F.lit(1)).alias("__rows")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash"))
    left = docs.join(kept.where("__rows = 1"), same, "left_semi").select(*docs.columns)
    if kept.where("__rows > 1").isEmpty():
        return left
    repeated = docs.join(kept.where("__rows > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.unionByName(repeated.select(*docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no window of the benchmark. Each row is judged by its own text, also where ids repeat or are null."""
    # id and 128 bits of the text: rows that share them are the same document
    text = F.col("text").cast("string")
    row = F.struct("doc_id", F.xxhash64(text), F.xxhash64(F.lit("row"), text))
    found = find_contamination(docs.select(row.alias("row"), text.alias("text")), table(spark, sf_dir, "benchmark"), id_col="row")
    hits = found.where("n_hit > 0").select(F.col("doc_id").alias("__row"))
    return docs.join(hits, row == F.col("__row"), "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return drawn_words(mix_sources(docs)).select("doc_id", "source", "size", "source_size", "target", "taken", "n_pieces", "shards")


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed),
]

#: The first stage fits a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for nth, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{nth}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
