"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .common import checkpoint, table
from .conversation_trie import ends_digest, prefix_trie, share_openings, turn_digests
from .decontaminate import find_contamination
from .exact_dedup import exact_duplicates
from .line_dedup import remove_repeated_lines
from .mixing import drawn_words, mix_sources
from .near_duplicates import near_duplicates
from .quality import fit_quality, score_quality
from .sketch_duplicates import sketch_duplicates
from .substring_dedup import remove_repeats
from .token_counts import token_counts
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import filter_urls
from .vector_codes import compress_vectors, with_label_errors


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_lines(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return found.select("doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    scored = score_toxicity(docs, fit_toxicity(docs, labels.where(fold != 1)))
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", "predicted")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = drawn_words(mix_sources(table(spark, sf_dir, "documents")))
    return drawn.select("doc_id", "size", "source_size", "target", "taken", "n_pieces", "shards")


def op11_sketch_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_duplicates(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress_vectors(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, found.books.reshape(-1).tolist())).encode()).hexdigest()
    return with_label_errors(found.rows).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = checkpoint(turn_digests(table(spark, sf_dir, "conversations")))
    nodes = ends_digest(prefix_trie(share_openings(turns)))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_quality_classifier,
        op2_jaccard_join,
        op3_line_dedup,
        op4_token_counts,
        op5_benchmark_decontamination,
        op6_substring_dedup,
        op7_exact_dedup,
        op8_toxicity,
        op9_url_filters,
        op10_mixing,
        op11_sketch_duplicates,
        op12_vector_codes,
        op13_conversation_trie,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLE_SQL
