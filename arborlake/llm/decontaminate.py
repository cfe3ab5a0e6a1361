"""Benchmark decontamination by winnowing.

Of every window of words, the minimum hash of its k-grams is the fingerprint. A passage of a whole
window that a document shares with the benchmark has the same fingerprint on both sides, so a join
of fingerprints finds every such passage. Hits are then extended to the window's words, compared
with the benchmark's in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import alnum_words, checkpoint, text_or_empty

#: Words of a k-gram; shorter windows are one k-gram.
GRAM = 5


def _fingerprint(hashes: Column, start: Column, length: int, gram: int) -> Column:
    """Minimum hash of the k-grams of the window of ``length`` words from ``start`` (0 up).

    A k-gram's hash is that of its words, shifted by their place and joined by exclusive or.
    """
    k = min(gram, length)

    def joined(g: int) -> Column:
        h = F.get(hashes, start + g)
        for j in range(1, k):
            h = h.bitwiseXOR(F.shiftleft(F.get(hashes, start + (g + j)), 5 * j))
        return h

    grams = [joined(g) for g in range(length - k + 1)]
    return grams[0] if len(grams) == 1 else F.least(*grams)


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def _window_text(start: str, length: Column) -> Column:
    return F.array_join(F.slice("words", F.col(start) + 1, length), " ")


def benchmark_windows(
    bench: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """Distinct windows of the benchmark: ``win`` (its words), ``length``, ``items`` (sorted ids).

    An item of fewer words than a window, but not none, is one window.
    """
    words = bench.select(F.col(id_col).cast("string").alias("item"), alnum_words(text_or_empty(text_col)).alias("words"))
    sized = words.where(F.size("words") > 0).withColumn("length", F.least(F.lit(window), F.size("words")))
    starts = F.sequence(F.lit(0), F.size("words") - F.col("length"))
    windows = sized.select("item", "words", "length", F.explode(starts).alias("p"))
    return (
        windows.select("item", "length", _window_text("p", F.col("length")).alias("win"))
        .groupBy("win", "length")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def find_contamination(
    docs: DataFrame,
    bench: DataFrame,
    window: int = 10,
    gram: int = GRAM,
    broadcast_rows: int = 500_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Where documents repeat the benchmark: ``doc_id, n_words, n_hit, items``.

    ``n_hit`` counts the words inside any occurrence of a benchmark window; ``items`` lists the
    ids, as strings and sorted, of the items with such a window. Null and blank texts have no
    words. Rows that share an id are one document: hits are united and ``n_words`` is the largest.
    Other columns are ignored.

    Where the benchmark has at most ``broadcast_rows`` distinct windows, which is counted first,
    its fingerprints are broadcast and each document is read once, without a shuffle of its words.
    A larger benchmark is joined by shuffling fingerprints, one for each run of windows that share
    it, and then the windows of the documents that were hit.
    """
    known = checkpoint(benchmark_windows(bench, window, text_col="text")).withColumn(
        "set_id", F.xxhash64(F.concat_ws("\x00", "items"))
    )
    classes = {r["length"]: r["n"] for r in known.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lengths = sorted(classes)
    small = sum(classes.values()) <= broadcast_rows
    words = docs.select(F.col(id_col).alias("doc_id"), alnum_words(text_or_empty(text_col)).alias("words"))
    if not lengths:
        return words.groupBy("doc_id").agg(
            F.max(F.size("words")).cast("long").alias("n_words"),
            F.lit(0).cast("long").alias("n_hit"),
            F.array().cast("array<string>").alias("items"),
        )
    prints = checkpoint(_known_prints(known, lengths, gram))
    if small:
        spans = _spans_by_broadcast(words, known, prints, lengths, gram)
    else:
        spans = _spans_by_shuffle(words, known, prints, lengths, gram)
    return _by_document(spans, known)


def _known_prints(known: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    cut = _hashed(known.select("length", F.split("win", " ").alias("words"))).withColumn("p", F.lit(0))
    print_of = F.lit(None).cast("long")
    for n in lengths:
        print_of = F.when(F.col("length") == n, _fingerprint(F.col("hashes"), F.col("p"), n, gram)).otherwise(print_of)
    return cut.select("length", print_of.alias("print")).distinct()


def _document_prints(words: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """One row per document and window: ``p`` (start), ``length``, ``print``; ``p`` -1 stands for the document."""
    starts = F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.size("words") - min(lengths)))
    at = _hashed(words).select("doc_id", "words", "hashes", F.explode_outer(starts).alias("p"))
    if len(lengths) == 1:
        found = F.when(F.col("p") >= 0, _fingerprint(F.col("hashes"), F.col("p"), lengths[0], gram))
        return at.select("doc_id", "words", "p", F.lit(lengths[0]).alias("length"), found.alias("print"))
    every = F.array(
        *[
            F.struct(
                F.lit(n).alias("length"),
                F.when((F.col("p") >= 0) & (F.col("p") + n <= F.size("words")), _fingerprint(F.col("hashes"), F.col("p"), n, gram)).alias(
                    "print"
                ),
            )
            for n in lengths
        ]
    )
    return at.select("doc_id", "words", "p", F.explode_outer(every).alias("w")).select("doc_id", "words", "p", "w.*")


def _spans_by_broadcast(
    words: DataFrame, known: DataFrame, prints: DataFrame, lengths: list[int], gram: int
) -> DataFrame:
    rows = _document_prints(words, lengths, gram)
    hit = rows.join(F.broadcast(prints.withColumn("hit", F.lit(True))), ["length", "print"], "left").where(
        "hit or p = -1"
    )
    texts = hit.select(
        "doc_id",
        "p",
        "length",
        F.when(F.col("p") >= 0, _window_text("p", F.col("length"))).alias("win"),
        F.when(F.col("p") < 0, F.size("words")).alias("n_words"),
    )
    same = texts.join(F.broadcast(known.select("win", "set_id")), "win", "left")
    return same.where("set_id is not null or n_words is not null").select("doc_id", "p", "length", "set_id", "n_words")


def _spans_by_shuffle(
    words: DataFrame, known: DataFrame, prints: DataFrame, lengths: list[int], gram: int
) -> DataFrame:
    each = F.array(*[_prints_of(n, gram) for n in lengths])
    hashed = _hashed(words).select("doc_id", F.posexplode(each).alias("nth", "prints"))
    length_of = F.get(F.array(*[F.lit(n) for n in lengths]), F.col("nth"))
    distinct = hashed.select("doc_id", length_of.alias("length"), F.explode(F.array_distinct("prints")).alias("print"))
    touched = distinct.join(prints, ["length", "print"], "left_semi").select(F.col("doc_id").alias("of_doc")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("of_doc"))
    near = _document_prints(words.join(touched, same, "left_semi"), lengths, gram).where("p >= 0 and print is not null")
    texts = near.select("doc_id", "p", "length", _window_text("p", F.col("length")).alias("win"))
    hits = texts.join(known.select("win", "set_id"), "win").select(
        "doc_id", "p", "length", "set_id", F.lit(None).cast("int").alias("n_words")
    )
    own = words.select(
        "doc_id", F.lit(-1).alias("p"), F.lit(0).alias("length"), F.lit(None).cast("long").alias("set_id"), F.size("words").alias("n_words")
    )
    return hits.unionByName(own)


def _prints_of(length: int, gram: int) -> Column:
    """The fingerprints of all windows of a length, in order."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - length))
    inside = F.filter(starts, lambda p: p + length <= F.size("words"))
    return F.transform(inside, lambda p: _fingerprint(F.col("hashes"), p, length, gram))


def _by_document(spans: DataFrame, known: DataFrame) -> DataFrame:
    """Unite the spans of each document, and look up the items of its windows."""
    end = F.when(F.col("n_words").isNull(), F.col("p") + F.col("length")).otherwise(0)
    earlier = W.partitionBy("doc_id").orderBy("p", "length").rowsBetween(W.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("p"), F.coalesce(F.max("end").over(earlier), F.lit(0))))
    united = (
        spans.withColumn("end", end)
        .withColumn("new", new)
        .groupBy("doc_id")
        .agg(
            F.max("n_words").cast("long").alias("n_words"),
            F.sum("new").cast("long").alias("n_hit"),
            F.collect_set("set_id").alias("sets"),
        )
    )
    sets = known.groupBy("set_id").agg(F.first("items").alias("items"))
    whole = united.where("size(sets) > 0").select("doc_id", F.explode("sets").alias("set_id"))
    items = (
        whole.join(sets, "set_id")
        .groupBy("doc_id")
        .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .withColumnRenamed("doc_id", "of_doc")
    )
    return united.join(items, F.col("doc_id").eqNullSafe(F.col("of_doc")), "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )
