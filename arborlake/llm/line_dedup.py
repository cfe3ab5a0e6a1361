"""Line deduplication: suffix array over line sequences by distributed prefix doubling.

Each line is a symbol, and each place where a line starts is a suffix. Ranks by the first line come
from sorting the distinct repeated lines; ranks by the first 2 h lines come from sorting the
distinct pairs (rank by h here, rank by h at h lines further on). Suffixes that are alone in their
rank can't be part of a longer repeat and leave; doubling ends when no rank is shared.

Suffixes of one rank are an interval of the suffix array whose longest common prefix is at least the
rank's depth. Its first place stays, and the others are later copies of so many lines. A run of
any length is a later copy of an earlier one exactly when copies of the greatest power of two
that fits cover it from both ends, so the ranks' depths give all maximal runs: copies that overlap are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_WORD, checkpoint, join_by_hot_key, text_or_empty

_DOC = ("doc_id", "text_hash")
_PLACE = (*_DOC, "line_no")


def _ranked(places: DataFrame, *keys: str) -> DataFrame:
    """Keys that several places share: ``rank`` in sort order, ``n`` places, and the first of these, ``origin``.

    Ranges are sorted apart, and the numbers of a later range are larger.
    """
    shared = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_PLACE)).alias("origin")).where("n > 1")
    in_order = shared.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return checkpoint(in_order.withColumn("next", F.monotonically_increasing_id()))


def suffix_ranks(docs: DataFrame) -> list[DataFrame]:
    """For depths 1, 2, 4 and so on, the places whose next lines occur elsewhere too.

    ``docs`` has ``doc_id`` and ``body``; a row is ``doc_id, text_hash, line_no, rank, origin``. Equal
    ranks mean equal lines, compared by 128-bit hash, and ranks sort as these hashes do. ``origin`` is
    the first place of the rank. The last depth is the last one that two places share.

    A line that a third of the documents hold is counted in each task before it is shuffled, and
    gets its rank by broadcast, as all frequent ones do.
    """
    lines = docs.select("doc_id", F.xxhash64("body").alias("text_hash"), F.posexplode(F.split("body", "\n", -1)).alias("line_no", "line"))
    places = checkpoint(lines.select(*_PLACE, F.unhex(F.md5("line")).alias("here")))
    keys = ["here"]
    found: list[DataFrame] = []
    while not (ranks := _ranked(places, *keys)).isEmpty():
        at = join_by_hot_key(places, ranks, keys, "n").select(*_PLACE, F.col("next").alias("rank"), "origin")
        # rows that repeat an id and a text are one document
        at = checkpoint(at if found else at.dropDuplicates(list(_PLACE)))
        found.append(at)
        h = 1 << (len(found) - 1)
        ahead = W.partitionBy(*_DOC).orderBy("line_no").rangeBetween(h, h)
        pairs = at.select(*_PLACE, F.col("rank").alias("here"), F.first("rank").over(ahead).alias("then")).where("then is not null")
        places, keys = checkpoint(pairs), ["here", "then"]
    return found


def repeated_runs(docs: DataFrame) -> DataFrame | None:
    """Later copies as maximal runs, ``doc_id, text_hash, first_line, n_lines``; None where no line repeats.

    Copies that share a line with the next one are one run.
    """
    copies = None
    for k, at in enumerate(suffix_ranks(docs)):
        later = at.where(~F.struct(*_PLACE).eqNullSafe(F.col("origin"))).select(*_PLACE, F.lit(1 << k).alias("depth"))
        copies = later if copies is None else copies.unionByName(later)
    if copies is None:
        return None
    by_doc = W.partitionBy(*_DOC).orderBy("line_no")
    longest = copies.groupBy(*_PLACE).agg(F.max("depth").alias("depth")).withColumn("end", F.col("line_no") + F.col("depth"))
    before = F.max("end").over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    runs = longest.withColumn("begins", F.coalesce(F.col("line_no") >= before, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("begins").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*_DOC, "run").agg(
        F.min("line_no").alias("first_line"), (F.max("end") - F.min("line_no")).alias("n_lines")
    ).drop("run")


def _between(lines: Column, runs: Column) -> Column:
    """The lines outside ``runs``, which are in order and apart: one slice for each gap."""

    def gap(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["first_line"] + F.get(runs, i - 1)["n_lines"])
        stop = F.when(i == F.size(runs), F.size(lines)).otherwise(F.get(runs, i)["first_line"])
        return F.slice(lines, start + 1, stop - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), gap))


def remove_repeated_lines(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its columns, with ``text_col`` less the deleted lines, and ``n_lines``, ``n_removed``.

    The lines of a maximal run go when it is a later copy, by document id, then text hash, then line number, and
    holds ``min_words`` words at least: one long line is enough, blank lines alone never are. Runs
    are judged on the input, of one line or any number. Lines end at a line feed and are compared
    byte for byte by 128-bit hash. A null text stays null and is one empty line. A null id comes
    first. Rows that repeat an id and a text are one document for the comparison, and each returns
    a row. ``n_lines`` and ``n_removed`` replace input columns of these names.
    """
    own = docs.drop("n_lines", "n_removed")
    lines = F.split(text_or_empty(text_col), "\n", -1)
    runs = repeated_runs(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("body")))
    if runs is None:
        return own.withColumns({"n_lines": F.size(lines).cast("long"), "n_removed": F.lit(0).cast("long")})
    gone = runs.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("first_line", "n_lines"))).alias("__runs"))
    gone = gone.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("__hash"))
    joined = own.join(gone, same, "left").withColumn("__lines", lines)

    def counts(run: Column) -> Column:
        text = F.array_join(F.slice("__lines", run["first_line"] + 1, run["n_lines"]), " ")
        return F.regexp_count(text, F.lit(SPACE_WORD)) >= min_words

    counted = joined.withColumn("__runs", F.filter("__runs", counts))
    n_removed = F.aggregate("__runs", F.lit(0), lambda total, run: total + run["n_lines"])
    kept = F.array_join(_between(F.col("__lines"), F.col("__runs")), "\n")
    return counted.withColumns(
        {
            text_col: F.when(F.size("__runs") > 0, kept).otherwise(F.col(text_col)),
            "n_lines": F.size("__lines").cast("long"),
            "n_removed": F.coalesce(n_removed, F.lit(0)).cast("long"),
        }
    ).drop("__id", "__hash", "__runs", "__lines")
