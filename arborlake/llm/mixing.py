"""Mix sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is a stream of words: its documents, permuted by a keyed hash, one after another. The
stream is cut into blocks. A source's target fixes how many blocks the mix draws from it, exactly
and as often over as needed. A binary tree splits these quotas among the output shards: at each
node, the left child gets a multivariate-hypergeometric share, as if the node's blocks were
shuffled and cut in the middle. A shard then draws its share of each source's permuted blocks,
disjoint from every other shard's, and orders them by a hash of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, space_word_count, text_or_empty, unit_hash

#: Multipliers of the block permutation, primes: one at least has no factor in common with the number of blocks.
_PRIMES = (1_000_003, 999_983, 1_000_033)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Targets of sources: ``sizes`` (``source``, ``source_size``) plus ``weight`` and ``target``.

    Sources in code-point order, null last, weigh ``weights`` in turn. All sizes together are
    shared by weight; a target stops at ``most`` times its source's size, and the excess is shared
    again. That ends at one level: each target is the lesser of its cap and level x weight. Sorted
    by cap / weight, the capped sources come first, so the level follows from running sums.
    One row per source passes through one task.
    """
    ordered = sizes.withColumn("nth", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ordered.withColumn("weight", F.get(cycle, F.pmod("nth", F.lit(len(weights))))).withColumn(
        "cap", F.col("source_size") * F.lit(float(most))
    )
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = F.try_divide(
        F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)),
    )
    capped = weighed.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "nth", "level"))).over(everything)
    return capped.withColumn("rest", rest["level"]).select(
        "source",
        "nth",
        "source_size",
        "weight",
        F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("rest") * F.col("weight"))).alias("target"),
    )


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``marked`` among ``total`` are in ``drawn``: inversion of a uniform number.

    Weights follow from each other by ratios, from ten deviations below the mode to ten above it.
    """
    total_d, marked_d, drawn_d = (c.cast("double") for c in (total, marked, drawn))
    mode = F.floor((drawn_d + 1) * (marked_d + 1) / (total_d + 2))
    sd = F.sqrt(drawn_d * marked_d * (total_d - marked_d)) / F.greatest(total_d, F.lit(1.0))
    reach = F.ceil(10 * sd) + 10
    first = F.greatest(F.lit(0).cast("long"), drawn + marked - total, mode - reach)
    last = F.greatest(first, F.least(drawn, marked, mode + reach))

    def ratio(k: Column) -> Column:
        k = k.cast("double")
        return (marked_d - k) * (drawn_d - k) / ((k + 1) * (total_d - marked_d - drawn_d + k + 1))

    def begin(goal: Column) -> Column:
        return F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), first.alias("pick"), goal.alias("goal"))

    def step(state: Column, k: Column) -> Column:
        s = state["s"] + state["w"]
        return F.struct(
            F.when(k < last, state["w"] * ratio(k)).otherwise(F.lit(0.0)).alias("w"),
            s.alias("s"),
            F.when(s <= state["goal"], F.least(k + 1, last)).otherwise(state["pick"]).alias("pick"),
            state["goal"].alias("goal"),
        )

    every = F.sequence(first, last)
    mass = F.aggregate(every, begin(F.lit(0.0)), step, lambda st: st["s"])
    return F.aggregate(every, begin(u * mass), step, lambda st: st["pick"])


def _share(seed: int, level: int) -> Callable[[Column, Column], Column]:
    """The step that gives the left child its share of one more source's blocks."""

    def step(state: Column, count: Column) -> Column:
        u = unit_hash(F.lit(seed), F.lit(level), F.col("node"), F.size(state["got"]))
        got = _hypergeometric(state["rest"], count, state["draws"], u).cast("long")
        return F.struct(
            (state["rest"] - count).alias("rest"),
            (state["draws"] - got).alias("draws"),
            F.array_append(state["got"], got).alias("got"),
        )

    return step


def split_quotas(sources: DataFrame, depth: int, seed: int) -> DataFrame:
    """Split block quotas among ``2 ** depth`` shards: ``nth, shard, blocks``.

    ``sources`` has ``nth`` (0 up) and ``quota``. Nodes are rows that hold one count per source,
    so the tree is as large as sources x shards, whatever the number of documents.
    """
    quotas = F.sort_array(F.collect_list(F.struct("nth", "quota")))
    node = sources.agg(F.transform(quotas, lambda x: x["quota"]).alias("counts")).select(
        F.lit(0).cast("long").alias("node"), "counts"
    )
    for level in range(depth):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        begin = F.struct(
            total.alias("rest"),
            F.floor((total + 1) / 2).cast("long").alias("draws"),
            F.array().cast("array<bigint>").alias("got"),
        )

        halves = node.withColumn("left", F.aggregate("counts", begin, _share(seed, level), lambda s: s["got"]))
        node = halves.select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")),
                    F.struct(
                        (F.col("node") * 2 + 1).alias("node"),
                        F.zip_with("counts", "left", lambda a, b: a - b).alias("counts"),
                    ),
                )
            ).alias("child")
        ).select("child.*")
    return node.select(F.col("node").alias("shard"), F.posexplode("counts").alias("nth", "blocks"))


def _streams(sized: DataFrame, seed: int) -> DataFrame:
    """Each row's place ``first_word`` in the permuted stream of its source.

    Two levels of running sums, over ranges of the hash and then inside them, keep both the ranges
    of a source and the rows of a range near the square root of the rows, hot source or not.
    """
    n = sized.count()
    bits = max(1, math.ceil(math.log2(max(2, n)) / 2))
    key = F.xxhash64(F.lit(seed), "doc_id")
    keyed = sized.withColumn("key", key).withColumn("part", F.shiftrightunsigned("key", 64 - bits).cast("long"))
    parts = keyed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        F.col("source").alias("part_source"),
        F.col("part").alias("of_part"),
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("part_start"),
    )
    inside = W.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = placed["source"].eqNullSafe(parts["part_source"]) & (placed["part"] == parts["of_part"])
    return placed.join(parts, same).select(
        "row", "doc_id", "source", "size", (F.col("part_start") + F.col("inside")).alias("first_word")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    most: float = 3.0,
    depth: int = 4,
    block_words: int = 512,
    least_blocks: int = 1024,
    most_sources: int = 100_000,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: ``row, doc_id, source, size, source_size, target, pieces``.

    ``pieces`` lists the parts of the document that the mix takes: ``block``, ``pass`` (0 up, when
    a source is read more than once), ``shard``, ``slot`` (the order inside the shard), and
    ``first_word`` and ``n_words`` inside the document. A source's pieces together differ from its
    target by at most half a block, and a source has ``least_blocks`` blocks at least, or one per
    word. A null or blank text has size 0 and no pieces; a null source is a source. Repeated rows
    are documents of their own, told apart by ``row``, which numbers the rows of one run. Reruns give the same
    rows but for that number. A node of the tree holds a count for each source, so more
    sources than ``most_sources`` are refused.
    """
    sized = checkpoint(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            space_word_count(text_or_empty(text_col)).alias("size"),
        )
    )
    totals = checkpoint(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    if (n := totals.count()) > most_sources:
        raise ValueError(f"{n} sources, where {most_sources} at most can be mixed")
    targets = source_targets(totals, weights, most)
    size = F.col("source_size")
    blocks = F.least(size, F.greatest(F.lit(least_blocks), F.ceil(size / F.lit(block_words)))).cast("long")
    sources = targets.withColumn("n_blocks", blocks).withColumn(
        "quota", F.coalesce(F.rint(F.try_divide(F.col("target") * F.col("n_blocks"), size)), F.lit(0.0)).cast("long")
    )
    sources = checkpoint(sources)
    upto = W.partitionBy("nth").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    bounds = (
        split_quotas(sources, depth, seed)
        .withColumn("bound", F.sum("blocks").over(upto))
        .groupBy("nth")
        .agg(F.sort_array(F.collect_list("bound")).alias("bounds"))
    )
    multiplier = F.lit(_PRIMES[-1])
    for p in _PRIMES[-2::-1]:
        multiplier = F.when(F.col("n_blocks") % p != 0, F.lit(p)).otherwise(multiplier)
    sources = sources.join(bounds, "nth").select(
        F.col("source").alias("of_source"),
        "source_size",
        "target",
        "n_blocks",
        "quota",
        "bounds",
        F.expr("source_size div greatest(n_blocks, 1)").alias("narrow"),
        F.pmod("source_size", F.greatest("n_blocks", F.lit(1))).alias("n_wide"),
        multiplier.cast("long").alias("multiplier"),
    )
    placed = _streams(sized, seed)
    joined = placed.join(sources, placed["source"].eqNullSafe(sources["of_source"]))
    wide = F.col("n_wide") * (F.col("narrow") + 1)

    def block_of(word: Column) -> Column:
        """The first ``n_wide`` blocks have one word more than the others."""
        return F.when(word < wide, F.floor(word / (F.col("narrow") + 1))).otherwise(
            F.col("n_wide") + F.floor((word - wide) / F.greatest("narrow", F.lit(1)))
        )

    def start_of(block: Column) -> Column:
        return block * F.col("narrow") + F.least(block, F.col("n_wide"))

    first, end = F.col("first_word"), F.col("first_word") + F.col("size")
    passes = F.sequence(F.lit(0).cast("long"), F.lit(math.ceil(most) - 1).cast("long"))

    def drawn(block: Column) -> Column:
        turn = F.pmod(block * F.col("multiplier") + seed, F.col("n_blocks"))
        piece_first, piece_end = F.greatest(first, start_of(block)), F.least(end, start_of(block + 1))
        # the shards' shares, from the splitting tree, end where the source's quota does
        wanted = F.filter(passes, lambda e: e * F.col("n_blocks") + turn < F.element_at("bounds", -1))

        def piece(e: Column) -> Column:
            draw = e * F.col("n_blocks") + turn
            return F.struct(
                block.alias("block"),
                e.alias("pass"),
                F.size(F.filter("bounds", lambda b: b <= draw)).alias("shard"),
                F.xxhash64(F.lit(seed), "source", draw).alias("slot"),
                (piece_first - first).alias("first_word"),
                (piece_end - piece_first).alias("n_words"),
            )

        return F.transform(wanted, piece)

    pieces = F.when(
        F.col("size") > 0, F.flatten(F.transform(F.sequence(block_of(first), block_of(end - 1)), drawn))
    ).otherwise(F.array().cast("array<struct<block:bigint,pass:bigint,shard:int,slot:bigint,first_word:bigint,n_words:bigint>>"))
    return joined.select("row", "doc_id", "source", "size", "source_size", "target", pieces.alias("pieces"))


def taken_words(pieces: str = "pieces") -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda total, p: total + p["n_words"])


def shard_order(mixed: DataFrame) -> DataFrame:
    """The mix as rows, one per piece, in ranges of (shard, slot), so that a shard may have many files.

    ``shard, slot, place, row, doc_id, ...``; ``place`` numbers the pieces in the order they are read: by
    shard, and inside a shard in the order of the local shuffle. Numbers of a later range are larger.
    """
    rows = mixed.select("row", "doc_id", "source", F.explode("pieces").alias("p")).select("row", "doc_id", "source", "p.*")
    in_order = rows.repartitionByRange("shard", "slot", "row").sortWithinPartitions("shard", "slot", "row", "first_word")
    return in_order.withColumn("place", F.monotonically_increasing_id())


def drawn_words(mixed: DataFrame) -> DataFrame:
    """What the shards take of each document, from their ordered pieces: a row per input row, with its columns but ``pieces``,
    and ``taken`` (words), ``n_pieces``, ``shards`` (in order) and ``first_place``."""
    mixed = checkpoint(mixed)
    taken = shard_order(mixed).groupBy("row").agg(
        F.sum("n_words").alias("taken"),
        F.count(F.lit(1)).alias("n_pieces"),
        F.sort_array(F.collect_set("shard")).alias("shards"),
        F.min("place").alias("first_place"),
    )
    none = {"taken": F.lit(0).cast("long"), "n_pieces": F.lit(0).cast("long"), "shards": F.array().cast("array<int>")}
    joined = mixed.drop("pieces").join(taken, "row", "left")
    return joined.withColumns({name: F.coalesce(name, value) for name, value in none.items()})
