"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A document is its set of shingles, runs of five words. Documents of one set are a class, and one of
them stands for it. Signatures of the classes are cut into the branches of the forest's trees. A
tree is a prefix trie: its branches are sorted, so that branches with a common prefix are
neighbours, and a branch that shares no useful prefix with its neighbours leaves at once.

The search starts at whole branches and shortens the prefix. What is found at a depth is verified on
whole sets, and its similarities say how many links that depth misses: a link of similarity s is
found with a known probability, so each link found stands for one divided by that. The prefix is
shortened to the greatest depth whose estimated recall reaches the target, and measured again there.
It needn't go below the depth at which even a forest of links at the bare threshold reaches it.

Verification works in cells, the classes that share a prefix in some tree. Prefixes that the same classes share
are one cell, so a pair of near copies, alike in most trees, meets once, and a class is sent to as many cells as there are
trees at most, however many near copies it has. Two classes are compared in the first tree in which they share the prefix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_by_hot_key
from .components import components
from .textblocks import U64, blocks, mixed, split_words, windows

TREES, DEPTH = 32, 16
SLOTS = TREES * DEPTH
#: Texts that are signed at once, and bins of the similarities found.
SIGNED, BINS = 2048, 20
_NO_ID = (1 << 63) - 1


def found_share(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """The probability that two sets share a prefix of ``depth`` slots in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def forest_depth(similarity: np.ndarray, links: np.ndarray, recall: float) -> int:
    """The longest prefix by which a share ``recall`` of ``links`` of these similarities is found."""
    for depth in range(DEPTH, 1, -1):
        if (links * found_share(similarity, depth)).sum() >= recall * links.sum():
            return depth
    return 1


def shingle_sets(column: pa.Array, size: int = 5, fold: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of texts, their distinct shingle hashes in order: ``first`` (per text), ``hashes``.

    A text of fewer words than a shingle, but not none, is one shingle. ``fold`` takes A-Z as a-z.
    """
    for _, data, offsets in blocks(column):
        if fold:
            data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
        words = split_words(data, offsets)
        hashes = words.hashes()
        found, at = windows(hashes, words.first, size, salt=5)
        text = words.texts()[at] if len(at) else at
        count = np.diff(words.first)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            whole = [np.bitwise_xor.reduce(mixed(hashes[a : a + n] + U64(i) * np.arange(1, n + 1, dtype=U64))) for i, a, n in zip([77] * len(short), words.first[short], count[short], strict=True)]
            found, text = np.concatenate((found, np.array(whole, U64))), np.concatenate((text, short))
        order = np.lexsort((found, text))
        found, text = found[order], text[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
        found, text = found[new], text[new]
        yield np.searchsorted(text, np.arange(len(count) + 1)), found


def signatures(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A byte for each of SLOTS slots of each set, none of which is empty.

    Fast similarity sketching (Dahlgaard, Knudsen, Thorup): in a round each element falls in a slot
    by a new hash, and earlier rounds win; a slot that as many rounds as slots leave empty takes the least
    element. Sets of any size are treated alike, and two sets agree in a slot with a probability of their
    similarity.
    """
    n = len(first) - 1
    out = np.full(n * SLOTS, np.iinfo(U64).max, U64)
    text = np.repeat(np.arange(n), np.diff(first))
    for turn in range(2 * SLOTS):
        h = mixed(hashes ^ U64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        slot = (h & U64(SLOTS - 1)).astype(np.int64) if turn < SLOTS else turn - SLOTS
        np.minimum.at(out, text * SLOTS + slot, (U64(turn) << U64(52)) | (h >> U64(12)))
        if turn < 8 or turn % 16 == 0:
            left = ~(out.reshape(n, SLOTS) != np.iinfo(U64).max).all(1)
            if not left.all():
                still = left[text]
                text, hashes = text[still], hashes[still]
                if not len(text):
                    break
    return mixed(out).reshape(n, SLOTS).astype(np.uint8)


def _sketcher(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for first, hashes in shingle_sets(batch.column(2), size):
                n = np.diff(first)
                signed = np.zeros((len(n), SLOTS), np.uint8)
                for a in range(0, len(n), SIGNED):
                    part = first[a : a + SIGNED + 1]
                    rows = np.flatnonzero(np.diff(part))
                    if len(rows):
                        signed[a + rows] = signatures(np.append(part[rows], part[-1]) - part[0], hashes[part[0] : part[-1]])
                sums = []
                for salt in (11, 12):
                    total = np.concatenate((np.zeros(1, U64), np.cumsum(mixed(hashes + U64(salt)), dtype=U64)))
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(row, len(n)) for i in (0, 1)),
                        pa.array(n, pa.int32()),
                        *(pa.array(s, pa.int64()) for s in sums),
                        _binaries(signed),
                    ],
                    names=["doc_id", "text_hash", "n", "set1", "set2", "signature"],
                )
                row += len(n)

    return sketch


def _binaries(rows: np.ndarray) -> pa.Array:
    """A column of binaries of one size."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _branches(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    column = batch.column("branch")
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at : at + len(column) * DEPTH].reshape(-1, DEPTH)


def _with_neighbours(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sorted branches, those that share ``least`` slots with a neighbour, and ``shared``, how many they share.

    The first and the last branch of a task may have neighbours in other tasks: these stay.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, with_held = None, DEPTH
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            tree, branch = rows["tree"].to_numpy(), _branches(rows)
            same = np.logical_and.accumulate((branch[1:] == branch[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1).sum(1)
            before, after = np.concatenate(([with_held], same)), np.concatenate((same, [DEPTH]))
            last = rows.num_rows - 1
            shared = np.maximum(before, after)[:last]
            found = rows.slice(0, last).append_column("shared", pa.array(shared, pa.int32())).filter(pa.array(shared >= least))
            yield from found.combine_chunks().to_batches()
            held, with_held = rows.slice(last).combine_chunks().to_batches()[0], int(before[last])
        if held is not None:
            yield from pa.Table.from_batches([held]).append_column("shared", pa.array([DEPTH], pa.int32())).to_batches()

    return keep


def _packer(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [h[a:b].tobytes() for first, h in shingle_sets(batch.column(0), size) for a, b in zip(first[:-1], first[1:], strict=True)]
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            names = [batch.schema.field(i).name for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sets, pa.binary())], names=[*names, "shingles"])

    return pack


def _telling_symbols(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """What tells the sets of a cell apart, as pairs of a ``symbol`` and its ``owner``, in order of owner.

    A shingle that some sets have is a symbol of these. One that more than half have is a symbol of the sets
    that lack it, so that near copies have few symbols: ``lack`` counts these per set, and ``n_most`` is their number.
    """
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, symbol, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    most = 2 * df > m
    by_symbol = np.argsort(symbol, kind="stable")
    held, starts = owner[by_symbol], np.concatenate(([0], np.cumsum(df)))
    lacking_symbol, lacking_owner = [], []
    for s in np.flatnonzero(most):
        without = np.ones(m, bool)
        without[held[starts[s] : starts[s + 1]]] = False
        lacking_owner.append(np.flatnonzero(without))
        lacking_symbol.append(np.full(len(lacking_owner[-1]), s))
    some = (df[symbol] > 1) & ~most[symbol]
    none = [np.zeros(0, np.int64)]
    lacks = np.concatenate(lacking_owner + none)
    symbol, owner = np.concatenate([symbol[some], *lacking_symbol, *none]), np.concatenate((owner[some], lacks))
    order = np.argsort(owner, kind="stable")
    return symbol[order].astype(np.int64), owner[order], np.bincount(lacks, minlength=m), int(most.sum())


def _verifier(threshold: float, depth: int) -> Callable[[pa.Table], pa.Table]:
    def verify(cell: pa.Table) -> pa.Table:
        """Links inside a block of a cell (``i`` = ``j``), or between two: per class how many rows it links to and the least class
        that links lead to here, and once how many links there are by similarity."""
        cell = cell.sort_by([("block", "ascending"), ("cls", "ascending")])
        cls, copies, block = (cell[c].to_numpy() for c in ("cls", "copies", "block"))
        sets = [np.frombuffer(b, U64) for b in cell["shingles"].to_pylist()]
        prefix = np.array([np.frombuffer(b, np.uint8) for b in cell["signature"].to_pylist()]).reshape(-1, TREES, DEPTH)[:, :, :depth]
        n = np.array([len(s) for s in sets])
        tree, i, j = (cell[c][0].as_py() for c in ("tree", "i", "j"))
        m, two = len(cls), i != j
        cut = int(np.searchsorted(block, j)) if two else 0
        symbol, owner, lack, n_most = _telling_symbols(sets)
        by_symbol = np.argsort(symbol, kind="stable")
        posting, starts = owner[by_symbol], np.concatenate(([0], np.cumsum(np.bincount(symbol, minlength=int(symbol.max(initial=-1)) + 1))))
        place = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=m))))
        links, label, bins = np.zeros(m, np.int64), np.arange(m), np.zeros(BINS, np.int64)
        for i in range(cut if two else m):
            own = symbol[place[i] : place[i + 1]]
            # symbols of most sets are shared unless one of the two lacks them
            shared = n_most - lack[i] - lack
            sizes = starts[own + 1] - starts[own]
            # two million postings at a time, however common the symbols are
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(1, int(sizes.sum()) // 2_000_000 + 1) * 2_000_000)
            for part in np.split(np.arange(len(own)), cuts):
                if len(part):
                    k = sizes[part]
                    at = np.arange(k.sum()) + np.repeat(starts[own[part]] - (np.cumsum(k) - k), k)
                    shared = shared + np.bincount(posting[at], minlength=m)
            similarity = shared / np.maximum(n[i] + n - shared, 1)
            linked = similarity >= threshold
            linked[: max(cut, i + 1)] = False
            partners = np.flatnonzero(linked)
            # each pair counts in the first tree that has it
            partners = partners[(prefix[partners] == prefix[i]).all(2).argmax(1) == tree]
            if not len(partners):
                continue
            links[i] += copies[partners].sum()
            links[partners] += copies[i]
            place_of = ((similarity[partners] - threshold) / max(1 - threshold, 1e-9) * BINS).astype(np.int64)
            bins += np.bincount(np.minimum(place_of, BINS - 1), minlength=BINS)
            met = np.unique(np.append(label[partners], label[i]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
        least = np.full(m, _NO_ID)
        np.minimum.at(least, label, cls)
        linked = np.flatnonzero((links > 0) | (np.arange(m) == 0))
        similar = [bins.tolist() if i == 0 else None for i in linked]
        columns = {"cls": cls[linked], "links": links[linked], "root": least[label][linked]}
        return pa.table({**{k: pa.array(v, pa.int64()) for k, v in columns.items()}, "similar": pa.array(similar, pa.list_(pa.int64()))})

    return verify


def _verified(tries: DataFrame, sets: DataFrame, depth: int, block: int, threshold: float) -> DataFrame:
    """Links among classes that share ``depth`` slots in some tree: ``cls, links, root, similar``."""
    node = F.xxhash64("tree", F.substring("branch", 1, depth))
    at = checkpoint(tries.where(F.col("shared") >= depth).select("cls", "tree", node.alias("node")))
    who = [F.bit_xor(F.xxhash64("cls", F.lit(salt))).alias(f"who{salt}") for salt in (1, 2)]
    nodes = at.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("tree").alias("tree"), *who).where("n > 1")
    # nodes of the same classes are one cell, named by the first tree
    cells = nodes.groupBy("n", "who1", "who2").agg(F.min(F.struct("tree", "node"))["node"].alias("node"))
    cells = checkpoint(cells.select("node", "n"))
    held = join_by_hot_key(at, cells, ["node"], "n")
    # a cell of many classes is cut in blocks, and each two of these meet
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    held = held.select("node", "tree", "cls", blocks.alias("blocks"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"))
    met = held.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("node", "tree", "cls", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    dealt = met.join(sets, "cls").select("node", "tree", "i", "j", "cls", "copies", "block", "signature", "shingles")
    found = dealt.groupBy("node", "i", "j").applyInArrow(_verifier(threshold, depth), "cls long, links long, root long, similar array<long>")
    return checkpoint(found)


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    recall: float = 0.999,
    block: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, class_id, n_links, copies_of, n_shingles, text_hash, kept``.

    ``n_links`` counts the other rows whose set of shingles has a Jaccard similarity of at least
    ``threshold``; ``class_id`` is the smallest id that links lead to, over any number of links;
    ``copies_of`` is the smallest id with the same set. ``kept`` marks the row that stands for all that links
    lead to, with the smallest id, then ``text_hash``, which is ``xxhash64`` of the text; rows of one id and text
    share the mark. Null and blank texts have no shingles and no links, and are kept; a null id counts as the largest. Rows that repeat an id or have none are rows of
    their own: those of one set link to each other, and those of different texts are different classes. Other
    columns are ignored. A share ``recall`` of the links, by estimate, is found at least; all found are exact,
    on 64-bit hashes of the shingles.

    Copies are merged in each task before they are shuffled. Classes are verified in blocks of some
    ``block``, one task group for each two blocks of a cell, which emits counts and a forest of links, never the pairs.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    sketches = checkpoint(
        rows.mapInArrow(_sketcher(shingle), "doc_id long, text_hash long, n int, set1 long, set2 long, signature binary")
    )
    classes = checkpoint(
        sketches.where("n > 0")
        .groupBy("set1", "set2", "n")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"))
        .select("set1", "set2", "n", "rep.*", "copies", "signature", F.monotonically_increasing_id().alias("cls"))
    )
    edges = threshold + np.arange(BINS) * (1 - threshold) / BINS
    least = forest_depth(edges[:1], np.ones(1), recall)
    branch = F.substring("signature", F.col("tree") * DEPTH + 1, F.lit(DEPTH))
    branches = classes.select("cls", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("tree", branch.alias("branch"), "cls")
    sorted_branches = branches.repartitionByRange("tree", "branch", "cls").sortWithinPartitions("tree", "branch", "cls")
    tries = checkpoint(sorted_branches.mapInArrow(_with_neighbours(least), "tree int, branch binary, cls long, shared int"))
    members = classes.join(tries.select("cls").distinct(), "cls", "left_semi").select("doc_id", "text_hash", "cls", "copies", "signature")
    texts = rows.join(members, ["doc_id", "text_hash"]).dropDuplicates(["cls"]).select("text", "cls", "copies", "signature")
    sets = checkpoint(texts.mapInArrow(_packer(shingle), "cls long, copies long, signature binary, shingles binary"))
    depth = DEPTH
    while True:
        found = _verified(tries, sets, depth, block, threshold)
        counts = found.where("similar is not null").select(F.posexplode("similar").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n"))
        similar = np.zeros(BINS)
        for r in counts.collect():
            similar[r["bin"]] = r["n"]
        # each link found stands for those like it that this depth misses; one more at the threshold, for what none stands for
        links = similar / found_share(edges, depth)
        links[0] += 1
        needed = max(least, forest_depth(edges, links, recall))
        if needed >= depth:
            break
        depth = needed
    linked = found.where("links > 0")
    links = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    rep = F.struct("doc_id", "text_hash")
    first = roots.join(classes.select("cls", rep.alias("rep")), "cls").groupBy("root").agg(F.min("rep").alias("first"))
    linked_to = links.join(roots, "cls").join(first, "root").select("cls", "links", "first")
    own = classes.select("set1", "set2", "n", F.col("doc_id").alias("copies_of"), rep.alias("rep"), "copies", "cls")
    named = own.join(linked_to, "cls", "left").withColumn("first", F.coalesce("first", "rep")).drop("cls", "rep")
    named = checkpoint(named)
    with_sets = join_by_hot_key(sketches.where("n > 0").select("doc_id", "text_hash", "n", "set1", "set2"), named, ["set1", "set2", "n"], "copies")
    known = [
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "copies_of",
        F.col("n").cast("long").alias("n_shingles"),
        "text_hash",
        (rep == F.col("first")).alias("kept"),
    ]
    blank = ["doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copies_of")]
    blank += [F.lit(0).cast("long").alias("n_shingles"), "text_hash", F.lit(True).alias("kept")]
    every = with_sets.select(*known).unionByName(sketches.where("n = 0").select(*blank))
    return every.select(*[F.when(F.col(c) != _NO_ID, F.col(c)).alias(c) if c in ("doc_id", "class_id", "copies_of") else c for c in every.columns])
