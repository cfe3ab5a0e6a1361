"""A prefix trie of conversations, from one global sort.

A conversation is an array of turns, each turn a digest of its role and text. The arrays are range-sorted over
all tasks, so that the conversations that begin alike are neighbours. A task goes through its range once: how
many turns a conversation shares with the one before says which nodes end there and which go on, and a stack
holds the nodes that are open. A node that ends adds what it knows to its parent, and is written.

What is open at the two ends of a range may go on in the next one. Each task therefore hands on its open stacks,
two at most, as paths with what each of their nodes knows so far. These are swept in the same way, 64 ranges at a
time, and so on until one group is left, whose stacks are whole. Each level has a thirty-second of the
paths of the one before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, join_by_hot_key, stored

#: Bytes of a turn's digest and of a node's key; ids of one row; ranges whose open stacks are swept together.
DIGEST, RUN, FAN = 16, 4096, 64
#: Characters of role and text that order turns of the same number.
_TIES = 64
_NONE = (1 << 63) - 1
_NODE, _IDS, _OPEN = 0, 1, 2
_OUT = "kind int, key binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ids array<long>, many boolean, part long, side int, path binary, lowest long, known binary"
_TYPES = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


@dataclass
class Trie:
    """``nodes``, one row each, and ``runs``: the ids that end at nodes whose ids aren't all in their own row."""

    nodes: DataFrame
    runs: DataFrame


def turn_digests(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, points``: the turns in order from 1, each as a digest and its text's code points.

    Turns are ordered by ``turn``, null first; those of one number by the first 64 characters of role and text, then by
    digest. Null role and text are empty. Rows without ``conv_id`` belong to no conversation. Other columns are
    ignored. Texts aren't shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.substring(role, 1, _TIES).alias("role"),
        F.substring(text, 1, _TIES).alias("text"),
        F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST).alias("digest"),
        F.char_length(text).alias("points"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "digest")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "digest", "points")


def share_openings(turns: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin with the turns of the first of their block.

    Conversation c takes the first h turns of conversation c - c % ``block``, where h is crc32 of its decimal id
    modulo ``most`` (all if that one has fewer, none if there is no such conversation), then its own turns after its first h. One without
    turns left has a row whose ``pos`` is null. ``turns`` is read three times and should be stored. For ids below zero the
    remainder has the sign of c.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    ids = turns.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("first"), h.alias("h"))
    opening = turns.where((F.col("pos") < most) & (F.col("conv_id") % block == 0)).withColumnRenamed("conv_id", "first")
    taken = ids.join(opening, "first").where("pos <= h").select("conv_id", "pos", "digest", "points")
    own = turns.where(F.col("pos") > h)
    # a row for each conversation, whether or not a turn is left to it
    empty = ids.select("conv_id", *[F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in ("pos", "digest", "points")])
    return taken.unionByName(own).unionByName(empty)


def _shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    x, y = (np.frombuffer(c, np.uint8, n) for c in (a, b))
    return int((x != y).argmax()) // DIGEST


class _Slot:
    """An open node: members and what its ended children told it."""

    __slots__ = ("ids", "key", "kept_open", "least", "many", "n", "n_children", "n_leaves", "points", "saved")

    def __init__(self, key: bytes, points: int, kept_open: bool) -> None:
        self.key, self.points, self.kept_open = key, points, kept_open
        self.n = self.n_children = self.n_leaves = self.saved = 0
        self.least, self.ids, self.many = _NONE, [], False

    def known(self) -> tuple[int, ...]:
        return self.n, self.least, self.n_children, self.n_leaves, self.saved, self.points, int(self.many)


class _Sweep:
    """Goes through sorted paths with a stack of open nodes; ``rows`` gathers what is to be written."""

    def __init__(self, whole: bool) -> None:
        #: Whether what is open at the ends is known to end there.
        self.whole = whole
        self.stack: list[_Slot] = []
        self.rows: list[tuple] = []
        self.path: bytes | None = None
        self.first: bytes = b""
        self.left: list[_Slot] = []

    def _put(self, kind: int, **values: object) -> None:
        self.rows.append((kind, *(values.get(c) for c in _NAMES[1:])))

    def _spill(self, slot: _Slot) -> None:
        """Write the ids of a node in a row of their own."""
        if slot.ids:
            self._put(_IDS, key=slot.key, conv_id=slot.ids[0], ids=slot.ids)
            slot.ids, slot.many = [], True

    def _end(self, slot: _Slot, depth: int) -> None:
        """The deepest open node ends."""
        if slot.kept_open:
            self._spill(slot)
            self.left.append(slot)
            return
        if slot.many:
            self._spill(slot)
        leaves = slot.n_leaves if slot.n_children else 1
        saved = slot.saved + (slot.n - 1) * slot.points
        parent = self.stack[-1] if self.stack else None
        self._put(
            _NODE, key=slot.key, parent=parent.key if parent else None, depth=depth, conv_id=slot.least, n_convs=slot.n, n_children=slot.n_children,
            n_leaves=leaves, saved_tokens=saved, ids=None if slot.many else slot.ids, many=slot.many,
        )
        if parent:
            parent.n += slot.n
            parent.least = min(parent.least, slot.least)
            parent.n_children += 1
            parent.n_leaves += leaves
            parent.saved += saved

    def go(self, path: bytes, points: list[int] | np.ndarray, lowest: int = 1) -> None:
        """Come to the next path; ``points`` are the code points of its turns from depth ``lowest`` on."""
        first = self.path is None
        shared = -1 if first else _shared_turns(self.path, path)
        while len(self.stack) > shared + 1:
            depth = len(self.stack) - 1
            self._end(self.stack.pop(), depth)
        for depth in range(len(self.stack), len(path) // DIGEST + 1):
            above = self.stack[-1].key + path[(depth - 1) * DIGEST : depth * DIGEST] if depth else b""
            key = hashlib.blake2b(above, digest_size=DIGEST).digest()
            self.stack.append(_Slot(key, int(points[depth - lowest]) if depth >= max(lowest, 1) else 0, first and not self.whole))
        if first:
            self.first = path
        self.path = path

    def ends(self, conv_id: int) -> None:
        """A conversation ends at the deepest open node."""
        slot = self.stack[-1]
        slot.n += 1
        slot.least = min(slot.least, conv_id)
        slot.ids.append(conv_id)
        if len(slot.ids) >= RUN:
            self._spill(slot)

    def learn(self, lowest: int, known: np.ndarray) -> None:
        """Add what other tasks know of the open nodes from depth ``lowest`` on."""
        for slot, (n, least, n_children, n_leaves, saved, points, many) in zip(self.stack[lowest:], known.tolist(), strict=True):
            slot.n += n
            slot.least = min(slot.least, least)
            slot.n_children += n_children
            slot.n_leaves += n_leaves
            slot.saved += saved
            slot.points = points
            slot.many = slot.many or bool(many)

    def close(self, part: int) -> None:
        """End all nodes, or hand on those that may go on in other tasks."""
        if self.whole:
            while self.stack:
                slot = self.stack.pop()
                self._end(slot, len(self.stack))
        elif self.path is not None:
            for slot in self.stack:
                self._spill(slot)
            if self.left:
                self._open(part, 0, self.first, self.left[::-1])
            self._open(part, 1, self.path, self.stack)

    def _open(self, part: int, side: int, path: bytes, slots: list[_Slot]) -> None:
        known = np.array([s.known() for s in slots], np.int64)
        self._put(_OPEN, part=part, side=side, path=path, lowest=len(path) // DIGEST + 1 - len(slots), known=known.tobytes())

    def written(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(_NAMES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _sweep_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the sorted conversations."""
    sweep = _Sweep(whole=False)
    for batch in batches:
        for conv_id, path, points in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "points")), strict=True):
            sweep.go(path, points)
            sweep.ends(conv_id)
            if len(sweep.rows) >= RUN:
                yield sweep.written()
    sweep.close(TaskContext.get().partitionId())
    yield sweep.written()


def _sweep_stacks(whole: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """The open stacks of some ranges in order."""

    def sweep_stacks(key: tuple, stacks: pa.Table) -> pa.Table:
        sweep = _Sweep(whole)
        for row in stacks.sort_by([("part", "ascending"), ("side", "ascending")]).to_pylist():
            known = np.frombuffer(row["known"], np.int64).reshape(-1, 7)
            lowest = row["lowest"]
            sweep.go(row["path"], known[:, 5], lowest)
            sweep.learn(lowest, known)
        sweep.close(key[0].as_py())
        return pa.Table.from_batches([sweep.written()])

    return sweep_stacks


def _paths(turns: DataFrame) -> DataFrame:
    """``conv_id, path, points``: a conversation's digests end to end, and the code points of each turn."""
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "digest", "points"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    return rows.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["points"]).alias("points"))


def prefix_trie(turns: DataFrame) -> Trie:
    """The trie of conversations given as ``conv_id, pos, digest, points``; ``pos`` null stands for none.

    A node is a sequence of turns that conversations begin with, its members; the root has no turns. ``nodes`` has
    ``key, parent`` (digests of the sequence), ``depth``, ``conv_id`` (the smallest member), ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves`` (nodes without children in the subtree), ``saved_tokens`` (over the subtree, members but
    one times code points of the last text), and ``ids``: the members that have no further turn, ascending. Where ``many`` is true,
    these are in ``runs`` instead, in rows of 4,096 at most. No conversations, no nodes.

    Equal sequences are sorted by id, so any number of copies is spread over tasks. A conversation's digests are one row
    of 16 bytes a turn, its texts aren't.
    """
    spark = turns.sparkSession
    paths, sorted_from = stored(_paths(turns))
    ranged = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    level, _ = stored(ranged.mapInArrow(_sweep_range, _OUT))
    forget(spark, sorted_from)
    runs = level.where(F.col("kind") == _IDS).select("key", "conv_id", "ids")
    nodes = level.where(F.col("kind") == _NODE)
    parts = level.agg(F.max("part")).first()[0]
    while parts is not None:
        groups = parts // FAN + 1
        stacks = level.where(F.col("kind") == _OPEN).withColumn("group", F.floor(F.col("part") / FAN))
        level, _ = stored(stacks.groupBy("group").applyInArrow(_sweep_stacks(groups == 1), _OUT))
        nodes = nodes.unionByName(level.where(F.col("kind") == _NODE))
        parts = groups - 1 if groups > 1 else None
    known = nodes.select("key", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ids", "many")
    above, _ = stored(known.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n")))
    below = join_by_hot_key(known.where("depth > 0"), above, ["parent"], "n").drop("n")
    root = known.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return Trie(below.unionByName(root.select(*below.columns)), runs)


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each key, which come in order."""
    last, told = None, None
    for batch in batches:
        keys, digests = [], []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != last:
                if last is not None:
                    keys.append(last)
                    digests.append(told.hexdigest())
                last, told = key, hashlib.sha256()
                told.update(",".join(map(str, ids)).encode())
            else:
                told.update(("," + ",".join(map(str, ids))).encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([told.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def ends_digest(trie: Trie) -> DataFrame:
    """The nodes with ``ends_sha256`` of the ids that end there, in decimal, ascending and joined by commas.

    SHA-256 reads its bytes in order, so the rows of one node's ids, 4,096 in each, are sorted on disk and read one
    after the other; never more than one row is held.
    """
    listed: Column = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    few = trie.nodes.where("not many").withColumn("ends_sha256", F.sha2(listed, 256))
    ordered = trie.runs.repartition("key").sortWithinPartitions("key", "conv_id")
    digests = ordered.select("key", "ids").mapInArrow(_digest_runs, "key binary, ends_sha256 string")
    return few.unionByName(trie.nodes.where("many").join(digests, "key").select(*few.columns))
