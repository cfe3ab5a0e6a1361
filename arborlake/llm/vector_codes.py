"""Vector codes: each part of a vector becomes the number of the nearest entry of that part's codebook.

The codebooks come from Lloyd's rounds on integers, with Elkan's bounds. For every part the table of a round
keeps an upper bound of the distance to the part's entry and a lower bound of the distance to each of all
entries. In the next round the bounds are shifted by how far the entries moved. An entry is left out only where
the triangle inequality proves it strictly farther, so ties are never decided by a bound: what remains is
compared by exact integer distances, the lower index first. Bounds are whole numbers, upper ones rounded up and
lower ones down, so no rounding error can make them wrong.

A round reads the table of the one before once, and writes the next table together with each task's sums per
entry; the sums are added up in Spark, and only the codebooks, of as many numbers as ``entries`` vectors hold,
come to the driver. The table before the last is removed as soon as the next is written.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, join_by_hot_key, stored

_FAR = np.iinfo(np.int64).max


@dataclass
class Codes:
    """``rows`` (``vec_id, label, code, error``) and ``books`` (part, entry, place in the part)."""

    rows: DataFrame
    books: np.ndarray


def floor_root(squares: np.ndarray) -> np.ndarray:
    """The whole part of square roots, exact for 64-bit integers below 2 ** 62."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def ceil_root(squares: np.ndarray) -> np.ndarray:
    root = floor_root(squares)
    return root + (root * root < squares)


@dataclass
class Round:
    """What a task needs to assign parts: the codebooks, how far entries moved, how far they lie apart."""

    books: np.ndarray
    moved: np.ndarray
    #: Lower bounds are stored in a byte, in steps of ``1 << was`` in the table read and ``1 << now`` in the one written.
    was: int
    now: int

    @classmethod
    def after(cls, books: np.ndarray, before: np.ndarray | None, was: int) -> Round:
        moved = np.zeros(books.shape[:2], np.int64) if before is None else ceil_root(((books - before) ** 2).sum(2))
        apart = ((books[:, :, None] - books[:, None]) ** 2).sum(3)
        widest = int(floor_root(apart.reshape(-1)).max(initial=0))
        return cls(books, moved, was, max(0, (2 * widest).bit_length() - 8))

    def assign(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Assign the parts ``x`` (row, part, place) anew; ``a``, ``upper`` and ``lower`` change in place."""
        for p, book in enumerate(self.books):
            apart = floor_root(((book[:, None] - book[None]) ** 2).sum(2))
            own, up, low = a[:, p].astype(np.int64), upper[:, p], lower[:, :, p]
            up += self.moved[p][own]
            np.maximum(low - self.moved[p], 0, out=low)
            near = ~((up[:, None] < low) | (2 * up[:, None] < apart[own]))
            near[np.arange(len(own)), own] = False
            rows = np.flatnonzero(near.any(1))
            if not len(rows):
                continue
            mine = own[rows]
            to_own = ((x[rows, p] - book[mine]) ** 2).sum(1)
            up_own = ceil_root(to_own)[:, None]
            near = near[rows] & ~((up_own < low[rows]) | (2 * up_own < apart[mine]))
            of, entry = np.nonzero(near)
            to_entry = ((x[rows[of], p] - book[entry]) ** 2).sum(1)
            found = np.full(near.shape, _FAR)
            found[of, entry] = to_entry
            found[np.arange(len(rows)), mine] = to_own
            low[rows[of], entry] = floor_root(to_entry)
            low[rows, mine] = floor_root(to_own)
            best = found.argmin(1)
            a[rows, p] = best
            up[rows] = ceil_root(found[np.arange(len(rows)), best])

    def errors(self, x: np.ndarray, a: np.ndarray) -> np.ndarray:
        """The exact squared distance of each row to its entries."""
        return sum((((x[:, p] - book[a[:, p]]) ** 2).sum(1) for p, book in enumerate(self.books)), np.zeros(len(x), np.int64))


def _fixed(rows: np.ndarray) -> pa.Array:
    """A column of binaries of one size."""
    rows = np.ascontiguousarray(rows)
    size = rows[0].nbytes if len(rows) else 0
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.py_buffer(rows)])


def _bytes(column: pa.Array, kind: str, size: int) -> np.ndarray:
    """The numbers in a column of binaries of ``size`` numbers each."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data.view(kind).reshape(len(column), size)


def _as_parts(batch: pa.RecordBatch, parts: int, size: int, scale: int) -> np.ndarray:
    """Whole numbers of the vectors, (row, part, place); a vector that the parts don't divide ends in zeros."""
    column = batch.column("vector")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(column.values.buffers()[1] or b"", np.float64)[column.values.offset :][ends[0] : ends[-1]]
    wide = np.zeros((len(column), parts * math.ceil(size / parts)), np.int64)
    wide[:, :size] = np.floor(values.reshape(len(column), size) * scale)
    return wide.reshape(len(column), parts, -1)


STATE = "vec_id long, label {label}, x binary, a binary, upper binary, lower binary, part int, entry int, n long, sums array<long>"


def _step(now: Round, size: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Assign a table's vectors and give what the next round needs: the state of each, and sums by part and entry."""
    parts, entries, width = now.books.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        label = None
        for batch in batches:
            label = batch.schema.field("label").type
            n = batch.num_rows
            if not n:
                continue
            x, a, upper, lower = _state(batch, now, size, scale)
            now.assign(x, a, upper, lower)
            for p in range(parts):
                for e in range(entries):
                    of = x[a[:, p] == e, p]
                    counts[p, e] += len(of)
                    sums[p, e] += of.sum(0)
            small = -(1 << 15) <= x.min(initial=0) and x.max(initial=0) < 1 << 15
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    _fixed(x.reshape(n, -1).astype("<i2" if small else "<i4")),
                    _fixed(a),
                    _fixed(upper.astype("<u4")),
                    _fixed(np.minimum(lower >> now.now, 255).astype(np.uint8).reshape(n, -1)),
                    *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))),
                ],
                names=["vec_id", "label", "x", "a", "upper", "lower", "part", "entry", "n", "sums"],
            )
        if label is not None:
            many = parts * entries
            told = [np.repeat(np.arange(parts), entries), np.tile(np.arange(entries), parts), counts.reshape(-1)]
            columns = [pa.nulls(many, t) for t in (pa.int64(), label, *[pa.binary()] * 4)]
            columns += [pa.array(c, t) for c, t in zip(told, (pa.int32(), pa.int32(), pa.int64()), strict=True)]
            columns.append(pa.array(sums.reshape(many, width).tolist(), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "x", "a", "upper", "lower", "part", "entry", "n", "sums"])

    return step


def _state(batch: pa.RecordBatch, now: Round, size: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts, entries, upper and lower bounds; for vectors that were never assigned, bounds that prove nothing."""
    parts, entries, width = now.books.shape
    n = batch.num_rows
    if "vector" in batch.schema.names:
        x = _as_parts(batch, parts, size, scale)
        a, lower = np.zeros((n, parts), np.uint8), np.zeros((n, entries, parts), np.int64)
        return x, a, np.full((n, parts), (1 << 32) - 1, np.int64), lower
    column = batch.column("x")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    small = np.diff(ends) == 2 * parts * width
    x = np.zeros((n, parts, width), np.int64)
    for kind, rows in (("<i2", np.flatnonzero(small)), ("<i4", np.flatnonzero(~small))):
        if len(rows) == n:
            x = _bytes(column, kind, parts * width).astype(np.int64).reshape(x.shape)
        elif len(rows):
            x[rows] = _bytes(column.take(pa.array(rows)), kind, parts * width).reshape(len(rows), parts, width)
    a = _bytes(batch.column("a"), "u1", parts).copy()
    upper = _bytes(batch.column("upper"), "<u4", parts).astype(np.int64)
    lower = _bytes(batch.column("lower"), "u1", entries * parts).astype(np.int64).reshape(n, entries, parts) << now.was
    return x, a, upper, lower


def _coder(now: Round, size: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, a, upper, lower = _state(batch, now, size, scale)
            now.assign(x, a, upper, lower)
            told = pa.array([r.tobytes().hex() for r in a], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), told, pa.array(now.errors(x, a), pa.int64())], names=["vec_id", "label", "code", "error"]
            )

    return code


def _new_books(sums: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry becomes the floor of the mean of its parts; an entry without parts stays."""
    added = sums.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(books.shape[2])]
    )
    books = books.copy()
    for r in added.where("n > 0").collect():
        books[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(books.shape[2])]
    return books


def compress_vectors(
    vectors: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> Codes:
    """Codes of all vectors, ``vec_id, label, code, error``, and the codebooks they refer to.

    Rows whose vector is null, or holds null or a number that isn't finite, go. A component ``x`` becomes
    ``floor(scale * x)``; each of ``parts`` equal parts has a codebook, which starts as that part of the vectors of
    the ``entries`` smallest ids (equal ids: the smaller vector; null is the largest) and takes ``rounds`` rounds. ``code`` has two
    hex digits a part, ``error`` is the exact squared distance, in integer units. Fewer vectors than ``entries`` give
    as many entries; no vector, no rows. Rows that repeat an id are vectors of their own. The length is that of the vector with the smallest id; a
    vector of another length, or one so large that its squared distances could leave 64 bits, takes no part in
    the rounds and has null as code and error. A length that ``parts`` doesn't divide is filled up with zeros. At
    most 256 entries. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have one byte a part: 1 to 256 entries")
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vector.alias("vector"))
    kept = rows.where("vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    smallest = [F.asc_nulls_last("vec_id"), F.col("vector")]
    first = kept.orderBy(*smallest).limit(entries).collect()
    size = len(first[0]["vector"]) if first else 0
    most = math.isqrt((1 << 60) // max(1, size))
    fits = F.expr(f"size(vector) = {size} and forall(vector, x -> abs(x) * {scale} <= {most}D)")
    if any(len(r["vector"]) != size or any(abs(v) * scale > most for v in r["vector"]) for r in first):
        first = kept.where(fits).orderBy(*smallest).limit(entries).collect()
    label = kept.schema["label"].dataType.simpleString()
    shape = f"vec_id long, label {label}, code string, error long"
    if not first or not size:
        code = F.lit("00" * parts if first else None).cast("string")
        none = kept.select("vec_id", "label", F.when(fits, code).alias("code"), F.when(fits, F.lit(0)).cast("long").alias("error"))
        return Codes(none, np.zeros((parts, len(first), 0), np.int64))
    start = pa.RecordBatch.from_arrays([pa.array([r["vector"] for r in first], pa.list_(pa.float64()))], names=["vector"])
    books = np.ascontiguousarray(_as_parts(start, parts, size, scale).transpose(1, 0, 2))
    state, path, before, step = kept.where(fits), None, None, 0
    for _ in range(rounds):
        now = Round.after(books, before, step)
        old = path
        table, path = stored(state.mapInArrow(_step(now, size, scale), STATE.format(label=label)))
        before, books, step = books, _new_books(table.where("part is not null"), books), now.now
        state = table.where("part is null").select("vec_id", "label", "x", "a", "upper", "lower")
        forget(spark, old)
    coded = state.mapInArrow(_coder(Round.after(books, before, step), size, scale), shape)
    odd = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    told, _ = stored(coded.unionByName(odd))
    forget(spark, path)
    return Codes(told, books)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``, the sum of the errors of all rows of the label; null is a label too.

    A label that holds more than a thousandth of the rows isn't shuffled.
    """
    keyed = rows.withColumn("key", F.struct("label"))
    counted, _ = stored(keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    return join_by_hot_key(keyed, counted, ["key"], "n").drop("key", "n")
