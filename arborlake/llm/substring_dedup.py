"""Substring deduplication with difference-cover anchors.

Positions modulo 7 in {0, 1, 3} are a difference cover: whatever two positions a match starts at
in two documents, some offset below 7 moves both to cover positions. So any match of 13 words
contains a run of 7 words that starts at a cover position on both sides, and hashing these runs,
the anchors, at 3 of 7 positions finds every match. Only windows around anchors that a second
document shares are then hashed whole and looked up.

Documents are dealt into chunks. A chunk asks about the hashes it holds, one packed row for each
range of hashes; the range gathers what all chunks hold and answers with one bit per hash. A hash
that a third of the documents hold is one entry per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .textblocks import U64, Words, split_words, text_bytes, windows

PERIOD, COVER = 7, (0, 1, 3)
#: Bytes of text in a chunk, and hashes in a range, about.
CHUNK_BYTES, RANGE_HASHES = 2 << 20, 1 << 20
ASK = "hash_range int, chunk long, main binary, more binary, owner binary"
ANSWER = "chunk long, round int, hash_range int, bits binary"


def _chunk(table: pa.Table) -> tuple[np.ndarray, Words]:
    """Ids and words of a chunk's documents, by id and text, so that each pass sees the same order."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    data, offsets = text_bytes(table["text"])
    return table["doc_id"].to_numpy(), split_words(data, offsets)


class Anchors:
    """Anchors of a chunk, with the distinct ones in hash order."""

    def __init__(self, words: Words, hashes: np.ndarray, window: int):
        gram = window - PERIOD + 1
        every, at = windows(hashes, words.first, gram, salt=1)
        text = words.texts()[at] if len(at) else at
        cover = np.isin((at - words.first[text]) % PERIOD, COVER)
        self.at, self.text = at[cover], text[cover]
        self.distinct, self.of = np.unique(every[cover], return_inverse=True)

    def in_several(self) -> np.ndarray:
        """Which distinct anchors are in at least two documents of the chunk."""
        low = np.full(len(self.distinct), np.iinfo(np.int64).max)
        high = np.full(len(self.distinct), -1)
        np.minimum.at(low, self.of, self.text)
        np.maximum.at(high, self.of, self.text)
        return low < high


class Candidates:
    """Windows of a chunk around shared anchors, with the distinct ones in hash order."""

    def __init__(self, ids: np.ndarray, words: Words, hashes: np.ndarray, anchors: Anchors, shared: np.ndarray, window: int):
        h, at = windows(hashes, words.first, window, salt=2)
        near = np.zeros(len(hashes) + 1, np.int32)
        hit = anchors.at[shared[anchors.of]]
        np.add.at(near, np.maximum(hit - (PERIOD - 1), 0), 1)
        np.add.at(near, hit + 1, -1)
        wanted = np.cumsum(near)[at] > 0
        self.at = at[wanted]
        # a second hash of the same words by other steps: 128 bits together
        second = windows(words.hashes(3), words.first, window, salt=3)[0][wanted]
        pairs = np.empty(len(self.at), [("main", U64), ("more", U64)])
        pairs["main"], pairs["more"] = h[wanted], second
        order = np.lexsort((pairs["more"], pairs["main"]))
        new = np.ones(len(order), bool)
        new[1:] = pairs[order][1:] != pairs[order][:-1]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.distinct = pairs[order][new]
        self.ids = ids[words.texts()[self.at]] if len(self.at) else np.zeros(0, np.int64)
        self.owner = np.full(len(self.distinct), np.iinfo(np.int64).max)
        np.minimum.at(self.owner, self.of, self.ids)


def _cut(main: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Range of each sorted hash, and where each range starts."""
    ranges = (main >> U64(64 - bits)).astype(np.int64)
    return ranges, np.flatnonzero(np.diff(ranges, prepend=-1))


def _ask(chunk: int, main: np.ndarray, bits: int, packed: list[Callable[[slice], bytes]]) -> pa.Table:
    ranges, starts = _cut(main, bits)
    parts = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(main)], strict=True)]
    columns = [[p(s) for s in parts] for p in packed]
    return pa.table(
        {
            "hash_range": pa.array(ranges[starts], pa.int32()),
            "chunk": pa.array([chunk] * len(parts), pa.int64()),
            **{n: pa.array(c, pa.binary()) for n, c in zip(("main", "more", "owner"), columns, strict=True)},
        }
    )


def _bits(rows: list[tuple[int, bytes]], main: np.ndarray, bits: int) -> np.ndarray:
    """The answers to a chunk, in the order of its sorted hashes."""
    out = np.zeros(len(main), bool)
    ranges, starts = _cut(main, bits)
    ends = dict(zip(ranges[starts].tolist(), zip(starts, [*starts[1:], len(main)], strict=True), strict=True))
    for r, packed in rows:
        a, b = ends[r]
        out[a:b] = np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a).astype(bool)
    return out


def _ask_anchors(bits: int, window: int) -> Callable[[pa.Table], pa.Table]:
    def ask(table: pa.Table) -> pa.Table:
        _, words = _chunk(table)
        anchors = Anchors(words, words.hashes(), window)
        prints = (anchors.distinct >> U64(32 - bits)).astype(np.uint32)
        several = anchors.in_several()
        packed = [lambda s: prints[s].tobytes(), lambda s: np.packbits(several[s]).tobytes(), lambda s: b""]
        return _ask(table["chunk"][0].as_py(), anchors.distinct, bits, packed)

    return ask


def _answer_anchors(table: pa.Table) -> pa.Table:
    """Which anchors are in a second document: in one more chunk, or twice in a chunk."""
    prints = [np.frombuffer(b, np.uint32) for b in table["main"].to_pylist()]
    several = [
        np.unpackbits(np.frombuffer(b, np.uint8), count=len(p)) for b, p in zip(table["more"].to_pylist(), prints, strict=True)
    ]
    # equal prints of one chunk come from different hashes; they only widen the search
    _, of, count = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
    shared = ((count > 1) | (np.bincount(of, np.concatenate(several), len(count)) > 0))[of]
    return _answer(table, 1, np.split(shared, np.cumsum([len(p) for p in prints])[:-1]))


def _ask_windows(bits: int, window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return pa.table({"hash_range": pa.array([], pa.int32()), "chunk": pa.array([], pa.int64()), **{n: pa.array([], pa.binary()) for n in ("main", "more", "owner")}})
        found = _candidates(table, answers, bits, window)[2]
        main, more = (np.ascontiguousarray(found.distinct[n]) for n in ("main", "more"))
        packed = [lambda s: main[s].tobytes(), lambda s: more[s].tobytes(), lambda s: found.owner[s].tobytes()]
        return _ask(table["chunk"][0].as_py(), main, bits, packed)

    return ask


def _answer_windows(table: pa.Table) -> pa.Table:
    """Which windows another chunk has in a document with a smaller id."""
    kinds = (("main", U64), ("more", U64), ("owner", np.int64))
    parts = {n: [np.frombuffer(b, t) for b in table[n].to_pylist()] for n, t in kinds}
    main, more, owner = (np.concatenate(parts[n]) for n, _ in kinds)
    order = np.lexsort((owner, more, main))
    new = np.ones(len(order), bool)
    new[1:] = (main[order][1:] != main[order][:-1]) | (more[order][1:] != more[order][:-1])
    least = owner[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    earlier = np.empty(len(order), bool)
    earlier[order] = least < owner[order]
    return _answer(table, 2, np.split(earlier, np.cumsum([len(p) for p in parts["main"]])[:-1]))


def _answer(table: pa.Table, nth: int, flags: list[np.ndarray]) -> pa.Table:
    return pa.table(
        {
            "chunk": table["chunk"],
            "round": pa.array([nth] * table.num_rows, pa.int32()),
            "hash_range": table["hash_range"],
            "bits": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary()),
        }
    )


def _rows(answers: pa.Table, nth: int) -> list[tuple[int, bytes]]:
    rows = zip(*(answers[n].to_pylist() for n in ("round", "hash_range", "bits")), strict=True)
    return [(r, b) for n, r, b in rows if n == nth]


def _candidates(table: pa.Table, answers: pa.Table, bits: int, window: int) -> tuple[np.ndarray, Words, Candidates]:
    ids, words = _chunk(table)
    hashes = words.hashes()
    anchors = Anchors(words, hashes, window)
    shared = _bits(_rows(answers, 1), anchors.distinct, bits)
    return ids, words, Candidates(ids, words, hashes, anchors, shared, window)


def _remove(bits: int, window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            ids = np.zeros(0, np.int64)
            return pa.table({"doc_id": pa.array(ids), "n_words": pa.array(ids), "n_removed": pa.array(ids), "kept": pa.array([], pa.string())})
        ids, words, found = _candidates(table, answers, bits, window)
        earlier = _bits(_rows(answers, 2), np.ascontiguousarray(found.distinct["main"]), bits)
        gone = earlier[found.of] | (found.owner[found.of] < found.ids)
        edge = np.zeros(len(words.start) + window + 1, np.int32)
        np.add.at(edge, found.at[gone], 1)
        np.add.at(edge, found.at[gone] + window, -1)
        removed = np.cumsum(edge)[: len(words.start)] > 0
        sums = np.concatenate(([0], np.cumsum(removed)))
        n_removed = sums[words.first[1:]] - sums[words.first[:-1]]
        texts = kept_texts(words, ~removed)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_words": pa.array(np.diff(words.first), pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept": pa.array(texts, pa.string()),
            }
        )

    return remove


def kept_texts(words: Words, keep: np.ndarray) -> list[str]:
    """Each text's kept words, joined by one space."""
    start, end = words.start[keep], words.end[keep]
    lengths = end - start + 1
    stops = np.cumsum(lengths)
    out = np.full(int(stops[-1]) if len(stops) else 0, 0x20, np.uint8)
    shift = np.repeat(start - (stops - lengths), lengths)
    source = np.arange(len(out)) + shift
    letters = np.ones(len(out), bool)
    letters[stops - 1] = False
    out[letters] = words.data[source[letters]]
    place = np.concatenate(([0], stops))
    bounds = place[np.searchsorted(start, words.offsets)]
    whole = out.tobytes()
    return [whole[a : max(a, b - 1)].decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def remove_repeats(
    docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Remove repeated passages: ``doc_id, n_words, n_removed, kept`` (the words left, by one space).

    A word goes when a window of ``window`` words covers it whose sequence of words also starts in
    a document with a smaller id. Windows are judged on the input. Null and blank texts have no
    words. A null id counts as the largest. Rows that share an id are one document for the
    comparison, and each returns a row. Other columns are ignored.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).select(
        F.coalesce("id", F.lit((1 << 63) - 1)).alias("doc_id"), "text"
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, math.ceil(total / CHUNK_BYTES))
    bits = max(1, math.ceil(math.log2(max(2, total / 14 / RANGE_HASHES))))
    # rows of one id are told apart by their text: a hot id, or none, isn't one chunk
    chunks = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)))
    by_chunk = chunks.groupBy("chunk")
    shared = (
        by_chunk.applyInArrow(_ask_anchors(bits, window), ASK).groupBy("hash_range").applyInArrow(_answer_anchors, ANSWER)
    )
    earlier = (
        by_chunk.cogroup(shared.groupBy("chunk"))
        .applyInArrow(_ask_windows(bits, window), ASK)
        .groupBy("hash_range")
        .applyInArrow(_answer_windows, ANSWER)
    )
    done = by_chunk.cogroup(shared.unionByName(earlier).groupBy("chunk")).applyInArrow(
        _remove(bits, window), "doc_id long, n_words long, n_removed long, kept string"
    )
    return done.withColumn("doc_id", F.when(F.col("doc_id") != (1 << 63) - 1, F.col("doc_id")))
