"""Vector codes against plain Lloyd rounds, and odd vectors."""

import numpy as np
import pytest

from arborlake.llm import vector_codes
from arborlake.llm.vector_codes import ceil_root, compress_vectors, floor_root, with_label_errors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int, n long, x string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 1, "clash") for r in rows], SCHEMA)


def plain(vectors, parts=8, entries=16, rounds=6):
    """Codes, errors and books of vectors in order of id, every distance computed."""
    x = np.floor(4096 * np.array(vectors, np.float64)).astype(np.int64).reshape(len(vectors), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        d = ((x[:, :, None] - books[None]) ** 2).sum(3)
        a = d.argmin(2)
        if turn < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = x[a[:, p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(0) // len(own)
    return [r.astype(np.uint8).tobytes().hex() for r in a], d.min(2).sum(1).tolist(), books


@pytest.mark.parametrize("wide", [1, 40])
def test_against_plain_rounds(spark, wide):
    """Clusters, ties on a coarse grid, repeated vectors, and (wide) numbers beyond 16 bits."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    vectors = np.round((centres[rng.integers(0, 12, 900)] + rng.normal(scale=0.3, size=(900, 32))) * 2) / 2 * wide
    vectors[100:200] = vectors[50]
    rows = [(i, v.tolist(), None if i % 7 == 0 else i % 3) for i, v in enumerate(vectors)]
    found = compress_vectors(frame(spark, rows[::-1]).repartition(5))
    codes, errors, books = plain(vectors)
    assert (found.books == books).all()
    got = {r.vec_id: (r.code, r.error) for r in found.rows.collect()}
    assert got == {i: (c, e) for i, (c, e) in enumerate(zip(codes, errors, strict=True))}
    sums = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    assert {r.label: r.label_error for r in with_label_errors(found.rows).select("label", "label_error").distinct().collect()} == sums


def test_bounds_prune_most_distances(spark):
    """On clustered vectors, later rounds compare few entries, and bounds still hold."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(16, 8, 4))[rng.integers(0, 16, 2000)] * 4096 + rng.normal(scale=40, size=(2000, 8, 4))).astype(np.int64)
    books = np.ascontiguousarray(x[:16].transpose(1, 0, 2))
    a, upper, lower = np.zeros((2000, 8), np.uint8), np.full((2000, 8), (1 << 32) - 1, np.int64), np.zeros((2000, 16, 8), np.int64)
    first = vector_codes.Round.after(books, None, 0)
    first.assign(x, a, upper, lower)
    moved = books + rng.integers(-3, 4, books.shape)
    second = vector_codes.Round.after(moved, books, 0)
    second.assign(x, a, upper, lower)
    d = ((x[:, :, None] - moved[None]) ** 2).sum(3)
    assert (a == d.argmin(2)).all()
    assert (upper >= ceil_root(d.min(2).reshape(-1)).reshape(upper.shape)).all()
    assert (lower.transpose(0, 2, 1) <= floor_root(d.reshape(-1)).reshape(d.shape)).all()
    pruned = (upper[:, None] < lower).mean()
    assert pruned > 0.8


def test_odd_vectors(spark):
    ok = [0.5] * 16
    rows = [
        (3, ok, 1),
        (3, ok, 1),
        (None, [-0.25] * 16, None),
        (4, None, 1),
        (5, [None, *ok[1:]], 1),
        (6, [float("nan"), *ok[1:]], 1),
        (7, [float("inf"), *ok[1:]], 1),
        (8, [0.5] * 8, 2),
        (9, [1e30, *ok[1:]], 2),
        (10, [-0.00001] * 16, None),
    ]
    found = compress_vectors(frame(spark, rows))
    got = sorted(((r.vec_id, r.label, r.code, r.error) for r in found.rows.collect()), key=str)
    assert got == sorted([(3, 1, "00" * 8, 0), (3, 1, "00" * 8, 0), (10, None, "02" * 8, 0), (None, None, "03" * 8, 0), (8, 2, None, None), (9, 2, None, None)], key=str)
    assert found.books.shape == (8, 4, 2) and (found.books[:, 2] == -1).all()
    assert {r.label: r.label_error for r in with_label_errors(found.rows).collect()} == {1: 0, None: 0, 2: None}


def test_lengths_that_the_parts_do_not_divide(spark):
    found = compress_vectors(frame(spark, [(1, [1.0] * 11, 0), (2, [0.0] * 11, 0), (3, [], 0)]))
    assert {r.vec_id: (r.code, r.error) for r in found.rows.collect()} == {1: ("00" * 8, 0), 2: ("01" * 5 + "01" + "00" * 2, 0), 3: (None, None)}


def test_no_vectors(spark):
    for rows in ([], [(1, None, 0)]):
        found = compress_vectors(frame(spark, rows))
        assert with_label_errors(found.rows).collect() == []
    assert [(r.code, r.error) for r in compress_vectors(frame(spark, [(1, [], 0)])).rows.collect()] == [("00" * 8, 0)]


def test_round_tables_are_removed(spark):
    import os

    from arborlake.llm.common import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    compress_vectors(frame(spark, [(i, [i / 10] * 8, 0) for i in range(40)]))
    assert len({f for f in os.listdir(folder) if f.endswith(".parquet")} - before) == 1


def test_roots():
    n = np.array([0, 1, 2, 3, 4, 8, 9, 10**15 - 1, (1 << 31) ** 2 - 1, (3 << 29) ** 2 + 1])
    assert floor_root(n).tolist() == [0, 1, 1, 1, 2, 2, 3, 31622776, (1 << 31) - 1, 3 << 29]
    assert ceil_root(n).tolist() == [0, 1, 2, 2, 2, 3, 3, 31622777, 1 << 31, (3 << 29) + 1]
