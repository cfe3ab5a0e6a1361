"""Sketches against their definition, and groups against all pairs."""

import random

import numpy as np
import pytest

from arborlake.llm import sketch_duplicates as sd
from arborlake.llm.textblocks import U64, mixed

SCHEMA = "doc_id long, text string, n long, cls long, registers string, comp long, text_hash long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "clash", 1, 1) for r in rows], SCHEMA)


def shingles(text, size=5):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    w = [x for x in text.split(" ") if x]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain(rows, percent=85):
    """Rows by all pairs: a null id is the largest."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    big = 1 << 62
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), big), big if d is None else d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least[find(i)]
        c = None if c == big else c
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def found(spark, rows, parts=6):
    df = frame(spark, rows).repartition(parts)
    return sorted((tuple(r) for r in sd.sketch_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def near_copies(rng, n, edits, size=120):
    """Each an edited copy of an earlier one, so that similarities lie all around the threshold."""
    texts = [[f"w{rng.randrange(5000)}" for _ in range(size)]]
    while len(texts) < n:
        t = list(rng.choice(texts[-8:]))
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


def random_sets(rng, n_sets, size):
    return [np.unique(rng.integers(0, 1 << 63, size, dtype=np.int64).astype(U64)) for _ in range(n_sets)]


def test_sketches_by_definition():
    """Stopping early changes no register, and the larger registers are the union's sketch."""
    rng = np.random.default_rng(1)
    sets = [*random_sets(rng, 6, 3), *random_sets(rng, 6, 90), *random_sets(rng, 2, 3000)]
    sets += [np.union1d(a, b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    got = sd.set_sketches(first, np.concatenate(sets))
    for s, registers in zip(sets, got, strict=True):
        way = mixed(s ^ U64(0xA0761D6478BD642F))
        least = np.full(sd.REGISTERS, np.inf)
        for turn in range(sd.REGISTERS):
            value = turn + (mixed(s + U64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(12)).astype(float) / 2.0**52
            slot = ((way & U64(255)) + ((way >> U64(32)) | U64(1)) * U64(turn)) & U64(255)
            np.minimum.at(least, slot.astype(int), value)
        scaled = np.floor(1 - np.log(-np.log1p(-least / sd.REGISTERS) / sd.RATE) / np.log(sd.BASE))
        assert np.abs(registers - np.clip(scaled, 0, sd.TOP)).max() <= 1
    for k in range(7):
        assert (sd.merged(got[2 * k], got[2 * k + 1]) == got[14 + k]).all()


@pytest.mark.parametrize("size", [40, 1000])
@pytest.mark.parametrize("similarity", [0.3, 0.7, 0.85, 0.95])
def test_likelihood_estimates_similarity(size, similarity):
    rng = np.random.default_rng(int(100 * similarity) + size)
    common = round(2 * size * similarity / (1 + similarity))
    errors, expected = [], common / (2 * size - common)
    for _ in range(40):
        a, b, c = random_sets(rng, 1, common) + random_sets(rng, 2, size - common)
        x, y = np.concatenate((a, b)), np.concatenate((a, c))
        r, s = sd.set_sketches(np.array([0, len(x), len(x) + len(y)]), np.concatenate((x, y))).astype(int)
        above, below = np.array([(r > s).sum()]), np.array([(r < s).sum()])
        found = sd.likely_similarity(above, below, np.array([len(x)]), np.array([len(y)]))[0]
        for t in (expected - 0.12, found - 1e-6, found + 1e-6):
            assert sd.may_reach(t, above, below, len(x), np.array([len(y)]))[0] == (found >= t)
        errors.append(found - expected)
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.12


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_against_all_pairs(spark, monkeypatch, small):
    """Chains of copies around the threshold, with groups of exact ones; small cells cut buckets in blocks."""
    if small:
        monkeypatch.setattr(sd, "MEMBERS", 3000)
        monkeypatch.setattr(sd, "OTHERS", 900)
    rng = random.Random(7)
    texts = near_copies(rng, 260, 2) + near_copies(rng, 120, 4) + near_copies(rng, 60, 1, 9) + near_copies(rng, 60, 1, 40)
    texts += [texts[5]] * 200 + [texts[300].upper()] * 5
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = plain(rows)
    assert len({r[2] for r in want}) > 20 and sum(not r[3] for r in want) > 200
    assert found(spark, rows) == want


def test_odd_texts(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(1, passage), (1, passage), (1, "other words of this same id here"), (2, None), (3, ""), (4, " \n\t "), (None, passage + " end")]
    rows += [(None, None), (None, "three short words"), (None, "Three SHORT words"), (5, "three short"), (6, "THREE\tSHORT"), (7, "Ünï ✓"), (8, "ünï ✓")]
    rows += [(9, "long " * 200_000), (10, "long " * 9), (11, passage.replace("w3 ", "W3 "))]
    assert found(spark, rows) == plain(rows)


def test_no_documents(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == [(1, 0, 1, True)]
