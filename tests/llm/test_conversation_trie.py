"""The trie against a dictionary of all prefixes; stacks over many ranges; odd turns."""

import hashlib
import random
import zlib

import pytest

from arborlake.llm import conversation_trie
from arborlake.llm.conversation_trie import ends_digest, prefix_trie, share_openings, turn_digests

SCHEMA = "conv_id long, turn long, role string, text string, key string, path string, pos int, h int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1, 1) for r in rows], SCHEMA)


def sequences(rows):
    """Turns of each conversation, in order."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in out.items()}


def rebuilt(own):
    return {c: own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + own[c][h:] for c in own}


def plain(seqs):
    """Rows of all nodes, from all prefixes."""
    members = {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        below = [total[k] for k in kids.get(p, [])]
        total[p] = (sum(b[0] for b in below) if below else 1, saved + sum(b[1] for b in below))
    return sorted(
        (
            (
                min(m),
                len(p),
                min(members[p[:-1]]) if p else None,
                len(m),
                len(kids.get(p, [])),
                *total[p],
                hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p)))).encode()).hexdigest(),
            )
            for p, m in members.items()
        ),
        key=str,
    )


def nodes(trie):
    return sorted((tuple(r) for r in ends_digest(trie).select(*COLUMNS).collect()), key=str)


@pytest.fixture
def ranges(spark):
    """Many ranges that aren't merged."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("fan", [64, 2])
def test_random_trees(spark, ranges, monkeypatch, fan):
    """Few texts, so that conversations share much; the levels of stacks are four for fans of two."""
    monkeypatch.setattr(conversation_trie, "FAN", fan)
    rng = random.Random(fan)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "ccc✓"])) for c in range(400) for t in range(rng.randrange(1, 6))]
    rng.shuffle(rows)
    assert nodes(prefix_trie(turn_digests(frame(spark, rows)))) == plain(sequences(rows))


def test_copies_in_many_ranges(spark, ranges):
    """A third of all conversations are the same, more than a row of ids holds; another continues it."""
    rows = [(c, t, "user", f"hot {t}") for c in range(9000) for t in range(2)]
    rows += [(9000 + c, 0, "user", f"own {c % 50}") for c in range(600)] + [(9700, t, "user", f"hot {t}") for t in range(40)]
    assert nodes(prefix_trie(turn_digests(frame(spark, rows)))) == plain(sequences(rows))


def test_shared_openings(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice("ua"), f"{rng.randrange(4)}") for c in range(0, 330, 1) if c not in (100, 7) for t in range(rng.randrange(1, 8))]
    turns = turn_digests(frame(spark, rows))
    seqs = rebuilt(sequences(rows))
    assert any(not s for s in seqs.values())
    assert nodes(prefix_trie(share_openings(turns))) == plain(seqs)


def test_odd_turns(spark):
    """Null and repeated turns, null ids, roles and texts, ties, a long text, a repeated row."""
    rows = [(1, 2, "user", "z"), (1, None, "user", "first"), (1, 2, "user", "a"), (1, 2, "user", "a"), (None, 0, "user", "nobody"), (2, None, None, None)]
    rows += [(3, None, "", ""), (4, 0, "u", "ab"), (5, 0, "ua", "b"), (6, 0, "user", "x" * 1_000_000), (7, 0, "user", "x" * 1_000_000)]
    seqs = sequences(rows)
    assert seqs[2] == seqs[3] and [t for _, t in seqs[1]] == ["first", "a", "a", "z"]
    assert nodes(prefix_trie(turn_digests(frame(spark, rows)))) == plain(seqs)


def test_a_long_conversation(spark, ranges):
    rows = [(c, t, "u", str(t if c == 1 or t < 700 else -t)) for c in (1, 2) for t in range(1500)]
    assert nodes(prefix_trie(turn_digests(frame(spark, rows)))) == plain(sequences(rows))


def test_no_conversations(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert nodes(prefix_trie(share_openings(turn_digests(frame(spark, rows))))) == []
