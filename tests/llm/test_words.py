"""Words that a hash of powers can't part, in every operator that compares words."""

import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece

from arborlake.llm import token_counts as counts
from arborlake.llm.near_duplicates import DEPTH, TREES, _verifier, near_duplicates
from arborlake.llm.substring_dedup import remove_repeats
from arborlake.llm.textblocks import blocks, distinct_words, split_words

#: The Thue-Morse word and its complement: equal under polynomials modulo a power of two.
A = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
B = A.translate(str.maketrans("ab", "ba"))
REST = " ".join(f"w{i}" for i in range(12))
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_hashes_part_patterns():
    for _, data, offsets in blocks(pa.array([f"{A} {B} {A[:40]} {B[:40]} {A}"])):
        words = split_words(data, offsets)
        assert len(set(words.hashes().tolist())) == 4
        at, of = distinct_words(words)
        assert len(at) == 4 and of[0] == of[4]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr("arborlake.llm.textblocks.Words.hashes", lambda self, *_: np.zeros(len(self.start), np.uint64))
    texts = ["b a bb a", "a c", "", "bb b"]
    for _, data, offsets in blocks(pa.array(texts)):
        words = split_words(data, offsets)
        at, of = distinct_words(words)
        assert [words.word(at[k]) for k in of] == [w.encode() for t in texts for w in t.split()]
        assert len(at) == 4


def test_token_counts_of_pattern_words(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [f"{A} {B}", B, A, f" {A}  {B} "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for head in (4_000_000, 0):
        found = {r.doc_id: r.n_tokens for r in counts.token_counts(docs, MODEL, head_size=head).collect()}
        assert found == {i: len(sp.encode(t)) for i, t in enumerate(texts)}


def test_token_counts_of_a_very_long_text():
    """50 MB in one text: parts have the pre-tokens of the whole."""
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, k))) for k in rng.integers(0, 12, 4000)]
    text = " ".join(words[k] for k in rng.integers(0, 4000, 8_000_000))
    assert len(text) > 50_000_000
    found: dict[str, int] = {}
    for part in counts._distinct(iter([pa.record_batch([pa.array([text])], names=["text"])])):
        for token, n in zip(*(part.column(k).to_pylist() for k in (0, 1))):
            found[token] = found.get(token, 0) + n
    whole: dict[str, int] = {}
    for token in re.findall(r" *[^ ]+| +$", " " + text):
        whole[token[1:]] = whole.get(token[1:], 0) + 1
    assert found == whole


def test_windows_of_pattern_words(spark):
    docs = spark.createDataFrame([(0, f"{A} {REST}"), (1, f"{B} {REST}"), (2, f"{B} {REST}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()} == {0: 0, 1: 0, 2: 13}


def test_shingles_of_pattern_words(spark):
    """Sets of two shingles: one of two in common is a similarity of a third."""
    docs = spark.createDataFrame([(0, f"{A} p q r s t"), (1, f"{B} p q r s t"), (2, f"{B} p q r s t")], "doc_id long, text string")
    found = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(docs).collect()}
    assert found == {0: (0, 0), 1: (1, 1), 2: (1, 1)}


def test_cells_against_all_pairs():
    """Links, roots and counts by similarity of a cell, where most shingles are in most sets."""
    rng = np.random.default_rng(1)
    base, m = rng.integers(0, 1 << 63, 60, dtype=np.uint64), 50
    sets = [np.unique(np.append(base[rng.random(60) > 0.15 * rng.random()], rng.integers(0, 1 << 63, rng.integers(0, 9), dtype=np.uint64))) for _ in range(m)]
    copies = rng.integers(1, 4, m)
    for block in (np.zeros(m, int), np.arange(m) % 2):
        # some pairs share an earlier tree than this cell's, and count there
        signed = rng.integers(0, 2, (m, TREES, DEPTH), dtype=np.uint8)
        signed[:, 0] = (np.arange(m) % 9)[:, None]
        signed[:, 3] = 7
        first = (signed[:, None] == signed[None]).all(3).argmax(2)
        cell = {"cls": np.arange(m), "copies": copies, "block": block, "shingles": [s.tobytes() for s in sets], "signature": [s.tobytes() for s in signed]}
        cell |= {"tree": np.full(m, 3), "i": np.zeros(m, int), "j": np.full(m, block.max())}
        links, root, pairs = np.zeros(m, int), np.arange(m), 0
        for i in range(m):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if (block[i] != block[j] or not block.any()) and first[i, j] == 3 and len(a & b) >= 0.8 * len(a | b):
                    pairs, links[i], links[j] = pairs + 1, links[i] + copies[j], links[j] + copies[i]
                    root[(root == root[i]) | (root == root[j])] = min(root[i], root[j])
        found = _verifier(0.8, DEPTH)(pa.table(cell)).to_pylist()
        assert pairs > 100 and sum(sum(r["similar"]) for r in found if r["similar"]) == pairs
        assert {r["cls"]: (r["links"], r["root"]) for r in found if r["links"]} == {i: (links[i], root[i]) for i in range(m) if links[i]}


def test_token_counts_of_any_signs(spark):
    """Spaces, the sign that the model writes for them, control signs and special strings, against the library."""
    import sentencepiece

    rng = random.Random(3)
    signs = [" ", "  ", "▁", "▁▁", " ▁", "\n", "\r", "\t", "\x01", "a", "cpu", "ok", "é", "ｶﾞ", "✓", "\u00a0", "\u3000", "<s>", "</s>", "<unk>", "<0x0A>", "▀", "😀", "23", "\u200b"]
    texts = ["cpu ▁  ok", "'▁   x'", " ▁ \n\r\n", "▁", "▁ ", " ▁"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in counts.token_counts(docs, MODEL, head_size=500).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert found == {i: (len(t.encode()), n) for i, (t, n) in enumerate(zip(texts, map(len, sp.encode(texts)), strict=True))}
