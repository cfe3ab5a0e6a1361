"""Each query against SQL, or where SQL can't say it against brute force or held-out labels."""

import os
import re
from zlib import crc32

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from arborlake.llm import queries, sql
from arborlake.llm.common import table
from arborlake.llm.line_dedup import remove_repeated_lines
from arborlake.llm.mixing import drawn_words, mix_sources, shard_order, split_quotas
from arborlake.llm.near_duplicates import BINS, DEPTH, TREES, forest_depth, found_share, near_duplicates, signatures
from arborlake.llm.quality import fit_quality, score_quality
from arborlake.llm.textblocks import mixed
from arborlake.llm.toxicity import Machine, fit_machine, hashed_terms

from ..conftest import SF


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def auc(score, y):
    rank = pd.Series(score).rank().to_numpy()
    y = np.asarray(y, bool)
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / max(1, y.sum() * (~y).sum())


def brute_classes(texts: dict[int, str], threshold=0.8, size=5):
    """Class id and number of links of each text, from all pairs."""

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in texts.items()}
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and small >= threshold * large and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    ours, theirs = queries.queries()[name](spark, SF), con.sql(sql.ORACLE_SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    # as plain values, so that a null among whole numbers stays a null on both sides
    assert sorted((tuple(r) for r in ours.select(*columns).collect()), key=str) == sorted(theirs.select(*columns).fetchall(), key=str)


def test_op1_on_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    scored = score_quality(docs, fit_quality(docs, labels.where(fold != 1)))
    held = scored.join(labels.where(fold == 1), "doc_id").toPandas()
    assert auc(held["score"], held["quality"]) > 0.85
    assert scored.count() == docs.count()


def test_op2_against_all_pairs(spark, docs):
    found = {r.doc_id: (r.class_id, r.n_links) for r in queries.op2_jaccard_join(spark, SF).collect()}
    assert found == brute_classes(dict(zip(docs.doc_id, docs.text)))


def brute_lines(texts: dict[int, str], min_words: int) -> dict[int, str]:
    """Each text without the maximal runs that also start at an earlier place, from all pairs of places."""
    lines = {i: (t or "").split("\n") for i, t in texts.items()}
    places = [(i, p) for i in sorted(lines) for p in range(len(lines[i]))]

    def common(a, b):
        x, y = lines[a[0]][a[1] :], lines[b[0]][b[1] :]
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    kept = {i: list(x) for i, x in lines.items()}
    runs: dict[int, list[list[int]]] = {i: [] for i in lines}
    for k, place in enumerate(places):
        longest = max((common(place, q) for q in places[:k]), default=0)
        if longest:
            own = runs[place[0]]
            if own and place[1] < own[-1][1]:
                own[-1][1] = max(own[-1][1], place[1] + longest)
            else:
                own.append([place[1], place[1] + longest])
    for i, own in runs.items():
        for a, b in reversed(own):
            if len(" ".join(lines[i][a:b]).split()) >= min_words:
                del kept[i][a:b]
    return {i: "\n".join(x) for i, x in kept.items()}


@pytest.mark.parametrize("seed,min_words", [(1, 0), (2, 3), (3, 5)])
def test_op3_against_all_pairs_of_places(spark, seed, min_words):
    rng = np.random.default_rng(seed)
    pool = ["", "a", "b b", "c c c", "d e f g h i"]
    texts = {i: "\n".join(pool[k] for k in rng.choice(5, rng.integers(1, 14), p=[0.1, 0.3, 0.3, 0.2, 0.1])) for i in range(9)}
    texts |= {9: texts[0], 10: "x\n" + texts[1] + "\ny"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in remove_repeated_lines(docs, min_words).collect()} == brute_lines(texts, min_words)


@pytest.mark.parametrize("n", [5, 9, 90, 400, 3000])
def test_op2_signatures_agree_as_often_as_sets(n):
    """At every size of a set, slots agree with the similarity, and prefixes are shared as the formula says."""
    rng = np.random.default_rng(n)
    both = round(n * 1.6 / 1.8)
    sets = [mixed(rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)) for _ in range(200)]
    first, similarity = np.arange(201) * n, both / (2 * n - both)
    a, b = (signatures(first, np.concatenate(x)) for x in ([s[:n] for s in sets], [s[n - both :] for s in sets]))
    assert abs((a == b).mean() - similarity) < 0.02
    for depth in (8, 16):
        shared = (a == b).reshape(200, TREES, DEPTH)[:, :, :depth].all(2).any(1).mean()
        assert abs(shared - found_share(similarity, depth)) < 0.12


def test_op2_depth_shortens_with_the_links():
    edges = 0.8 + np.arange(BINS) * 0.01
    alike, at_the_threshold = np.zeros(BINS), np.zeros(BINS)
    alike[-1] = at_the_threshold[0] = 1000
    assert forest_depth(edges, alike, 0.999) == DEPTH and forest_depth(edges, at_the_threshold, 0.999) == 7


def test_op2_recall_against_brute_force(spark):
    """Queries of ids divisible by 20 against all rows, one size up; small and large sets alike."""
    folder = SF.replace("sf0.001", "sf0.01")
    texts = pd.read_parquet(f"{folder}/documents.parquet").set_index("doc_id")["text"].to_dict()
    found = {r.doc_id: (r.n_links, r.n_shingles) for r in near_duplicates(table(spark, folder, "documents")).collect()}
    sets = {i: set(zip(*(w[k:] for k in range(5)))) if len(w := (t or "").split()) >= 5 else {tuple(w)} - {()} for i, t in texts.items()}
    want, got = {True: 0, False: 0}, {True: 0, False: 0}
    for i in (i for i in sets if i % 20 == 0 and sets[i]):
        links = sum(len(sets[i] & s) >= 0.8 * len(sets[i] | s) for j, s in sets.items() if j != i and s)
        assert found[i][0] <= links
        want[found[i][1] > 100] += links
        got[found[i][1] > 100] += found[i][0]
    assert all(got[k] >= 0.9 * want[k] for k in want)


def test_op8_pairs_against_a_double_loop():
    rng = np.random.default_rng(4)
    first, terms = np.array([0, 3, 3, 8]), rng.integers(0, 1 << 18, 8)
    linear, factors = rng.normal(0, 1, 1 << 18), rng.normal(0, 1, (3, 1 << 18))
    found = Machine(0.2, linear, factors).score(first, terms)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        own = terms[a:b]
        z = 0.2 + sum(linear[t] for t in own) + sum(factors[:, own[j]] @ factors[:, own[k]] for j in range(len(own)) for k in range(j))
        assert np.isclose(found[i], 1 / (1 + np.exp(-z)))


def test_op10_rebuilt_plainly(spark):
    """Each source's stream cut in blocks, its quota drawn block by block, and the shards' shares."""
    mixed = mix_sources(table(spark, SF, "documents"))
    pieces = shard_order(mixed).toPandas()
    docs = mixed.drop("pieces").toPandas()
    assert not pieces.duplicated(["source", "block", "pass", "row", "first_word"]).any()
    assert pieces["place"].is_monotonic_increasing and (pieces.sort_values("place")["shard"].diff().dropna() >= 0).all()
    blocks = pieces.groupby(["source", "block", "pass"], dropna=False).agg(n=("n_words", "sum"), shards=("shard", "nunique"), shard=("shard", "first"))
    assert (blocks["shards"] == 1).all()
    for source, own in docs.groupby("source", dropna=False):
        size, target = own["size"].sum(), own["target"].iloc[0]
        assert own["source_size"].iloc[0] == size
        drawn = blocks.reset_index()
        drawn = drawn[drawn["source"].isna() if pd.isna(source) else drawn["source"] == source]
        n_blocks = min(size, max(1024, -(-size // 512)))
        assert len(drawn) == round(target * n_blocks / size)
        wide, narrow = size % n_blocks, size // n_blocks
        assert (drawn["n"] == narrow + (drawn["block"] < wide)).all()
        # earlier passes are whole before a block is drawn again
        assert (drawn.groupby("block")["pass"].max() <= len(drawn) // n_blocks).all()
    shares = blocks.groupby("shard").size()
    assert shares.max() - shares.min() <= 5
    taken = pieces.groupby("row")["n_words"].sum()
    assert drawn_words(mixed).toPandas().set_index("row")["taken"].sort_index().equals(docs.set_index("row")["size"].sort_index().mul(0).add(taken, fill_value=0).astype("int64").rename("taken"))


def test_op4_against_the_library(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op4_token_counts(spark, SF).collect()}
    for i, t in zip(docs.doc_id, docs.text):
        n = len(sp.encode(t or ""))
        assert found[i] == (len((t or "").encode()), n, n > 4096)


def test_op8_on_held_out_labels(spark):
    """At the next larger size: the smallest holds too few toxic rows to learn from."""
    folder = SF.replace("sf0.001", "sf0.01")
    labels = pd.read_parquet(f"{folder}/labels.parquet")
    found = queries.op8_toxicity(spark, folder).toPandas()
    assert found["score"].between(0, 1).all()
    assert (found["held_out"] == found["doc_id"].map(lambda i: crc32(str(i).encode()) % 3 == 1)).all()
    assert (found["predicted"] == (found["score"] >= 0.7)).all()
    held = found[found["held_out"]].merge(labels, on="doc_id")
    assert auc(held["score"], held["toxic"]) > 0.8


def test_op8_learns_pairs_of_terms_that_tell_nothing_alone():
    """Toxic is who has both of two neutral terms or neither."""
    rng = np.random.default_rng(1)
    has = rng.random((1600, 2)) < 0.5
    words = [[f"filler{k}" for k in rng.integers(0, 200, 8)] for _ in has]
    texts = [" ".join(w + ["group"] * int(a) + ["insult"] * int(b)) for w, (a, b) in zip(words, has)]
    y = (has[:, 0] == has[:, 1]).astype(int)
    (first, terms), (new_first, new_terms) = (next(hashed_terms(pa.array(t))) for t in (texts[:1200], texts[1200:]))
    machine = fit_machine(first, terms, y[:1200])
    assert auc(machine.score(new_first, new_terms), y[1200:]) > 0.95


def test_op10_meets_targets_and_reruns_agree(spark):
    found = queries.op10_mixing(spark, SF).toPandas().sort_values("doc_id", ignore_index=True)
    again = queries.op10_mixing(spark, SF).toPandas().sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(found, again)
    assert (found["taken"] <= 3 * found["size"]).all()
    by = found.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert (by["size"] == by.index).all()
    assert np.allclose(by["target"].sum(), by["size"].sum())
    assert (abs(by["taken"] - by["target"]) <= 0.02 * by["target"] + 1).all()
    assert (by["target"] <= 3 * by["size"] + 1e-6).all()


def test_quota_tree_is_exact(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 7), (2, 0), (3, 123456)], "nth int, quota long")
    split = split_quotas(quotas, 3, 5).toPandas()
    assert split.groupby("nth")["blocks"].sum().to_dict() == {0: 1000, 1: 7, 2: 0, 3: 123456}
    assert (split["blocks"] >= 0).all()
    per_shard = split.groupby("shard")["blocks"].sum()
    assert per_shard.max() - per_shard.min() <= 3


def test_pipeline_stage_by_stage(spark, docs):
    """Each stage against a plain version of its decision, on what the stage before kept."""
    folder = {}
    current = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        folder[name] = stage(spark, current, SF).toPandas()
        if name != "source_mixing":
            assert list(folder[name].columns) == list(docs.columns)
            current = spark.createDataFrame(folder[name])
    lines = folder["line_dedup"]
    assert lines["doc_id"].is_unique and set(lines["doc_id"]) <= set(folder["quality_classifier"]["doc_id"])
    classes = brute_classes(dict(zip(lines.doc_id, lines.text)))
    assert set(folder["jaccard_join"]["doc_id"]) == {i for i, (c, _) in classes.items() if i == c}
    clean = set(folder["benchmark_decontamination"]["doc_id"])
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for t in bench.text:
        w = word.findall(t.lower())
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    for i, t in zip(folder["jaccard_join"].doc_id, folder["jaccard_join"].text):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hit = any(tuple(w[p : p + n]) in windows for n in {len(x) for x in windows} for p in range(len(w) - n + 1))
        assert (i in clean) != hit
    assert set(folder["source_mixing"]["doc_id"]) == clean
