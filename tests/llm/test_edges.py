"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arborlake.llm import quality
from arborlake.llm.decontaminate import find_contamination
from arborlake.llm.exact_dedup import exact_duplicates
from arborlake.llm.line_dedup import remove_repeated_lines
from arborlake.llm.mixing import drawn_words, mix_sources, shard_order, taken_words
from arborlake.llm.near_duplicates import near_duplicates
from arborlake.llm.quality import fit_quality, score_quality
from arborlake.llm.substring_dedup import remove_repeats
from arborlake.llm.token_counts import token_counts
from arborlake.llm.toxicity import fit_toxicity, score_toxicity
from arborlake.llm.url_filter import filter_urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, keep string, h string, rank long, n long, token string"
PASSAGE = " ".join(f"w{i}" for i in range(20))
ROWS = [
    (1, PASSAGE, "en", "a", 5),
    (1, PASSAGE, "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (4, "  \n\t ", "de", "b", 3),
    (None, PASSAGE + " end", "en", "a", 7),
    (5, "long " * 200_000, "en", "b", 1_000_000),
    (6, "x\ny\nz\n" + PASSAGE, "en", "b", 9),
    (7, "x\ny\nq", "en", "b", 9),
    (8, "Ünïcödé ✓ text\u00a0here", "en", "c", 9),
]
BENCH = [("i1", PASSAGE), ("i2", None), (None, ""), ("i3", "x y"), ("i3", "x y")]


def fill(rows):
    return [(*r, "clash", "clash", "clash", 1, 1, "clash") for r in rows]


@pytest.fixture(params=["rows", "empty"])
def docs(request, spark):
    return spark.createDataFrame(fill(ROWS if request.param == "rows" else []), SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def labels_of(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, 1), (3, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")


def test_quality(spark, docs):
    model = fit_quality(docs, labels_of(spark))
    assert score_quality(docs, model).where("keep").count() == docs.count()


def test_quality_sums_do_not_grow_with_tasks(spark):
    """The driver gets as many bytes from 300 tasks as from 3, and the same sum."""
    rows = np.random.default_rng(2).normal(size=(900, quality.CONTENT + quality.META)).astype(np.float32)
    pool = spark.createDataFrame([(r.tobytes(),) for r in rows], "views binary")
    per_block = lambda block: np.concatenate([v.sum(0, dtype=np.float64) for v in block])
    for n in (3, 300):
        parts = quality._partial_sums(pool.repartition(n), per_block).collect()
        assert len(parts) == quality.CHUNKS and sum(len(p.total) for p in parts) == 8 * rows.shape[1]
        assert np.allclose(quality._summed(pool.repartition(n), per_block), rows.sum(0, dtype=np.float64))
    assert np.ndim(quality._summed(pool.limit(0), per_block)) == 0


def test_quality_pool_is_every_document_outside_the_sample(spark):
    """More documents than any fixed slice, all of them labelled."""
    ids = spark.range(10_400).withColumnRenamed("id", "doc_id")
    docs = ids.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("A fine page of plain words.")).otherwise(F.lit("#### 000 !!! ###")))
    model = fit_quality(docs, ids.withColumn("quality", (F.col("doc_id") % 2 == 0).cast("int")), max_labelled=10_000)
    assert model.n_pool == 400
    kept = score_quality(docs, model).where("keep")
    assert kept.count() == kept.where("doc_id % 2 = 0").count() == 5_200


def test_near_duplicates(docs):
    found = near_duplicates(docs)
    rows = found.collect()
    assert len(rows) == docs.count()
    if rows:
        own = by_id(found)
        # 16 shingles in ids 1 and 1, the same and one more in the row without id, and three more in id 6
        assert own[1].n_links == 3 and own[None].class_id == own[6].class_id == 1 and own[None].n_links == own[6].n_links == 3
        assert own[2].n_links == own[3].n_links == own[4].n_links == 0 and own[5].class_id == 5
        assert own[1].kept and own[5].kept and not own[None].kept and not own[6].kept


def test_rows_of_one_id_keep_their_links(spark):
    """Different texts under one id, or under none, are classes of their own."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    for i in (None, 3):
        docs = spark.createDataFrame([(1, a), (2, b), (i, a + " more"), (i, b + " more")], "doc_id long, text string")
        rows = near_duplicates(docs).collect()
        assert sorted(r.class_id for r in rows) == [1, 1, 2, 2] and all(r.n_links == 1 for r in rows)


def test_line_dedup(docs):
    found = remove_repeated_lines(docs)
    assert found.count() == docs.count()
    if (own := by_id(found)):
        # the passage is one long line; two short lines together hold too few words
        assert own[6].text == "x\ny\nz" and own[6].n_removed == 1 and own[7].n_removed == 0 and own[1].n_removed == 0
        assert own[2].text is None and own[2].n_lines == 1 and own[7].h == "clash"
    short = by_id(remove_repeated_lines(docs, min_words=2))
    if short:
        assert short[7].text == "q" and short[7].n_removed == 2


def test_token_counts(docs):
    found = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert found.count() == docs.count()
    if (own := by_id(found)):
        assert own[2].n_tokens == own[3].n_tokens == 0 and own[5].over_limit and own[5].n_bytes == 1_000_000


@pytest.mark.parametrize("most", [500_000, 0])
def test_contamination(spark, docs, most):
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    found = find_contamination(docs, bench, broadcast_rows=most)
    assert found.count() == docs.select("doc_id").distinct().count()
    if (own := by_id(found)):
        assert own[1].n_hit == 20 and own[1].items == ["i1"]
        assert own[6].n_hit == 22 and own[6].items == ["i1", "i3"]
        assert own[7].n_hit == 2 and own[2].n_words == own[3].n_words == 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_contamination_without_an_id(spark, most):
    docs = spark.createDataFrame([(None, PASSAGE + " end"), (1, "clean words")], "doc_id long, text string")
    own = by_id(find_contamination(docs, spark.createDataFrame(BENCH, "item_id string, text string"), broadcast_rows=most))
    assert own[None].n_hit == 20 and own[None].items == ["i1"] and own[1].n_hit == 0


def test_contamination_without_a_benchmark(spark, docs):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert find_contamination(docs, bench).where("n_hit > 0").count() == 0


def test_substring(docs):
    found = remove_repeats(docs)
    assert found.count() == docs.count()
    if (own := by_id(found)):
        assert own[1].n_removed == 0 and own[6].kept == "x y z" and own[None].kept == "end"
        assert own[2].kept == own[4].kept == ""


@pytest.mark.parametrize("keep,best", [("max", 3), ("min", 2)])
@pytest.mark.parametrize("collide", [False, True])
def test_exact(docs, keep, best, collide):
    hash_of = {"hash_of": lambda c: F.lit(b"same")} if collide else {}
    found = exact_duplicates(docs, keep=keep, **hash_of)
    assert found.count() == docs.count()
    if (own := by_id(found)):
        assert own[2].keep_id == own[3].keep_id == best and own[2].group_size == 2 and own[1].group_size == 2
        assert own[5].kept and own[5].group_size == 1


@pytest.fixture
def fitted_on(spark):
    """Documents and labels enough to fit on, of both kinds."""
    rows = [(100 + i, "you group insult words" if i % 2 else "a calm page about trees", "en", "a", 9) for i in range(200)]
    labels = [(100 + i, 1 - i % 2, i % 2) for i in range(200)]
    return spark.createDataFrame(fill(rows), SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_fitted_models_on_odd_rows(docs, fitted_on):
    known, labels = fitted_on
    toxic, quality = fit_toxicity(known, labels), fit_quality(known.unionByName(docs), labels)
    assert toxic.linear.any() and quality.content is not None
    for rows in (docs, known):
        scores = score_toxicity(rows, toxic).collect()
        assert len(scores) == rows.count() and all(0 <= r.score <= 1 for r in scores)
        kept = score_quality(rows, quality).collect()
        assert len(kept) == rows.count() and all(0 <= r.score <= 1 for r in kept)
    assert {r.predicted for r in score_toxicity(known, toxic).collect() if r.doc_id % 2} == {1}


def test_toxicity_sample_is_bounded(docs, fitted_on):
    known, labels = fitted_on
    many = known.unionByName(known).unionByName(docs)
    assert (fit_toxicity(many, labels).linear == fit_toxicity(known, labels).linear).all()
    assert not fit_toxicity(known, labels, max_mb=0).linear.any()


def test_toxicity(spark, docs):
    scored = score_toxicity(docs, fit_toxicity(docs, labels_of(spark)))
    assert scored.where("score between 0 and 1").count() == docs.count()


def test_urls(spark):
    urls = [(1, "http://WWW.example.com/en/a?b"), (1, "http://WWW.example.com/en/a?b"), (2, None), (3, "no scheme"), (None, "x://net/es/#q"), (5, "a://b://c/d"), (6, "http://sub.example.com/en/")]
    pages = spark.createDataFrame([(*u, "clash") for u in urls], "page_id long, url string, host string")
    found = {r.page_id: r for r in filter_urls(pages).collect()}
    assert filter_urls(pages).count() == len(urls)
    assert (found[1].host, found[1].path, found[1].rule, found[1].verdict) == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert found[6].verdict == "block" and found[None].rule == "net/es/" and (found[2].host, found[3].host) == ("", "")
    assert (found[5].host, found[5].path) == ("b:", "//c/d")
    assert filter_urls(pages.limit(0)).count() == 0


def test_mixing(docs):
    mixed = mix_sources(docs)
    found = mixed.withColumn("taken", taken_words())
    assert found.count() == drawn_words(mixed).count() == docs.count()
    assert shard_order(mixed).where("n_words <= 0").count() == 0
    assert found.where("taken > 3 * size").count() == 0
    assert found.where("size = 0 and taken > 0").count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    spark.createDataFrame(BENCH, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels_of(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= docs.count()


def test_pipeline_decontaminates_rows_not_ids(spark, tmp_path):
    """Rows that share an id, or have none, are judged by their own texts."""
    spark.createDataFrame([("i1", PASSAGE)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = "nothing of the kind stands in this text at all"
    rows = [(None, PASSAGE), (None, clean), (7, "so " + PASSAGE), (7, clean), (8, "fine"), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.without_benchmark(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, clean), (7, clean), (8, "fine"), (None, None), (9, "")], key=str)
