"""Groups and species: many starts side by side, folds side by side, importances and reports as frames."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from arborlake.operators import descriptors, kmeans, species, stand
from arborlake.plans.queries import QUERIES

from .conftest import SF


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.7, (60, 3)) for c in ((0, 0, 0), (4, 0, 1), (0, 5, 2), (5, 5, 0), (2, 2, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(7)
    return x, df


def test_cost_is_the_least_of_all_starts(spark, blobs):
    x, df = blobs
    centres, cost = kmeans.best_centres(df, 5, starts=20)
    assert np.isclose(((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum(), cost)
    vectors = df.select(array_to_vector("features").alias("features")).cache()
    other = min(KMeans(k=5, seed=s, maxIter=50).fit(vectors).summary.trainingCost for s in range(8))
    assert cost <= other * (1 + 1e-3)
    told = {r.id: r.prediction for r in kmeans.nearest_centre(df, centres).collect()}
    assert [told[i] for i in range(len(x))] == ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1).tolist()


def test_starts_do_not_depend_on_partitions(spark, blobs):
    _, df = blobs
    a, b = (kmeans.best_centres(df.repartition(n), 3, starts=4)[0] for n in (1, 5))
    assert np.allclose(a, b)


def test_steps_against_plain_steps(spark, blobs):
    """A step is the mean of each start's own rows; a centre without rows stays."""
    x, df = blobs
    centres = np.random.default_rng(1).normal(2, 2, (6, 4, 3))
    centres[2, 1] = 1e6
    after, cost = kmeans._step(df, centres)
    for s, c in enumerate(centres):
        far = ((x[:, None] - c[None]) ** 2).sum(2)
        own = far.argmin(1)
        assert np.isclose(cost[s], far.min(1).sum())
        for e in range(4):
            assert np.allclose(after[s, e], x[own == e].mean(0) if (own == e).any() else c[e])


def test_equal_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id long, features array<double>")
    centres, cost = kmeans.best_centres(df, 3, starts=2)
    assert cost == 0 and (centres == [1.0, 2.0]).all()


def test_structural_groups_leave_out_poor_trees(spark):
    rng = np.random.default_rng(5)
    kind = np.arange(80) % 4
    rows = pd.DataFrame({"tree_id": np.arange(80), "n_points": 9, "height_m": kind * 10 + rng.normal(5, 0.2, 80), "a": kind + rng.normal(0, 0.1, 80), "b": kind % 2 + rng.normal(0, 0.1, 80)})
    trees = spark.createDataFrame([(i, "poor" if i % 10 == 9 else "good") for i in range(80)], "tree_id long, quality string")
    found = stand.structural_groups(spark.createDataFrame(rows), trees).toPandas().set_index("tree_id")["structural_group"]
    assert len(found) == 80
    for i in range(80):
        assert pd.isna(found[i]) if i % 10 == 9 else found[i] == kind[i]


def test_species(spark):
    rng = np.random.default_rng(7)
    kind = np.arange(90) % 3
    features = spark.createDataFrame(pd.DataFrame({"tree_id": np.arange(90), "tells": kind + rng.normal(0, 0.2, 90), "noise": rng.normal(0, 1, 90)}))
    features = features.withColumn("tells", F.when(F.col("tree_id") % 20 != 7, F.col("tells")))
    labels = spark.createDataFrame([(i, f"s{k}" if i % 30 else None) for i, k in enumerate(kind.tolist())], "tree_id long, species string")
    found = species.species_model(features, labels, n_trees=40)
    told = found.predicted.toPandas()
    assert sorted(told["tree_id"]) == [i for i in range(90) if i % 30] and set(told["fold"]) == set(range(5))
    assert (told["species"] == told["predicted"]).mean() > 0.85
    importance = found.importance.orderBy("rank").collect()
    assert [(r["rank"], r["name"]) for r in importance] == [(1, "tells"), (2, "noise")] and abs(sum(r["weight"] for r in importance) - 1) < 1e-9
    assert found.model.getNumTrees == 40


def test_forests_are_fitted_when_asked_for_by_many_tasks(spark, monkeypatch):
    """What weighs takes one forest and the predictions one a fold; two species don't mean two tasks."""
    features = spark.createDataFrame([(i, float(i % 2), float(i)) for i in range(80)], "tree_id long, a double, b double")
    labels = spark.createDataFrame([(i, f"s{i % 2}") for i in range(80)], "tree_id long, species string")
    fits = []
    whole = species.RandomForestClassifier.fit
    monkeypatch.setattr(species.RandomForestClassifier, "fit", lambda self, *a: fits.append(1) or whole(self, *a))
    found = species.species_model(features, labels, n_trees=5)
    assert not fits and sum(len(p) > 0 for p in found.dealt.rdd.glom().collect()) == spark.sparkContext.defaultParallelism
    assert found.importance.count() == 2 and len(fits) == 1
    assert found.predicted.count() == 80 and len(fits) == 6


def test_forests_keep_the_node_of_each_row(spark):
    """Rounds don't walk all rows down all trees again; the forest is the one that is grown by walking."""
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"tree_id": np.arange(200), "a": rng.normal(0, 1, 200), "b": rng.normal(0, 1, 200)})
    labels = spark.createDataFrame([(i, f"s{int(a > 0)}") for i, a in enumerate(rows["a"] + rng.normal(0, 1, 200))], "tree_id long, species string")
    found = species.species_model(spark.createDataFrame(rows), labels, n_trees=5)
    assert found.forest.getCacheNodeIds()
    walked = found.forest.copy().setCacheNodeIds(False).fit(found.dealt)
    assert walked.toDebugString.split("\n", 1)[1] == found.model.toDebugString.split("\n", 1)[1]


def test_descriptors_read_the_cloud_once(spark):
    plan = QUERIES["tree_feature_table"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_medians(spark):
    df = spark.createDataFrame([(1.0, None, 3), (2.0, None, None), (7.0, None, 4)], "a double, b double, c long")
    assert descriptors.medians(df, ["a", "b", "c"]) == {"a": 2.0, "b": 0.0, "c": 3.5}


def test_distances_of_a_batch_are_made_start_by_start():
    rng = np.random.default_rng(2)
    x, centres = rng.normal(size=(10_000, 25)), rng.normal(size=(20, 4, 25))
    tracemalloc.start()
    far = kmeans._squares(x, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    assert np.array_equal(far, ((x[None, :, None] - centres[:, None]) ** 2).sum(3))


def test_class_report(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("a", "d")]
    found = {r.species: (r.precision, r.recall, round(r.f1, 6), r.support) for r in species.class_report(spark.createDataFrame(rows, "species string, predicted string")).collect()}
    assert found == {"a": (0.5, 1 / 3, 0.4, 3), "b": (0.5, 1.0, round(2 / 3, 6), 1), "c": (0.0, 0.0, 0.0, 1), "d": (0.0, 0.0, 0.0, 0)}
