"""Species from descriptors: a forest of trees with out-of-fold predictions."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint
from .descriptors import medians
from .views import stratified_folds


#: Fixed value: the deepest trees that Spark grows; in the method trees grow until their leaves can't be cut.
DEEPEST = 30


@dataclass
class SpeciesModel:
    """Forests on one stored table: ``predicted`` out of fold (``tree_id, species, predicted, fold``), ``importance`` (``rank, name,
    weight``) and the ``model`` fitted on all. Each is fitted when first asked for: no fold is needed to tell what weighs, and the
    forest on all tells no tree out of fold.
    """

    dealt: DataFrame
    names: list[str]
    species: list[str]
    forest: RandomForestClassifier

    @cached_property
    def model(self) -> RandomForestClassificationModel:
        return self.forest.fit(self.dealt)

    @cached_property
    def predicted(self) -> DataFrame:
        """The folds are fitted side by side, since each fit alone has long stretches of small jobs."""
        dealt, spark = self.dealt, self.dealt.sparkSession
        used = [r["fold"] for r in dealt.select("fold").distinct().orderBy("fold").collect()]
        if len(used) < 2:
            return dealt.select("tree_id", "species", F.lit(None).cast("string").alias("predicted"), "fold").limit(0)

        def fit(k: int) -> RandomForestClassificationModel:
            return self.forest.fit(dealt.where(F.col("fold") != k))

        with ThreadPoolExecutor(len(used)) as pool:
            models = list(pool.map(inheritable_thread_target(spark)(fit), used))
        names_of = F.array(*[F.lit(x) for x in self.species])
        told = [
            m.transform(dealt.where(F.col("fold") == k)).select("tree_id", "species", F.get(names_of, F.col("prediction").cast("int")).alias("predicted"), "fold")
            for k, m in zip(used, models, strict=True)
        ]
        return reduce(DataFrame.unionByName, told)

    @cached_property
    def importance(self) -> DataFrame:
        """Heaviest first, equal ones by name."""
        heaviest = sorted(zip(self.names, self.model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
        return self.dealt.sparkSession.createDataFrame([(i + 1, n, w) for i, (n, w) in enumerate(heaviest)], "rank int, name string, weight double")


def species_model(features: DataFrame, labels: DataFrame, n_trees: int = 500, folds: int = 5, seed: int = 42) -> SpeciesModel:
    """Fit on ``features`` (``tree_id``, descriptors) and ``labels`` (``tree_id, species``).

    Missing values take the median; species weigh alike.
    """
    names = [c for c in features.columns if c != "tree_id"]
    joined = checkpoint(features.join(labels.select("tree_id", "species").where("species is not null"), "tree_id"))
    weights = joined.groupBy("species").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    ready = joined.na.fill(medians(joined, names)).join(F.broadcast(weights), "species")
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(ready)
    index = StringIndexer(inputCol="species", outputCol="label", stringOrderType="alphabetAsc").fit(ready)
    dealt = stratified_folds(index.transform(ready), "label", [F.xxhash64(F.lit(seed), "tree_id"), "tree_id"], folds)
    # dealing by label leaves a file for each species; the fits have as many tasks as the table has files
    tasks = features.sparkSession.sparkContext.defaultParallelism
    dealt = checkpoint(dealt.select("tree_id", "species", "label", "weight", "fold", "features").repartition(tasks, "tree_id"))
    # tasks keep the node of each row, else every round walks all rows down all trees again, those in finished leaves too
    forest = RandomForestClassifier(
        numTrees=n_trees, minInstancesPerNode=2, maxDepth=DEEPEST, maxMemoryInMB=1024, weightCol="weight", seed=seed, cacheNodeIds=True
    )
    return SpeciesModel(dealt, names, list(index.labels), forest)


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("species", "predicted").agg(F.count(F.lit(1)).alias("n"))


def class_report(predicted: DataFrame) -> DataFrame:
    """``species, precision, recall, f1, support`` of every species that occurs or is predicted; shares of nothing are 0."""
    hit = F.count_if(F.col("species").eqNullSafe(F.col("predicted"))).alias("hits")
    real = predicted.groupBy("species").agg(F.count(F.lit(1)).alias("support"), hit)
    told = predicted.groupBy(F.col("predicted").alias("species")).agg(F.count(F.lit(1)).alias("told"))
    both = real.join(told, "species", "full").na.fill(0, ["support", "hits", "told"])
    precision, recall = (F.coalesce(F.try_divide("hits", n), F.lit(0.0)) for n in ("told", "support"))
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("told") + F.col("support")), F.lit(0.0))
    return both.select("species", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")
