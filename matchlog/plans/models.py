"""Training and scoring with Spark ML on the final matrix.

Every frame that is fitted more than once is materialised first, so that the feature plan
runs once and survives lost executors.
"""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlog.functions.scalar import clip, plain_names
from matchlog.operators.shaping import answer_spine
from matchlog.plans import scoring
from matchlog.plans.assemble import feature_columns
from matchlog.session import checkpoint_folder, materialize, shared_folder

LABEL = "winner"
#: Rows of a partition that trees are fitted on, at most.
FIT_ROWS = 250_000

# Search bounds per parameter.
BOUNDS = {
    "iterations": (10, 1000),
    "learning_rate": (0.001, 0.1),
    "leaves": (16, 1024),
    "feature_fraction": (0.5, 1.0),
    "bagging_fraction": (0.8, 1.0),
    "min_rows_in_leaf": (5, 50),
}


def assembled(matrix: DataFrame) -> DataFrame:
    """Key, label and feature vector, with plain column names."""
    plain = plain_names(matrix)
    vector = VectorAssembler(
        inputCols=feature_columns(plain), outputCol="features", handleInvalid="error"
    )
    kept = [c for c in ("game_id", LABEL) if c in plain.columns]
    return vector.transform(plain).select(*kept, "features")


def gbt(seed: int = 20, weight: str | None = None, **params) -> GBTClassifier:
    """Boosted trees; ``weight`` names a row-weight column."""
    model = GBTClassifier(labelCol=LABEL, featuresCol="features", seed=seed, **params)
    return model.setWeightCol(weight) if weight else model


def with_scores(model, rows: DataFrame) -> DataFrame:
    """``game_id``, label if there is one, and the probability of player 1 winning."""
    scored = model.transform(rows)
    kept = [c for c in ("game_id", LABEL) if c in rows.columns]
    return scored.select(*kept, vector_to_array("probability")[1].alias("score"))


def class_weights(rows: DataFrame, positive: float) -> DataFrame:
    """A weight column that counts winners of class 1 ``positive`` times."""
    return rows.withColumn("weight", F.when(F.col(LABEL) == 1, positive).otherwise(1.0))


def gbt_holdout(matrix: DataFrame, positive: float = 1.0, **params) -> DataFrame:
    """Scores of the held-out games, from trees fitted on the training part."""
    rows = materialize(
        class_weights(scoring.stable_split(assembled(matrix)), positive)
    )
    model = gbt(weight="weight", **params).fit(rows.where(F.col("part") == "train"))
    return with_scores(model, rows.where(F.col("part") != "train"))


def gbt_early_stopped(matrix: DataFrame, **params) -> tuple[GBTClassificationModel, DataFrame]:
    """Trees that stop once the validation part no longer improves, and the assembled rows."""
    rows = materialize(
        scoring.stable_split(assembled(matrix)).withColumn("is_valid", F.col("part") == "valid")
    )
    model = gbt(validationIndicatorCol="is_valid", **params).fit(
        rows.where(F.col("part") != "test")
    )
    return model, rows


def learning_curve(matrix: DataFrame, **params) -> DataFrame:
    """Validation loss after each round."""
    rows = materialize(scoring.stable_split(assembled(matrix)))
    model = gbt(**params).fit(rows.where(F.col("part") == "train"))
    losses = model.evaluateEachIteration(rows.where(F.col("part") == "valid"))
    return matrix.sparkSession.createDataFrame(
        list(enumerate(losses, start=1)), "round INT, loss DOUBLE"
    )


def at_once(spark: SparkSession, jobs: list[Callable], parallelism: int) -> list:
    """The jobs' results in order, ``parallelism`` of them on the cluster at a time."""
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


def margin_steps(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """Rows with ``steps``: what each tree of the model adds to the row's margin, in order."""
    found, names = rows, []
    for i, tree in enumerate(model.trees):
        names.append(f"_tree{i}")
        found = tree.setFeaturesCol("features").setPredictionCol(names[-1]).transform(found)
    steps = [F.col(n) * float(w) for n, w in zip(names, model.treeWeights)]
    return found.select(*rows.columns, F.array(*steps).alias("steps"))


def fold_rows(matrix: DataFrame, folds: int = 5, parallelism: int = 8) -> DataFrame:
    """The assembled matrix with contiguous folds, as a table that fits can read again.

    Its partitions are as many as there are cores for each of ``parallelism`` fits at a time, of
    at most ``FIT_ROWS`` rows: in every level of every tree each partition sends statistics of
    all nodes, features and bins, however few its rows.
    """
    rows = materialize(scoring.contiguous_folds(assembled(matrix), folds).drop("position"))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(1, math.ceil(cores / max(1, parallelism)), math.ceil(rows.count() / FIT_ROWS)))


def cv_learning_curve(
    matrix: DataFrame, folds: int = 5, parallelism: int = 5, **params
) -> DataFrame:
    """Held-out AUC of every (fold, round), each fold's trees fitted on the other folds.

    A fold is fitted once. Its held-out rows pass all trees in one scan, and the AUC after
    every round comes from running sums of what the trees add to the margin.
    """
    rows = fold_rows(matrix, folds, parallelism)

    def fit(k: int) -> Callable:
        return lambda: gbt(**params).fit(rows.where(F.col("fold") != k))

    fitted = at_once(rows.sparkSession, [fit(k) for k in range(folds)], parallelism)
    held = [margin_steps(m, rows.where(F.col("fold") == k)) for k, m in enumerate(fitted)]
    steps = [h.select("game_id", "fold", F.col(LABEL).alias("label"), "steps") for h in held]
    return scoring.fold_curve(materialize(reduce(DataFrame.unionByName, steps)))


def cut_votes(depths: list[int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of a tree's saved nodes, what each leaf votes for each class once the tree is cut at each
    depth. As in a fit, two leaves of the same prediction are merged into their parent."""

    def votes(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("id")
        children = nodes[["leftChild", "rightChild"]].to_numpy()
        inner, chosen = children[:, 0] >= 0, nodes["prediction"].to_numpy()
        counts = np.stack(nodes["impurityStats"].tolist())
        shares = counts / counts.sum(axis=1, keepdims=True)
        parent = np.zeros(len(nodes), int)
        parent[children[inner]] = np.flatnonzero(inner)[:, None]
        levels = [np.zeros(1, int)]
        while len(below := children[levels[-1]][inner[levels[-1]]].ravel()):
            levels.append(below)
        found = []
        for depth in depths:
            ends = ~inner
            for level in levels[depth : depth + 1]:
                ends[level] = True
            for level in reversed(levels[:depth]):
                split = level[inner[level]]
                left, right = children[split].T
                ends[split] = ends[left] & ends[right] & (chosen[left] == chosen[right])
            at, over = np.arange(len(nodes)), ends.copy()
            for level in levels[1:]:
                above = parent[level]
                at[level] = np.where(over[above], at[above], level)
                over[level] |= over[above]
            found.append(shares[at[~inner]])
        by_leaf = np.concatenate(found, axis=1)
        return pd.DataFrame({"tree": int(nodes["treeID"].iloc[0]), "leaf": np.arange(len(by_leaf)), "votes": list(by_leaf)})

    return votes


def depth_sweep(matrix: DataFrame, depths: list[int], trees: int = 20, seed: int = 1) -> DataFrame:
    """Validation accuracy of a random forest per depth (Spark allows depths up to 30).

    A forest grows level by level, so its first levels are the forest of a smaller depth: one is
    fitted, of the largest depth, and cut at each. Validation rows pass it once, which gives the
    leaves they reach; a leaf's votes after each cut come from the saved nodes. Spark draws the
    features of a split in the order in which it splits nodes. That order is by level, the same
    for all depths, as long as the nodes of a level fit into ``maxMemoryInMB``; beyond that a
    forest fitted with a smaller depth draws others, from the same seed.
    """
    spark = matrix.sparkSession
    rows = materialize(scoring.stable_split(assembled(matrix)))
    train, valid = rows.where(F.col("part") == "train"), rows.where(F.col("part") == "valid")
    forest = RandomForestClassifier(labelCol=LABEL, maxDepth=max(depths), numTrees=trees, seed=seed).fit(train)
    path = f"{shared_folder(spark).rstrip('/')}/matchlog-{uuid.uuid4().hex}"
    forest.save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").drop("split")
    votes = nodes.groupBy("treeID").applyInPandas(cut_votes(depths), "tree INT, leaf INT, votes ARRAY<DOUBLE>")
    reached = materialize(
        forest.setLeafCol("leaves")
        .transform(valid)
        .select(F.monotonically_increasing_id().alias("row"), F.col(LABEL).alias("label"), "leaves")
        .select("row", "label", F.posexplode(vector_to_array("leaves")).alias("tree", "leaf"))
        .withColumn("leaf", F.col("leaf").cast("int"))
    )
    # added in the order of the trees, as the model does
    sums = (
        reached.join(votes, ["tree", "leaf"])
        .groupBy("row", "label")
        .agg(F.array_sort(F.collect_list(F.struct("tree", "votes"))).alias("trees"))
        .select("label", F.reduce(F.col("trees.votes"), F.array_repeat(F.lit(0.0), forest.numClasses * len(depths)), lambda total, own: F.zip_with(total, own, lambda a, b: a + b)).alias("sums"))
    )
    cut = [F.slice("sums", 1 + i * forest.numClasses, forest.numClasses) for i in range(len(depths))]
    hits = [F.avg((F.array_position(c, F.array_max(c)) - 1 == F.col("label")).cast("double")) for c in cut]
    return spark.createDataFrame(list(zip(depths, map(float, sums.agg(*hits).first()))), "depth INT, accuracy DOUBLE")


def importances(model, names: list[str]) -> DataFrame:
    """Feature importances, largest first."""
    values = [float(v) for v in model.featureImportances.toArray()]
    return (
        SparkSession.active()
        .createDataFrame(list(zip(names, values)), "feature STRING, importance DOUBLE")
        .orderBy(F.desc("importance"), "feature")
    )


def feature_importance(matrix: DataFrame, k: int = 15, **params) -> DataFrame:
    """The ``k`` most important features of trees fitted on all games."""
    model = gbt(**params).fit(materialize(assembled(matrix)))
    return importances(model, feature_columns(plain_names(matrix))).limit(k)


def sample_parameters(trials: int, bounds: dict = BOUNDS, seed: int = 20) -> list[dict]:
    """Seeded random parameter sets inside the bounds."""
    rng = random.Random(seed)
    return [{n: rng.uniform(lo, hi) for n, (lo, hi) in bounds.items()} for _ in range(trials)]


def tree_parameters(drawn: dict) -> dict:
    """A drawn set as tree parameters: leaves become the depth that holds them, and
    fractions are clipped to [0, 1]."""

    def unit(v: float) -> float:
        return max(0.0, min(1.0, v))

    return {
        "maxIter": int(drawn["iterations"]),
        "stepSize": drawn["learning_rate"],
        "maxDepth": max(1, int(drawn["leaves"]).bit_length() - 1),
        "featureSubsetStrategy": f"{max(unit(drawn['feature_fraction']), 0.01):.4f}"
        if unit(drawn["feature_fraction"]) < 1
        else "all",
        "subsamplingRate": max(unit(drawn["bagging_fraction"]), 0.01),
        "minInstancesPerNode": int(drawn["min_rows_in_leaf"]),
    }


def cv_search(
    matrix: DataFrame,
    trials: int,
    folds: int = 5,
    bounds: dict = BOUNDS,
    seed: int = 20,
    parallelism: int = 4,
) -> DataFrame:
    """Mean AUC over contiguous folds for each sampled parameter set.

    Trials and folds are fitted ``parallelism`` at a time.
    """
    rows = fold_rows(matrix, folds, parallelism)
    estimator = gbt(seed)
    drawn = sample_parameters(trials, bounds, seed)
    grid = [
        {estimator.getParam(n): v for n, v in tree_parameters(d).items()} for d in drawn
    ]
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(labelCol=LABEL, numBins=0),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
        seed=seed,
    )
    fitted = search.fit(rows)
    names = list(bounds)
    return matrix.sparkSession.createDataFrame(
        [
            (i, float(score), *[float(d[n]) for n in names])
            for i, (d, score) in enumerate(zip(drawn, fitted.avgMetrics))
        ],
        "trial INT, auc DOUBLE, " + ", ".join(f"{n} DOUBLE" for n in names),
    )


def halving_search(
    matrix: DataFrame,
    trials: int = 8,
    folds: int = 5,
    bounds: dict = BOUNDS,
    first: int | None = None,
    eta: int = 3,
    seed: int = 20,
    parallelism: int = 8,
) -> DataFrame:
    """Successive halving over sampled parameter sets, by mean AUC over contiguous folds.

    Every trial is fitted with all rounds it drew in ``iterations``, on every fold; the best
    1 / ``eta`` of them go on to the next rung, and so forth until one is left. With ``first``
    the first rung has that many rounds only and each further one ``eta`` times as many, so
    trials that end early are ranked by part of their rounds. A trial never has more rounds than
    it drew. Boosting adds trees one by one, so a trial's trees of one rung
    are the first trees of its next; Spark can't take up a fitted model, though, so a rung
    fits them again, which costs less than eta / (eta - 1) times what going on would. A
    trial's AUC is that of a plain fit with its last number of rounds. The scores of all
    trials and folds of a rung are ranked together, and only one number per trial is read.

    The fits with most rounds start first. A fit keeps its scores as a table, so there are no
    more models on the driver than fits at a time. Each round's margins come from those of the
    round before; checkpoints end that chain of hundreds of rounds.

    One row per trial: the rungs it was in, its rounds, its last AUC, what it drew.
    """
    spark = matrix.sparkSession
    checkpoint_folder(spark)
    rows = fold_rows(matrix, folds, parallelism)
    drawn = sample_parameters(trials, bounds, seed)
    settings = [tree_parameters(d) for d in drawn]
    reached: dict[int, tuple[int, int, float]] = {}

    def held_scores(trial: int, k: int, rounds: int) -> Callable:
        def fit() -> DataFrame:
            model = gbt(seed, **settings[trial] | {"maxIter": rounds}).fit(rows.where(F.col("fold") != k))
            scored = model.transform(rows.where(F.col("fold") == k)).select(
                F.lit(trial).alias("trial"),
                "fold",
                F.col(LABEL).alias("label"),
                vector_to_array("rawPrediction")[1].alias("score"),
            )
            return materialize(scored)

        return fit

    alive, rung, rounds = list(range(trials)), 1, first
    if first is None:
        rounds = max(s["maxIter"] for s in settings)
    while True:
        due = {t: min(rounds, settings[t]["maxIter"]) for t in alive}
        new = [t for t in alive if t not in reached or reached[t][1] < due[t]]
        new.sort(key=lambda t: -due[t])
        jobs = [held_scores(t, k, due[t]) for t in new for k in range(folds)]
        if jobs:
            scores = reduce(DataFrame.unionByName, at_once(spark, jobs, parallelism))
            per_trial = scoring.auc(scores, by=("trial", "fold")).groupBy("trial").agg(F.avg("auc").alias("auc"))
            found = {r.trial: r.auc for r in per_trial.collect()}
        for t in alive:
            reached[t] = (rung, due[t], found[t] if t in new else reached[t][2])
        alive.sort(key=lambda t: (-reached[t][2], t))
        alive = alive[: math.ceil(len(alive) / eta)]
        if len(alive) == 1:
            break
        rung, rounds = rung + 1, rounds * eta
    names = list(bounds)
    return spark.createDataFrame(
        [(t, *reached[t], *[float(drawn[t][n]) for n in names]) for t in range(trials)],
        "trial INT, rungs INT, rounds INT, auc DOUBLE, " + ", ".join(f"{n} DOUBLE" for n in names),
    )


def fit_unit_pca(counts: DataFrame, k: int = 10) -> PipelineModel:
    """Principal components of unit counts, centred as on the fitted log."""
    columns = [c for c in counts.columns if c != "game_id"]
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=columns, outputCol="counts"),
            StandardScaler(inputCol="counts", outputCol="centred", withMean=True, withStd=False),
            PCA(k=k, inputCol="centred", outputCol="components"),
        ]
    ).fit(counts)


def unit_pca(model: PipelineModel, counts: DataFrame, k: int = 10) -> DataFrame:
    """Component values per game."""
    parts = vector_to_array("components")
    return model.transform(counts).select(
        "game_id", *[parts[i].alias(f"unit_pca{i}") for i in range(k)]
    )


def submission(spine: DataFrame, scored: DataFrame) -> DataFrame:
    """Every game of the spine with its score, 0.5 where there is none."""
    answers = scored.select("game_id", clip(F.col("score"), 0.0, 1.0).alias("winner"))
    return answer_spine(spine, answers, 0.5)


def answers(matrix: DataFrame, spine: DataFrame, **params) -> DataFrame:
    """Trees fitted on the labelled games answer for every game of the spine.

    ``matrix`` keeps games without a label; they are scored, and labelled ones get their own
    result. A game of the spine that has no features gets 0.5.
    """
    rows = materialize(assembled(matrix))
    model = gbt(**params).fit(rows.where(F.col(LABEL).isNotNull()))
    known = rows.where(F.col(LABEL).isNotNull()).select("game_id", F.col(LABEL).cast("double").alias("score"))
    scored = with_scores(model, rows.where(F.col(LABEL).isNull())).select("game_id", "score")
    return submission(spine, known.unionByName(scored))
