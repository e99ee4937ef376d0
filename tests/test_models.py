import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from matchlog import queries
from matchlog.plans import models, scoring
from matchlog.session import materialize
from matchlog.sources import sinks


@pytest.fixture(scope="module")
def matrix(spark):
    """Games whose first feature nearly decides the winner."""
    noise = F.pmod(F.col("id") * 7919, F.lit(97)) / 97.0
    return materialize(
        spark.range(240).select(
            F.col("id").cast("int").alias("game_id"),
            (F.pmod(F.col("id") * 31, F.lit(2)) == 1).cast("int").alias("winner"),
            (F.pmod(F.col("id") * 31, F.lit(2)) + noise * 0.8).alias("strong one"),
            noise.alias("weak"),
        )
    )


def test_holdout_scores(matrix):
    scored = models.gbt_holdout(matrix, positive=1.1, maxIter=3, maxDepth=2)
    assert scored.columns == ["game_id", "winner", "score"]
    assert scored.where("score < 0 or score > 1").count() == 0
    ranked = scored.withColumnRenamed("winner", "label")
    exact = scoring.auc(ranked).first().auc
    assert exact > 0.9
    evaluator = BinaryClassificationEvaluator(
        labelCol="label", rawPredictionCol="score", numBins=0
    )
    assert evaluator.evaluate(ranked) == pytest.approx(exact)


def test_importance_and_curve(matrix):
    top = models.feature_importance(matrix, k=1, maxIter=2, maxDepth=2).collect()
    assert [r.feature for r in top] == ["strong_one"]
    curve = models.learning_curve(matrix, maxIter=3, maxDepth=2).orderBy("round").collect()
    assert [r.round for r in curve] == [1, 2, 3] and curve[-1].loss < curve[0].loss
    model, rows = models.gbt_early_stopped(matrix, maxIter=5, maxDepth=2)
    assert 1 <= model.getNumTrees <= 5 and rows.count() == 240


def test_curve_over_folds_is_that_of_the_models(matrix):
    """Every (fold, round) has the AUC of a plain fit with so many rounds."""
    got = {(r.fold, r.round): r.auc for r in models.cv_learning_curve(matrix, 3, maxIter=4, maxDepth=2).collect()}
    assert sorted(got) == [(f, n) for f in range(3) for n in range(1, 5)]
    rows = models.fold_rows(matrix, 3)
    for fold, rounds in [(0, 1), (1, 4), (2, 3)]:
        model = models.gbt(maxIter=rounds, maxDepth=2).fit(rows.where(F.col("fold") != fold))
        scored = model.transform(rows.where(F.col("fold") == fold)).select(
            F.col("winner").alias("label"), models.vector_to_array("rawPrediction")[1].alias("score")
        )
        assert got[fold, rounds] == pytest.approx(scoring.auc(scored).first().auc, abs=1e-12)


def test_halving(matrix):
    small = models.BOUNDS | {"iterations": (3, 9), "leaves": (2, 9)}
    got = models.halving_search(matrix, trials=4, folds=3, bounds=small, first=2, eta=2).orderBy("trial").collect()
    assert sorted(r.rungs for r in got) == [1, 1, 2, 2]
    kept = [r for r in got if r.rungs == 2]
    assert min(r.auc for r in kept) > 0.5
    drawn = models.sample_parameters(4, small)
    for r, d in zip(got, drawn):
        assert r.rounds == min(2**r.rungs, int(d["iterations"]))
        assert [r[n] for n in small] == [d[n] for n in small]
    # the last AUC is a plain cross-validated fit's, and losers were no better in their rung
    rows = models.fold_rows(matrix, 3)
    for r, d in zip(got, drawn):
        params = models.tree_parameters(d) | {"maxIter": r.rounds}
        aucs = []
        for k in range(3):
            model = models.gbt(**params).fit(rows.where(F.col("fold") != k))
            held = model.transform(rows.where(F.col("fold") == k))
            aucs.append(BinaryClassificationEvaluator(labelCol="winner", numBins=0).evaluate(held))
        assert r.auc == pytest.approx(sum(aucs) / 3, abs=1e-9)


def test_every_trial_has_all_its_rounds(matrix):
    """Without ``first`` a trial's AUC is a plain fit's with the rounds it drew, also if it lost."""
    small = models.BOUNDS | {"iterations": (6, 14), "leaves": (2, 9)}
    got = models.halving_search(matrix, trials=4, folds=2, bounds=small).orderBy("trial").collect()
    drawn = models.sample_parameters(4, small)
    assert sorted(r.rungs for r in got) == [1, 1, 2, 2]
    assert [r.rounds for r in got] == [int(d["iterations"]) for d in drawn]
    assert min(r.auc for r in got if r.rungs == 2) >= max(r.auc for r in got if r.rungs == 1)
    rows = models.fold_rows(matrix, 2)
    assert rows.sparkSession.sparkContext.getCheckpointDir()
    for r, d in zip(got, drawn):
        aucs = []
        for k in range(2):
            model = models.gbt(**models.tree_parameters(d)).fit(rows.where(F.col("fold") != k))
            held = model.transform(rows.where(F.col("fold") == k))
            aucs.append(BinaryClassificationEvaluator(labelCol="winner", numBins=0).evaluate(held))
        assert r.auc == pytest.approx(sum(aucs) / 2, abs=1e-9)


def test_registered_search_asks_for_all_rounds(spark, matrix, monkeypatch):
    """Each of its fits is asked for the rounds its trial drew; one is fitted here."""
    asked, gbt = [], models.gbt
    monkeypatch.setattr(models, "gbt", lambda seed, **p: asked.append(p["maxIter"]) or gbt(seed, **p | {"maxIter": 1, "maxDepth": 1}))
    monkeypatch.setattr(queries, "_matrix", lambda spark, folder: matrix)
    got = queries.cv_search(spark, "").orderBy("trial").collect()
    rounds = [int(d["iterations"]) for d in models.sample_parameters(6)]
    assert [r.rounds for r in got] == rounds and sorted(asked) == sorted(5 * rounds)


def test_fits_side_by_side_share_the_cores(spark, monkeypatch):
    """Rows of a fit lie in as many partitions as it has cores, or as their number needs."""
    noise = [F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(9973)) / 9973.0 for k in range(12)]
    games = spark.range(300_000).select(
        F.col("id").cast("int").alias("game_id"),
        F.pmod("id", F.lit(2)).cast("int").alias("winner"),
        *[n.alias(f"f{k}") for k, n in enumerate(noise)],
    )
    assert spark.sparkContext.defaultParallelism == 8
    assert models.fold_rows(games, 3).rdd.getNumPartitions() == 2  # 300,000 rows
    assert models.fold_rows(games, 3, parallelism=2).rdd.getNumPartitions() == 4
    monkeypatch.setattr(models, "FIT_ROWS", 60_000)
    rows = models.fold_rows(games, 3)
    assert rows.rdd.getNumPartitions() == 5 and rows.select("game_id").distinct().count() == 300_000


def test_depths(matrix):
    got = models.depth_sweep(matrix, [1, 3], trees=3).collect()
    assert [r.depth for r in got] == [1, 3] and all(0.5 < r.accuracy <= 1 for r in got)


def test_one_forest_gives_all_depths(spark, monkeypatch):
    """One forest is fitted, and each depth has the accuracy of a forest fitted with it."""
    noise = [F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(50)) / 50.0 for k in range(6)]
    games = spark.range(600).select(
        F.col("id").cast("int").alias("game_id"),
        (noise[0] + noise[1] * noise[2] + noise[5] > 1.2).cast("int").alias("winner"),
        *[noise[k].alias(f"f{k}") for k in range(5)],
    )
    depths, fits, fit = [6, 1, 0, 3, 30, 12, 2], [], models.RandomForestClassifier.fit
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, *a: fits.append(self.getMaxDepth()) or fit(self, *a))
    tables = []  # the order of a table's rows decides what is drawn, so both sides read one
    monkeypatch.setattr(models, "materialize", lambda df: tables.append(materialize(df)) or tables[-1])
    got = models.depth_sweep(games, depths, trees=7).collect()
    assert fits == [30] and [r.depth for r in got] == depths
    rows = tables[0]
    accuracy = MulticlassClassificationEvaluator(labelCol="winner", metricName="accuracy")
    for r in got:
        forest = models.RandomForestClassifier(labelCol="winner", maxDepth=r.depth, numTrees=7, seed=1)
        assert r.accuracy == accuracy.evaluate(forest.fit(rows.where("part = 'train'")).transform(rows.where("part = 'valid'")))
    assert len({r.accuracy for r in got}) > 3


def test_search(matrix):
    small = models.BOUNDS | {"iterations": (2, 3), "leaves": (4, 5)}
    got = models.cv_search(matrix, trials=2, folds=2, bounds=small).collect()
    assert [r.trial for r in got] == [0, 1] and all(r.auc > 0.8 for r in got)
    assert models.sample_parameters(3) == models.sample_parameters(3)
    for drawn in models.sample_parameters(50):
        assert all(lo <= drawn[n] <= hi for n, (lo, hi) in models.BOUNDS.items())
    odd = {**models.sample_parameters(1)[0], "feature_fraction": 1.7, "bagging_fraction": 2.0}
    assert models.tree_parameters(odd)["featureSubsetStrategy"] == "all"
    assert models.tree_parameters(odd)["subsamplingRate"] == 1.0


def test_pca_is_centred_and_saved(spark, tmp_path):
    counts = spark.createDataFrame(
        [(i, i % 5, 2 * (i % 5), 7) for i in range(40)], "game_id INT, a INT, b INT, c INT"
    )
    model = models.fit_unit_pca(counts, k=2)
    parts = models.unit_pca(model, counts, k=2)
    mean0, var0, var1 = parts.agg(
        F.avg("unit_pca0"), F.var_samp("unit_pca0"), F.var_samp("unit_pca1")
    ).first()
    assert abs(mean0) < 1e-9 and var0 > 1 and var1 < 1e-9
    sinks.save_model(model, str(tmp_path / "pca"))
    again = models.unit_pca(PipelineModel.load(str(tmp_path / "pca")), counts, k=2)
    assert again.exceptAll(parts).count() == 0


def test_answers_for_every_game(spark, matrix):
    half = matrix.withColumn("winner", F.when(F.col("game_id") < 160, F.col("winner")))
    spine = spark.range(250).select(F.col("id").cast("int").alias("game_id"))
    got = {r.game_id: r.winner for r in models.answers(half, spine, maxIter=5, maxDepth=2).collect()}
    truth = {r.game_id: r.winner for r in matrix.collect()}
    assert len(got) == 250 and all(got[g] == 0.5 for g in range(240, 250))
    assert all(got[g] == truth[g] for g in range(160))
    assert sum((got[g] > 0.5) == truth[g] for g in range(160, 240)) > 70


def test_submission(spark):
    spine = spark.createDataFrame([(1,), (2,)], "game_id INT")
    scored = spark.createDataFrame([(1, 1.2)], "game_id INT, score DOUBLE")
    got = {r.game_id: r.winner for r in models.submission(spine, scored).collect()}
    assert got == {1: 1.0, 2: 0.5}
