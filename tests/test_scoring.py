import random
import re
import statistics

import pytest

from matchlog.plans import scoring


def frame(spark, pairs):
    return spark.createDataFrame(
        [(i, float(s), y) for i, (s, y) in enumerate(pairs)], "game_id INT, score DOUBLE, label INT"
    )


def auc_by_pairs(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


KINDS = ["ties", "fine", "tiny", "same", "perfect", "edges", "signed", "huge", "zeros", "infinite"]


@pytest.mark.parametrize("kind", KINDS)
def test_auc(spark, kind):
    rng = random.Random(5)
    draw = {
        "ties": lambda y: round(rng.random(), 1),
        "fine": lambda y: 0.5 + rng.random() * 1e-9,
        "tiny": lambda y: rng.random() * 1e-14,
        "same": lambda y: 0.25,
        "perfect": lambda y: y * 0.5 + rng.random() * 0.4,
        "edges": lambda y: rng.choice([0.0, 1.0, 0.5]),
        "signed": lambda y: rng.gauss(y, 3),
        "huge": lambda y: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-320, 308),
        "zeros": lambda y: rng.choice([0.0, -0.0, 5e-324, -5e-324]),
        "infinite": lambda y: rng.choice([float("inf"), float("-inf"), 1.7e308, -1.7e308]),
    }[kind]
    pairs = [(draw(y), y) for y in (rng.randint(0, 1) for _ in range(200))]
    row = scoring.auc(frame(spark, pairs)).first()
    assert row.auc == pytest.approx(auc_by_pairs(pairs), abs=1e-12)
    assert row.pos == sum(y for _, y in pairs)


def test_auc_by_group(spark):
    rng = random.Random(6)
    rows = [(g, rng.gauss(0, 1), rng.randint(0, 1)) for g in (1, 2, None) for _ in range(50)]
    df = spark.createDataFrame([*rows, (3, 1.0, 1), (1, None, 1)], "g INT, score DOUBLE, label INT")
    got = {r.g: r.auc for r in scoring.auc(df, by=("g",)).collect()}
    want = {g: auc_by_pairs([(s, y) for k, s, y in rows if k == g]) for g in (1, 2, None)}
    assert got[3] is None and {g: got[g] for g in want} == pytest.approx(want, abs=1e-12)


def test_no_step_of_the_auc_orders_more_than_a_digit(spark):
    shifts = [s for s, _ in scoring._DIGITS] + [64]
    assert all(b - a <= 22 for a, b in zip(sorted(shifts), sorted(shifts)[1:]))
    plan = scoring.auc(frame(spark, [(0.1, 1), (0.2, 0)]))._jdf.queryExecution().optimizedPlan().toString()
    orders = set(re.findall(r"windowspecdefinition\((.*?), specified", plan))
    assert orders and all("_d" in o.split("ASC")[0].split(",")[-1] for o in orders)


def test_fold_curve(spark):
    rng = random.Random(8)
    rows = [(i % 3, rng.randint(0, 1), [rng.gauss(0, 1) for _ in range(6)]) for i in range(90)]
    df = spark.createDataFrame(rows, "fold INT, label INT, steps ARRAY<DOUBLE>")
    got = {(r.fold, r.round): r.auc for r in scoring.fold_curve(df).collect()}
    want = {
        (f, n): auc_by_pairs([(sum(s[:n]), y) for k, y, s in rows if k == f])
        for f in range(3)
        for n in range(1, 7)
    }
    assert got == pytest.approx(want, abs=1e-12)
    curve = scoring.curve_summary(scoring.fold_curve(df)).collect()
    for r in curve:
        values = [want[f, r.round] for f in range(3)]
        assert r.folds == 3 and r.mean_auc == pytest.approx(statistics.mean(values))
        assert r.std_auc == pytest.approx(statistics.stdev(values))
    best = max(curve, key=lambda r: (r.mean_auc, -r.round))
    assert [r.round for r in curve if r.is_best] == [best.round]


def test_auc_of_one_class_is_null(spark):
    assert scoring.auc(frame(spark, [(0.1, 1), (0.2, 1)])).first().auc is None


@pytest.mark.parametrize("n, folds", [(10, 5), (13, 5), (3, 5), (101, 7)])
def test_contiguous_folds(spark, n, folds):
    ids = sorted(random.Random(n).sample(range(1000), n))
    got = scoring.contiguous_folds(
        spark.createDataFrame([(i,) for i in ids], "game_id INT"), folds
    ).orderBy("game_id")
    sizes = [n // folds + (f < n % folds) for f in range(folds)]
    assert [r.fold for r in got.collect()] == [f for f, k in enumerate(sizes) for _ in range(k)]


def test_stable_split_shares(spark):
    games = spark.range(5000).withColumnRenamed("id", "game_id")
    parts = {r.part: r["count"] for r in scoring.stable_split(games).groupBy("part").count().collect()}
    assert abs(parts["test"] - 1000) < 120 and abs(parts["valid"] - 1600) < 150
    again = scoring.stable_split(games.repartition(7))
    assert again.exceptAll(scoring.stable_split(games)).count() == 0


def test_accuracy_and_errors(spark):
    scored = frame(spark, [(0.9, 1), (0.6, 0), (0.2, 0), (0.1, 1)])
    row = scoring.accuracy_f1(scored).first()
    assert (row.n, row.accuracy, row.f1) == (4, 0.5, 0.5)
    wrong = scoring.wrong_games(scored)
    assert {r.game_id for r in wrong.collect()} == {1, 3}
    games = spark.createDataFrame([(0, "a"), (1, "a"), (3, "b"), (2, "b")], "game_id INT, m STRING")
    found = scoring.error_frequency(games, wrong, "m").collect()
    assert [tuple(r) for r in found] == [("a", 1), ("b", 1)]


def test_histogram(spark):
    scored = frame(spark, [(0.0, 1), (0.05, 1), (0.95, 0), (1.0, 0), (0.5, 1)])
    got = {r.bin: r.n for r in scoring.histogram(scored).collect()}
    assert got == {0: 2, 5: 1, 9: 2}
    flat = scoring.histogram(frame(spark, [(0.3, 1), (0.3, 0)])).collect()
    assert [tuple(r) for r in flat] == [(0, 2)]


def test_best_round(spark):
    series = spark.createDataFrame([(1, 0.2), (2, 0.7), (3, 0.7), (4, 0.2)], "r INT, m DOUBLE")
    assert tuple(scoring.best_round(series, "r", "m").first()) == (2, 0.7, 1, 0.2)
