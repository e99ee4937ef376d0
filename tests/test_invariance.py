"""Features depend on ``seq`` only: not on block size, partitioning or row order, and a
log fed in ranges of games gives the same rows as the whole."""

import pytest

from matchlog.plans import actions, camera, units
from matchlog.sources import readers, sample
from matchlog.sources.sample import UNITS

FOLDER = "/root/testdata/sf0.001"

FEATURES = {
    "steps": lambda log, b: camera.step_stats(camera.points(log), block_rows=b),
    "home_away": lambda log, b: camera.home_away(camera.points(log), 20, b),
    "attack": lambda log, b: actions.attack_strength(log, UNITS, b),
    "ownership": lambda log, b: units.ownership(log, UNITS, b),
    "drift": lambda log, b: camera.center_drift(camera.points(log)),
    "agility": lambda log, b: actions.agility(log),
}


def rows(df):
    return sorted(
        str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in df.collect()
    )


@pytest.fixture(scope="module")
def log(spark):
    return sample.match_log(spark, FOLDER)


@pytest.mark.parametrize("name", list(FEATURES))
def test_block_size_and_order(log, name):
    feature = FEATURES[name]
    want = rows(feature(log, 10**6))
    assert want == rows(feature(log.repartition(5, "time"), 37))
    assert want == rows(feature(log.orderBy("event", "time"), 200))


@pytest.mark.parametrize("name", list(FEATURES))
def test_ranges_of_games(log, name):
    feature = FEATURES[name]
    parts = [feature(readers.game_range(log, a, b), 100) for a, b in ((0, 6), (7, 10**6))]
    assert rows(parts[0].unionByName(parts[1])) == rows(feature(log, 100))


def test_star_join_adds_no_shuffle_of_its_own(spark, log):
    """Feature tables arrive partitioned by game, so joining them moves nothing."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left, right = actions.agility(log), camera.center_drift(camera.points(log))

        def shuffles(df):
            plan = df._jdf.queryExecution().executedPlan().toString()
            return plan.count("Exchange hashpartitioning")

        joined = left.join(right, "game_id", "left")
        assert shuffles(joined) == shuffles(left) + shuffles(right)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
