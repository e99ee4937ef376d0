import random

import pytest

from matchlog.plans import maps
from matchlog.session import materialize


def impute_by_steps(games, table):
    """The four updates per map, one after the other."""
    for m0, m1, m2 in table:
        for unknown, known, member, other in (
            (0, 1, m0, m1), (0, 1, m1, m0), (1, 0, m0, m1), (1, 0, m1, m0),
        ):
            for g in games.values():
                if g[unknown] == 0 and g[known] in (member, m2):
                    g[unknown] = other
    found = {}
    for number, triple in enumerate(table):
        for game, g in games.items():
            if g[0] in triple:
                found[game] = number
    return found


@pytest.mark.parametrize("seed", range(6))
def test_imputation_and_map_numbers(spark, seed):
    rng = random.Random(seed)
    table = sorted(
        {tuple(sorted((rng.randint(0, 6), rng.randint(1, 6), rng.choice([999, 3, 5]))))
         for _ in range(5)}
    )
    games = {i: [rng.choice([0, 0, 1, 2, 3, 4, 5, 6]), rng.randint(0, 6)] for i in range(60)}
    df = spark.createDataFrame(
        [(i, *g) for i, g in games.items()],
        "game_id INT, player0_starting INT, player1_starting INT",
    )
    maps_df = spark.createDataFrame(
        [(i, *t) for i, t in enumerate(table)], "map INT, m0 INT, m1 INT, m2 INT"
    )
    numbers = impute_by_steps(games, table)
    got = maps.resolve_games(df, maps_df).collect()
    assert {r.game_id: (r.player0_starting, r.player1_starting, r.map) for r in got} == {
        i: (g[0], g[1], numbers.get(i)) for i, g in games.items()
    }


def test_no_maps_leave_games_as_they_are(spark):
    df = spark.createDataFrame(
        [(1, 0, 2)], "game_id INT, player0_starting INT, player1_starting INT"
    )
    none = spark.createDataFrame([], "map INT, m0 INT, m1 INT, m2 INT")
    got = maps.resolve_games(df, none).collect()
    assert [tuple(r) for r in got] == [(1, 0, 2, None)]


def test_map_table(spark):
    pairs = [(1, 2)] * 5 + [(2, 1)] * 4 + [(3, 4)] * 5 + [(3, 5)] * 3 + [(4, 3)] * 5 + [(4, 5)] * 3
    df = spark.createDataFrame(
        [(i, *p) for i, p in enumerate(pairs)],
        "game_id INT, player0_starting INT, player1_starting INT",
    )
    got = [tuple(r) for r in maps.map_table(df, support=3).orderBy("map").collect()]
    assert got == [(0, 1, 2, 999), (1, 3, 4, 5)]


def test_positions_to_maps(make_log):
    starts = {0: (10, 10), 1: (90, 90)}
    rows = []
    for game in range(4):
        for player in (0, 1):
            x, y = starts[player]
            rows.append((game, player, 0, "Ability", "(1) - Stop"))
            rows.append((game, player, 1, "Camera", f"at ({x + game % 2}.0, {y}.0)"))
            rows.append((game, player, 2, "Camera", "at (50, 50)"))
    rows.append((4, 0, 0, "Camera", "at (50.0, 50.0)"))  # outside the radius
    rows.append((4, 1, 0, "Camera", "at (90.0, 90.0)"))
    rows.append((5, 0, 0, "Ability", "(1) - Stop"))  # no camera at all
    log = make_log(rows)
    got = {
        r.game_id: (r.player0_starting, r.player1_starting, r.map)
        for r in maps.map_data(log, [(10.0, 10.0), (90.0, 90.0)], 5.0, 2).collect()
    }
    assert got == {**{g: (1, 2, 0) for g in range(4)}, 4: (1, 2, 0), 5: (0, 0, None)}

    points = materialize(maps.start_points(maps.start_positions(log)))
    _, centres = maps.fit_centres(points.where("game_id < 4"), k=2)
    assert [(round(x), round(y)) for x, y in centres] == [(10, 10), (90, 90)]
    assigned = maps.assign_starts(points, centres).collect()
    assert {r.starting for r in assigned} == {0, 1, 2}
    same = maps.fitted_map_data(log.where("game_id < 4"), k=2, support=2).collect()
    assert {(r.player0_starting, r.player1_starting, r.map) for r in same} == {(1, 2, 0)}
