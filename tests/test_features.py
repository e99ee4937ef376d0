import math

import pytest
from pyspark.sql import functions as F

from matchlog.plans import ability, actions, assemble, camera, explore
from matchlog.sources.sample import UNITS

BLOCKS = [1, 3, 10**6]


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- camera ---


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_steps(make_log, block_rows):
    log = make_log(
        [
            (0, 0, 0.0, "Camera", "at (0, 0)"),
            (0, 0, 0.5, "Selection", "Marine [A]"),
            (0, 0, 0.6, "Camera", "at (3, 4)"),
            (0, 0, 2.0, "Right Click", "Location: (3, 10, 1)"),
            (0, 0, 2.1, "Camera", "nowhere"),
            (0, 0, 11.0, "Camera", "at (99, 99)"),
            (0, 1, 0.0, "Camera", "at (5, 5)"),
            (0, 1, 1.0, "Camera", "at (5, 6)"),
            (1, 0, 0.0, "Camera", "at (5, 5)"),
        ]
    )
    row = one(camera.step_stats(camera.points(log), block_rows=block_rows))
    assert row.game_id == 0
    assert row.p0_moving_mean == 5.5
    assert math.isclose(row.p0_moving_std, math.sqrt(0.5))
    assert (row.p1_moving_mean, row.p1_moving_std) == (1.0, None)
    assert (row.cam_moving_p0_mean0, row.cam_moving_p0_std0) == (5.0, None)
    assert (row.cam_moving_p0_mean2, row.cam_moving_p0_mean1) == (6.0, None)


def test_center_drift_needs_both_players(make_log):
    log = make_log(
        [
            (0, 0, 0.1, "Camera", "at (10, 10)"),
            (0, 0, 1.1, "Camera", "at (13, 14)"),
            (0, 0, 1.2, "Camera", "at (13, 14)"),
            (0, 1, 3.0, "Camera", "at (1, 1)"),
            (1, 0, 0.0, "Camera", "at (1, 1)"),
        ]
    )
    row = one(camera.center_drift(camera.points(log)))
    assert (row.p0_center_0, row.p0_center_1, row.p0_center_2, row.p1_center_3) == (0, 5, 0, 0)


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_home_away(make_log, block_rows):
    at = {"home0": "at (0, 0)", "home1": "at (100, 0)"}
    log = make_log(
        [
            (0, 0, 0, "Camera", at["home0"]),
            (0, 1, 0, "Camera", at["home1"]),
            (0, 0, 1, "Camera", at["home1"]),
            (0, 0, 2, "Camera", at["home1"]),
            (0, 1, 3, "Camera", at["home1"]),
            (1, 0, 0, "Camera", at["home0"]),  # nobody ever leaves home
            (1, 1, 0, "Camera", at["home1"]),
            (2, 0, 0, "Camera", at["home0"]),  # no second player
            (2, 0, 1, "Camera", at["home1"]),
        ]
    )
    row = one(camera.home_away(camera.points(log), last_rows=2, block_rows=block_rows))
    assert row.game_id == 0
    assert math.isclose(row.cam_remote_ratio0, 2 / 3) and row.cam_remote_ratio1 == 0
    assert (row.cam_remote_ratio0_last, row.cam_remote_ratio1_last) == (1.0, 0.0)
    # named for one player, counted for the other
    assert (row.camera_home_p1, row.camera_enemy_to_p1, row.homeaway_p1) == (1.0, 2.0, 2.0)
    assert (row.camera_home_p0, row.camera_enemy_to_p0, row.homeaway_p0) == (2.0, 0.0, 0.0)


# --- actions ---


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_attack_strength(make_log, block_rows):
    attack = "(1) - Attack; Location: (1.0, 2.0, 3)"
    log = make_log(
        [
            (0, 0, 1, "Ability", attack),  # nothing selected yet
            (0, 0, 2, "Selection", "Marine [A], Marine [B], Rock [C]"),
            (0, 0, 3, "Camera", "at (1, 1)"),
            (0, 0, 4, "Selection", "SCV [D]"),  # workers only: not kept
            (0, 0, 5, "Ability", attack),  # worth two marines
            (0, 0, 6, "Ability", attack),  # follows an attack: nothing
            (0, 0, 7, "Selection", "SiegeTank [E]"),
            (0, 0, 7, "Ability", "(1) - Stop"),
            (0, 1, 8, "Ability", attack),  # the other player selected nothing
            (0, 0, 9, "Ability", attack),
            (0, 0, 12, "Selection", "Marine [A]"),
            (0, 0, 12.5, "Ability", attack),  # too late
            (1, 0, 1, "Ability", attack),
        ]
    )
    row = one(actions.attack_strength(log, UNITS, block_rows))
    assert row.asDict() == {
        "game_id": 0,
        "p0_attack_units": 5.0,
        "p1_attack_units": 0.0,
        **{
            f"attack_units_p{p}_s{s}": {(0, 5): 2.0, (0, 9): 3.0}.get((p, s), 0.0)
            for p in (0, 1)
            for s in range(5, 12)
        },
    }


def test_agility(make_log):
    log = make_log(
        [
            (0, 0, 0.2, "Ability", "(1) - Stop"),
            (0, 0, 0.9, "Right Click", "x"),
            (0, 0, 0.9, "Camera", "at (1, 1)"),
            (0, 0, 10.1, "Ability", "(1) - Stop"),
            (0, 1, 9.9, "Ability", "(1) - Stop"),
            (1, 1, 1.0, "Ability", "(1) - Stop"),
        ]
    )
    row = one(actions.agility_totals(actions.agility(log)))
    assert (row.game_id, row.p0_actions_0, row.p0_actions, row.p1_actions_9) == (0, 2, 2, 1)


def test_event_counts_and_labels(make_log):
    log = make_log([(0, 0, 0, "Camera", "x"), (0, 0, 1, "Camera", "x"), (0, 1, 1, "Ability", "x")])
    row = one(actions.event_counts(log))
    assert (row["0_Camera"], row["1_Ability"], row["1_Right Click"]) == (2, 1, 0)
    assert tuple(one(actions.species_labels(log))) == (0, "T", "P", 1)
    row = one(actions.baseline_set(log))
    assert (row.species0_T, row.species1_P, row.species1_Z, row["0_Camera"]) == (1, 1, 0, 2)


# --- ability ---


def ability_log(make_log):
    return make_log(
        [
            (0, 0, 1.0, "Ability", "(1) - TrainMarine"),
            (0, 0, 2.0, "Ability", "(1) - TrainMarine"),
            (0, 0, 3.0, "Ability", "(1) - EvolveThing"),
            (0, 0, 4.0, "Ability", "(1) - ResearchUpgrade"),
            (0, 0, 4.0, "Ability", "(1) - Attack; Location: (1.0, 2.0, 3)"),
            (0, 0, 99.0, "Camera", "at (1, 1)"),
            (0, 1, 6.5, "Ability", "(1) - WarpInZealot"),
            (0, 1, 6.0, "Ability", "(1) - TrainMarine"),  # not a unit of this species
            (1, 0, 1.0, "Ability", "(1) - TrainMarine"),  # one player only
        ]
    )


def test_game_rows(make_log, spark):
    maps = spark.createDataFrame([(0, 3)], "game_id INT, map INT")
    row = one(ability.game_rows(ability_log(make_log), UNITS.frame(spark), maps))
    assert (row.game_id, row.winner, row.duration) == (0, 1, 5.5)
    assert (row.train_sum_0, row.upgrade_sum_0, row.attack_sum_0, row.build_sum_0) == (2, 2, 1, 0)
    assert (row.supply_0, row.minerals_0, row.gas_0) == (2.0, 100.0, 0.0)
    assert (row.train_sum_1, row.supply_1, row.minerals_1) == (2, 2.0, 100.0)
    assert [row[f"map_{m}"] for m in range(7)] == [0, 0, 0, 1, 0, 0, 0]
    assert (row.species0_T, row.species0_P, row.species1_P) == (1, 0, 1)


def test_evolve_word_is_a_parameter(make_log):
    summary = ability.ability_summary(ability_log(make_log), evolve_word="Evolve")
    assert summary.where("game_id = 0 and player = 0").first().upgrade_sum == 3


def test_a_missing_winner_still_matches(make_log, spark):
    log = ability_log(make_log).drop("winner").selectExpr("*", "CAST(NULL AS INT) AS winner")
    maps = spark.createDataFrame([], "game_id INT, map INT")
    row = one(ability.game_rows(log, UNITS.frame(spark), maps))
    assert row.winner is None and row.map_0 == 0


def test_a_player_with_two_species_gives_two_rows(make_log, spark):
    log = ability_log(make_log)
    other = log.where("game_id = 0 and player = 1 and time = 6.0").selectExpr(
        "game_id", "winner", "time", "player", "'Z' AS species", "event", "event_contents", "seq"
    )
    maps = spark.createDataFrame([], "game_id INT, map INT")
    rows = ability.flatten_players(
        ability.player_rows(log.unionByName(other), UNITS.frame(spark)), maps
    ).collect()
    assert sorted(r.species_1 for r in rows) == ["P", "Z"]
    # costs are the player's, not the row's
    assert {r.supply_1 for r in rows} == {2.0}


# --- assembly ---


def test_final_matrix(make_log, spark):
    log = ability_log(make_log)
    maps = spark.createDataFrame([(0, 3)], "game_id INT, map INT")
    tables = assemble.feature_tables(log, UNITS, maps)
    tables["unit_counts"] = spark.createDataFrame(
        [(0, 1), (1, 0), (2, 0)], "game_id INT, p0_Marine INT"
    )
    extra = spark.createDataFrame([(0, 5.0)], "game_id INT, near DOUBLE")
    full = assemble.final_matrix(tables, UNITS, (extra,), labeled=False)
    assert full.count() == 3
    train = assemble.final_matrix(tables, UNITS, (extra,))
    # the label comes from the log: a game that one player has abilities in keeps its own
    assert sorted((r.game_id, r.winner) for r in train.collect()) == [(0, 1), (1, 1)]
    row = one(train.where("game_id = 0"))
    assert (row.game_id, row.winner, row.near, row.p0_moving_mean) == (0, 1, 5.0, 0.0)
    assert not [c for c in train.columns if "center" in c or "Marine" in c or "_s5" in c]
    assert len(assemble.minute_columns()) == 94
    assert "winner" not in assemble.feature_columns(train)


def test_final_matrix_of_games_without_selection(make_log, spark):
    played = [(g, p, float(p + 1), "Ability", "(1) - TrainMarine") for g in (-3, 0, 5) for p in (0, 1)]
    log = make_log([(0, 0, 0.5, "Selection", ""), *played, (7, 0, 0.1, "Camera", "at (1, 1)")])
    maps = spark.createDataFrame([], "game_id INT, map INT")
    tables = assemble.feature_tables(log, UNITS, maps)
    train = assemble.final_matrix(tables, UNITS).collect()
    assert sorted((r.game_id, r.winner, r.train_sum_0, r.train_sum_1) for r in train) == [*[(g, 1, 1, 1) for g in (-3, 0, 5)], (7, 1, 0, 0)]
    full = assemble.final_matrix(tables, UNITS, labeled=False).collect()
    assert sorted(r.game_id for r in full) == [-3, 0, 5, 7]


def test_matrix_keeps_labelled_games_without_abilities_of_both(make_log, spark):
    """A label comes from the log, so a game without any ability stays, features at 0."""
    rows = [(0, p, 1.0, "Ability", "(1) - TrainMarine") for p in (0, 1)]
    rows += [(1, 0, 1.0, "Ability", "(1) - TrainMarine"), (2, 0, 0.1, "Camera", "at (1, 1)")]
    maps = spark.createDataFrame([(2, 1)], "game_id INT, map INT")
    train = assemble.final_matrix(assemble.feature_tables(make_log(rows), UNITS, maps), UNITS)
    assert sorted((r.game_id, r.winner, r.train_sum_0) for r in train.collect()) == [(0, 1, 1), (1, 1, 0), (2, 1, 0)]
    unlabelled = make_log(rows, winner=None)
    tables = assemble.feature_tables(unlabelled, UNITS, maps)
    assert assemble.final_matrix(tables, UNITS).count() == 0
    assert assemble.final_matrix(tables, UNITS, labeled=False).count() == 3


def test_matrix_with_fifteen_maps(make_log, spark):
    log = make_log([(g, p, 1.0, "Ability", "(1) - TrainMarine") for g in range(15) for p in (0, 1)])
    maps = spark.createDataFrame([(g, g) for g in range(15)], "game_id INT, map INT")
    tables = assemble.feature_tables(log, UNITS, maps, map_count=15)
    for r in assemble.final_matrix(tables, UNITS).collect():
        assert [r[f"map_{i}"] for i in range(15)] == [int(i == r.game_id) for i in range(15)]
    with pytest.raises(Exception, match="no column for map"):
        assemble.final_matrix(assemble.feature_tables(log, UNITS, maps), UNITS).collect()


def test_sides_of_several_species_and_null_winners(make_log, spark):
    log = make_log([(0, p, 1.0, "Ability", "(1) - TrainMarine") for p in (0, 1)], winner=None)
    twice = log.unionByName(log.where("player = 1").withColumn("species", F.lit("Z")))
    rows = ability.player_rows(twice, UNITS.frame(spark))
    got = ability.flatten_players(rows, spark.createDataFrame([], "game_id INT, map INT")).collect()
    assert sorted((r.winner, r.species_0, r.species_1) for r in got) == [(None, "T", "P"), (None, "T", "Z")]


def test_near_ratios(spark):
    near = spark.createDataFrame(
        [(0, 3, 1, 0, 0)],
        "game_id INT, player0_near0 INT, player0_near1 INT, player1_near0 INT, player1_near1 INT",
    )
    row = one(assemble.near_ratios(near))
    assert math.isclose(row.player0_ratio, 0.75, rel_tol=1e-6) and row.player1_ratio == 0


# --- exploration ---


def test_starts(make_log):
    log = make_log(
        [
            (0, 0, 0.0, "Camera", "at (1, 1)"),
            (1, 0, 0.11, "Camera", "at (1, 1)"),
            (1, 0, 0.0, "Ability", "(1) - Lair"),
            (2, 0, 0.11, "Camera", "at (1, 1)"),
        ]
    )
    counts = explore.start_time_frequency(log).collect()
    assert [tuple(r) for r in counts] == [(0.0, 2), (0.11, 1)]
    assert explore.rows_at_start(log).count() == 1
    assert one(explore.games_starting_between(log, 0.11, 0.11)).game_id == 2
    assert [r.event for r in explore.game_timeline(log, 1).collect()] == ["Ability", "Camera"]
    assert one(explore.search_text(log, "Lair")).game_id == 1
    assert one(explore.late_starts(log)).game_id == 1
    assert explore.schema_rows(log).count() == 8
