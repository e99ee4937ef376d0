"""The query registry: every operator and feature over one data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlog.functions import scalar, text
from matchlog.operators import shaping
from matchlog.plans import (
    ability,
    actions,
    assemble,
    camera,
    explore,
    maps,
    models,
    scoring,
    units,
)
from matchlog.session import materialize, shared_folder
from matchlog.sources import readers, sinks
from matchlog.sources.sample import CENTRES, UNITS, match_log, with_targets
from matchlog.sources.schema import PLAYERS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The sample log has a few dozen rows per game and spread-out starts.
LAST_ROWS = 20
TOP = units.TOP_NAMES
RARE_AFTER = 5  # it names fewer than a hundred units
RADIUS = 25.0
SUPPORT = 3
TRAIN_GAMES = 100
TREES = {"maxIter": 20, "maxDepth": 5}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame) -> DataFrame:
    """Floating-point columns at six decimals, so that results can be compared."""
    return df.selectExpr(
        *[f"round(`{c}`, 6) AS `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes]
    )


# --- scans, parsers ---


@query
def scan_event_partition(spark, sf_dir):
    log = match_log(spark, sf_dir, "Ability")
    return rounded(log.select("seq", "game_id", "player", "species", "time", "event_contents"))


@query
def union_train_test(spark, sf_dir):
    log = match_log(spark, sf_dir)
    train = log.where(F.col("game_id") < TRAIN_GAMES)
    test = log.where(F.col("game_id") >= TRAIN_GAMES).drop("winner")
    both = readers.union_logs(train, test)
    return rounded(both.select("seq", "game_id", "player", "species", "event", "time"))


@query
def limit_scan(spark, sf_dir):
    log = readers.first_rows(match_log(spark, sf_dir), 100)
    return log.select("seq", "game_id", "player", "event")


@query
def parse_coordinates(spark, sf_dir):
    return explore.parsed_coordinates(match_log(spark, sf_dir, "Camera", "Right Click", "Ability"))


@query
def parse_targets(spark, sf_dir):
    """Coordinates and targets of a log whose clicks name units."""
    log = with_targets(match_log(spark, sf_dir, "Right Click"))
    return explore.parsed_coordinates(log).where(F.col("target").isNotNull())


@query
def parse_ability(spark, sf_dir):
    return explore.parsed_abilities(match_log(spark, sf_dir, "Ability"))


@query
def ability_names(spark, sf_dir):
    return explore.ability_names(match_log(spark, sf_dir, "Ability"))


@query
def parse_units_produced(spark, sf_dir):
    priced = ability.produced_with_cost(match_log(spark, sf_dir, "Ability"), UNITS.frame(spark))
    return priced.select("seq", "species", "unit", "supply", "minerals", "gas")


@query
def parse_selection_units(spark, sf_dir):
    found = units.selection_mentions(match_log(spark, sf_dir, "Selection"))
    named = found.withColumn("unit", text.unit_stance_removed(F.col("name")))
    return named.where(~text.is_worker(F.col("unit"))).select(
        "seq", "pos", "game_id", "player", "unit_id", "unit"
    )


# --- tables written and read back ---


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/matchlog-{uuid.uuid4().hex}"


@query
def ingested_csv(spark, sf_dir):
    """The log as CSV in several files, ingested by event type, two types read back pruned:
    positions are those in the source."""
    log, folder = match_log(spark, sf_dir), _folder(spark)
    log.repartitionByRange("seq").sortWithinPartitions("seq").drop("seq").write.csv(f"{folder}/csv", header=True)
    sinks.ingest_csv(spark, f"{folder}/csv", f"{folder}/log")
    some = readers.read_ingested(spark, f"{folder}/log", "Camera", "Ability")
    return some.select("seq", "game_id", "winner", "player", "species", "event", "event_contents")


@query
def event_table_drift(spark, sf_dir):
    """Camera drift from a log table by event type, of which only two types are read."""
    folder = _folder(spark)
    sinks.write_by_event(match_log(spark, sf_dir), folder)
    log = readers.read_log(spark, folder, "Camera", "Right Click")
    return rounded(camera.center_drift(camera.points(log)))


@query
def rewritten_chunk(spark, sf_dir):
    """Actions by chunks of 100 games, first of abilities only; the second chunk is then
    written again from the whole log and replaces itself."""
    log, folder = match_log(spark, sf_dir), _folder(spark)
    stale = actions.agility(log.where(F.col("event") == "Ability"))
    sinks.write_by_game_chunk(stale, folder, 100)
    sinks.write_by_game_chunk(actions.agility(readers.game_range(log, 100, 199)), folder, 100)
    return readers.load_chunks(spark, folder)


@query
def saved_feature_matrix(spark, sf_dir):
    """The final matrix from feature tables that were saved bucketed and loaded by name."""
    folder = _folder(spark)
    sinks.save_features(_tables(spark, sf_dir), folder, buckets=8)
    loaded = readers.load_features(spark, folder)
    return rounded(scalar.plain_names(assemble.final_matrix(loaded, UNITS)))


@query
def exported_locations(spark, sf_dir):
    """The parsed ability locations written as CSV and read back, with their frequency."""
    folder = _folder(spark)
    parsed = explore.parsed_abilities(match_log(spark, sf_dir, "Ability"))
    sinks.export_column(parsed, "location", folder)
    return explore.value_counts(spark.read.csv(folder, header=True), "location")


@query
def overwritten_table(spark, sf_dir):
    """A CSV feature table written twice: what is read back is the second one."""
    folder, log = _folder(spark), match_log(spark, sf_dir, "Ability")
    sinks.write_table(ability.game_duration(log.where(F.col("game_id") < 50)), folder, "csv")
    sinks.write_table(ability.game_duration(log), folder, "csv")
    return rounded(spark.read.schema("game_id INT, duration DOUBLE").csv(folder, header=True))


@query
def kept_ownership(spark, sf_dir):
    """Unit ownership kept as a relation, read back and counted by name."""
    owned = units.ownership(match_log(spark, sf_dir, "Selection"), UNITS)
    kept = sinks.save_relation(owned, _folder(spark))
    return kept.groupBy("player", "unit").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("game_id").alias("games"))


# --- ability features ---


@query
def game_duration(spark, sf_dir):
    return rounded(ability.game_duration(match_log(spark, sf_dir, "Ability")))


@query
def ability_summary(spark, sf_dir):
    return rounded(ability.ability_summary(match_log(spark, sf_dir, "Ability")))


@query
def production_cost(spark, sf_dir):
    return rounded(ability.production_cost(match_log(spark, sf_dir, "Ability"), UNITS.frame(spark)))


def _map_data(spark, sf_dir):
    return maps.map_data(match_log(spark, sf_dir), list(CENTRES), RADIUS, SUPPORT)


def _games(spark, sf_dir):
    rows = ability.player_rows(match_log(spark, sf_dir), UNITS.frame(spark))
    return ability.flatten_players(rows, _map_data(spark, sf_dir))


@query
def player_flatten(spark, sf_dir):
    return rounded(ability.with_species_flags(_games(spark, sf_dir)))


@query
def ratio_features(spark, sf_dir):
    return rounded(assemble.ratio_features(_games(spark, sf_dir)))


@query
def species_label_encode(spark, sf_dir):
    coded = explore.with_matchup(_games(spark, sf_dir))
    return coded.select("game_id", *[F.col(f"code_{p}").alias(f"species_{p}") for p in PLAYERS])


@query
def matchup_mix(spark, sf_dir):
    return explore.matchup_frequency(_games(spark, sf_dir))


@query
def matchup_segment(spark, sf_dir):
    return explore.segment(_games(spark, sf_dir), "12").select("game_id", "winner", "species_mix")


# --- action and camera features ---


def _moves(spark, sf_dir):
    return camera.points(match_log(spark, sf_dir, "Camera", "Right Click"))


@query
def action_agility(spark, sf_dir):
    return actions.agility_totals(actions.agility(match_log(spark, sf_dir, "Ability", "Right Click")))


@query
def camera_center_drift(spark, sf_dir):
    return rounded(camera.center_drift(_moves(spark, sf_dir)))


@query
def camera_step_stats(spark, sf_dir):
    return rounded(camera.step_stats(_moves(spark, sf_dir)))


@query
def camera_home_away(spark, sf_dir):
    return rounded(camera.home_away(_moves(spark, sf_dir), LAST_ROWS))


@query
def last_minutes_pressure(spark, sf_dir):
    return camera.last_minutes_pressure(_moves(spark, sf_dir))


@query
def aggressive_per_minute(spark, sf_dir):
    return camera.aggressive_per_minute(_moves(spark, sf_dir))


@query
def attack_strength(spark, sf_dir):
    return rounded(actions.attack_strength(match_log(spark, sf_dir, "Selection", "Ability"), UNITS))


@query
def player_event_counts(spark, sf_dir):
    return scalar.plain_names(actions.event_counts(match_log(spark, sf_dir)))


@query
def species_labels(spark, sf_dir):
    return actions.species_labels(match_log(spark, sf_dir))


@query
def baseline_set(spark, sf_dir):
    return scalar.plain_names(actions.baseline_set(match_log(spark, sf_dir)))


# --- units ---


@query
def unit_ownership(spark, sf_dir):
    return units.ownership(match_log(spark, sf_dir, "Selection"), UNITS)


@query
def unit_counts_dense(spark, sf_dir):
    return units.unit_counts_dense(match_log(spark, sf_dir), UNITS)


@query
def native_units(spark, sf_dir):
    """Mentions of each species' own units in the log."""
    native = units.native_units(UNITS, match_log(spark, sf_dir)).select(
        "species", F.explode("units").alias("name")
    )
    said = units.selection_mentions(match_log(spark, sf_dir, "Selection")).groupBy("species", "name").agg(
        F.count(F.lit(1)).alias("mentions")
    )
    return native.join(said, ["species", "name"], "left").fillna(0)


def _accepted(spark, sf_dir):
    """Accepted mentions, kept as a table because names are ranked and then counted."""
    return materialize(units.first_claims(match_log(spark, sf_dir, "Selection")))


@query
def unit_name_frequency(spark, sf_dir):
    return units.name_frequency(units.first_claims(match_log(spark, sf_dir, "Selection")))


@query
def top_unit_slots(spark, sf_dir):
    return units.top_slots(match_log(spark, sf_dir), _accepted(spark, sf_dir), TOP)


@query
def slot_ratios(spark, sf_dir):
    slots = units.top_slots(match_log(spark, sf_dir), _accepted(spark, sf_dir), TOP)
    return rounded(assemble.slot_ratios(slots, TOP))


@query
def rare_units(spark, sf_dir):
    frequency = materialize(units.name_frequency(units.first_claims(match_log(spark, sf_dir, "Selection"))))
    return units.rare_names(frequency, RARE_AFTER)


@query
def neutral_units(spark, sf_dir):
    accepted = _accepted(spark, sf_dir)
    neutral = units.neutral_names(units.name_frequency(accepted))
    left = units.without_neutral(units.holdings(accepted), neutral)
    return left.select("game_id", "player", "unit_id", "name")


@query
def roster_side_by_side(spark, sf_dir):
    log = match_log(spark, sf_dir)
    return units.roster(log, materialize(units.ownership(log, UNITS)))


# --- maps ---


@query
def start_positions(spark, sf_dir):
    return rounded(maps.start_positions(match_log(spark, sf_dir)))


@query
def start_points(spark, sf_dir):
    return rounded(maps.start_points(maps.start_positions(match_log(spark, sf_dir))))


@query
def map_assignment(spark, sf_dir):
    return _map_data(spark, sf_dir)


@query
def unresolved_starts(spark, sf_dir):
    positions = maps.start_positions(match_log(spark, sf_dir))
    return maps.unresolved(maps.game_starts(positions, list(CENTRES), RADIUS))


@query
def unordered_start_key(spark, sf_dir):
    return maps.unordered_start_key(maps.start_positions(match_log(spark, sf_dir)))


@query
def map_clusters(spark, sf_dir):
    points = materialize(maps.start_points(maps.start_positions(match_log(spark, sf_dir))))
    _, centres = maps.fit_centres(points)
    return maps.assign_starts(points, centres, RADIUS)


# --- exploration ---


@query
def late_start_games(spark, sf_dir):
    return rounded(explore.late_starts(match_log(spark, sf_dir)))


@query
def start_time_frequency(spark, sf_dir):
    return explore.start_time_frequency(match_log(spark, sf_dir), 1)


@query
def opening_rows(spark, sf_dir):
    """Camera rows in the first minute's start, with the games that start late."""
    log = match_log(spark, sf_dir)
    late = explore.games_starting_between(log, 0.5, 30.0)
    cameras = log.where(F.col("event") == "Camera").groupBy("game_id").agg(
        F.count_if(F.col("time") == 0).alias("at_zero"), F.count(F.lit(1)).alias("cameras")
    )
    return rounded(late.join(cameras, "game_id", "left").fillna(0, ["at_zero", "cameras"]))


@query
def latest_game_timeline(spark, sf_dir):
    return rounded(
        explore.latest_game_timeline(match_log(spark, sf_dir)).select(
            "game_id", "seq", "time", "player", "event"
        )
    )


@query
def game_chunks(spark, sf_dir):
    return explore.game_chunks(match_log(spark, sf_dir), 100)


@query
def distinct_and_range(spark, sf_dir):
    return explore.key_ranges(match_log(spark, sf_dir))


@query
def event_frequency(spark, sf_dir):
    return explore.value_counts(match_log(spark, sf_dir), "event")


@query
def summary_stats(spark, sf_dir):
    columns = ["game_id", "winner", "time", "player"]
    return rounded(explore.numeric_summary(match_log(spark, sf_dir), columns))


@query
def text_search_first(spark, sf_dir):
    found = explore.search_text(match_log(spark, sf_dir), "Mothership")
    return rounded(found.select("seq", "game_id", "time", "event_contents"))


# --- matrix and scores ---


def _tables(spark, sf_dir):
    """The feature tables; the games are listed once and handed to all that need them."""
    log = match_log(spark, sf_dir)
    games = materialize(assemble.labelled_games(log))
    played = maps.map_data(log, list(CENTRES), RADIUS, SUPPORT, games)
    return assemble.feature_tables(log, UNITS, played, LAST_ROWS, games=games)


def _matrix(spark, sf_dir):
    return assemble.final_matrix(_tables(spark, sf_dir), UNITS)


@query
def final_matrix(spark, sf_dir):
    return rounded(scalar.plain_names(_matrix(spark, sf_dir)))


@query
def fitted_map_matrix(spark, sf_dir):
    """The matrix with maps detected from clustered starts, 15 map columns."""
    log = match_log(spark, sf_dir)
    played = materialize(maps.fitted_map_data(log, maps.STARTS, RADIUS, SUPPORT))
    tables = assemble.feature_tables(log, UNITS, played, LAST_ROWS, map_count=maps.STARTS)
    return rounded(scalar.plain_names(assemble.final_matrix(tables, UNITS)))


def scored_games(log: DataFrame) -> DataFrame:
    """A score that needs no model: player 1's share of abilities and clicks."""
    acted = F.col("event").isin("Ability", "Right Click")
    counts = log.groupBy("game_id").agg(
        F.max("winner").alias("label"),
        F.count_if(acted & (F.col("player") == 1)).alias("mine"),
        F.count_if(acted).alias("both"),
    )
    return counts.where(F.col("both") > 0).select(
        "game_id", "label", F.round(F.col("mine") / F.col("both"), 3).alias("score")
    )


@query
def prediction_spine(spark, sf_dir):
    log = match_log(spark, sf_dir)
    strong = scored_games(log).where(F.abs(F.col("score") - 0.5) > 0.05)
    return models.submission(readers.game_spine(log), strong)


@query
def stable_split(spark, sf_dir):
    return scoring.stable_split(readers.game_spine(match_log(spark, sf_dir)))


@query
def kfold_ids(spark, sf_dir):
    games = readers.game_spine(match_log(spark, sf_dir))
    return scoring.contiguous_folds(games).select("game_id", "fold")


@query
def auc_exact(spark, sf_dir):
    return rounded(scoring.auc(scored_games(match_log(spark, sf_dir))))


def margin_steps(log: DataFrame, minutes: int = 10) -> DataFrame:
    """Games with a label and a margin that grows by minutes: player 1's rows in the minute
    less player 0's. It needs no model, so SQL can follow the curve."""
    ahead = F.when(F.col("player") == 1, 1).otherwise(-1)
    at = scalar.minute(F.col("time"))
    per_minute = [F.sum(F.when(at == m, ahead).otherwise(0)).cast("double") for m in range(minutes)]
    return log.groupBy("game_id").agg(F.max("winner").alias("label"), F.array(*per_minute).alias("steps"))


def _margin_folds(spark, sf_dir):
    return scoring.contiguous_folds(margin_steps(match_log(spark, sf_dir)))


@query
def fold_round_auc(spark, sf_dir):
    return rounded(scoring.fold_curve(_margin_folds(spark, sf_dir)))


@query
def margin_learning_curve(spark, sf_dir):
    curve = materialize(scoring.fold_curve(_margin_folds(spark, sf_dir)))
    return rounded(scoring.curve_summary(curve))


@query
def best_margin_round(spark, sf_dir):
    curve = materialize(scoring.fold_curve(_margin_folds(spark, sf_dir)))
    return rounded(scoring.best_round(scoring.curve_summary(curve), "round", "mean_auc"))


@query
def auc_any_score(spark, sf_dir):
    """AUC per species pair of a score of any size and sign: the actions' lead to the ninth
    power, over a scale that makes some of them tiny."""
    log = match_log(spark, sf_dir)
    lead = scored_games(log).select(
        "game_id", "label", (F.pow(F.col("score") * 1000 - 500, F.lit(9)) * 1e-280).alias("score")
    )
    mixed = explore.with_matchup(actions.species_labels(log)).select("game_id", "species_mix")
    return rounded(scoring.auc(lead.join(mixed, "game_id"), by=("species_mix",)))


@query
def accuracy_f1(spark, sf_dir):
    return rounded(scoring.accuracy_f1(scored_games(match_log(spark, sf_dir))))


@query
def error_analysis(spark, sf_dir):
    log = match_log(spark, sf_dir)
    wrong = scoring.wrong_games(scored_games(log))
    played = explore.with_matchup(actions.species_labels(log)).join(
        _map_data(spark, sf_dir).select("game_id", "map"), "game_id"
    )
    return scoring.error_frequency(played, wrong, "species_mix", "map")


@query
def score_histogram(spark, sf_dir):
    return scoring.histogram(scored_games(match_log(spark, sf_dir)))


@query
def best_iteration(spark, sf_dir):
    """The minute up to which the more active player won most often, in one read of the log."""
    minute = scalar.minute(F.col("time")).alias("slice")
    counts = match_log(spark, sf_dir).groupBy("game_id", minute).agg(
        *[F.count_if(F.col("player") == p).alias(f"n_{p}") for p in PLAYERS],
        F.max("winner").alias("winner"),
    )
    so_far = Window.partitionBy("game_id").orderBy("slice")
    totals = [F.sum(f"n_{p}").over(so_far) for p in PLAYERS]
    series = counts.select(
        "slice",
        *[F.when(F.col(f"n_{p}") > 0, t).alias(f"so_far_{p}") for p, t in zip(PLAYERS, totals)],
        F.max("winner").over(Window.partitionBy("game_id")).alias("winner"),
    )
    hits = (
        series.dropna(subset=[f"so_far_{p}" for p in PLAYERS])
        .groupBy("slice")
        .agg(
            F.avg(
                ((F.col("so_far_1") > F.col("so_far_0")).cast("int") == F.col("winner")).cast("int")
            ).alias("hit_rate")
        )
    )
    return scoring.best_round(materialize(rounded(hits)), "slice", "hit_rate")


# --- models: fitted on the whole matrix, checked by properties ---


@query
def unit_pca(spark, sf_dir):
    counts = materialize(units.unit_counts_dense(match_log(spark, sf_dir), UNITS))
    return models.unit_pca(models.fit_unit_pca(counts), counts)


@query
def gbt_scores(spark, sf_dir):
    return models.gbt_holdout(_matrix(spark, sf_dir), positive=1.1, **TREES)


@query
def all_games_answered(spark, sf_dir):
    """Fitted on the games of a train log, scored on those of a test log without results."""
    log = match_log(spark, sf_dir).withColumn(
        "winner", F.when(F.col("game_id") < TRAIN_GAMES, F.col("winner"))
    )
    tables = assemble.feature_tables(log, UNITS, _map_data(spark, sf_dir), LAST_ROWS)
    matrix = assemble.final_matrix(tables, UNITS, labeled=False)
    return models.answers(matrix, readers.game_spine(log), **TREES)


@query
def rf_depth_sweep(spark, sf_dir):
    return models.depth_sweep(_matrix(spark, sf_dir), list(range(1, 31)))


@query
def feature_importance(spark, sf_dir):
    return models.feature_importance(_matrix(spark, sf_dir), **TREES)


@query
def learning_curve(spark, sf_dir):
    return models.learning_curve(_matrix(spark, sf_dir), **TREES)


@query
def cv_learning_curve(spark, sf_dir):
    """Mean and deviation of the AUC over five folds after every round, with the best one."""
    curve = materialize(models.cv_learning_curve(_matrix(spark, sf_dir), 5, **TREES))
    return scoring.curve_summary(curve)


@query
def cv_search(spark, sf_dir):
    """Successive halving of six trials over the whole bounds, each with all rounds it drew."""
    return models.halving_search(_matrix(spark, sf_dir), trials=6)
