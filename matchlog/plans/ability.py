"""Ability features: what was built, what it cost, how long the game took, one row per game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlog.functions import scalar, text
from matchlog.sources.schema import PLAYERS, SPECIES

COUNTS = ("train_sum", "build_sum", "upgrade_sum", "attack_sum")
COSTS = ("supply", "minerals", "gas")
MAPS = 7


def ability_rows(log: DataFrame) -> DataFrame:
    return log.where(F.col("event") == "Ability")


def produced(log: DataFrame) -> DataFrame:
    """Ability rows with the unit name each one produces."""
    return ability_rows(log).withColumn("unit", text.produced_units(F.col("event_contents")))


def produced_with_cost(log: DataFrame, unit_info: DataFrame) -> DataFrame:
    """Ability rows with the cost of what they produce; no cost where nothing matches."""
    return produced(log).join(unit_info, ["unit", "species"], "left")


def game_duration(log: DataFrame) -> DataFrame:
    """Time between the first and last ability of a game."""
    return (
        ability_rows(log)
        .groupBy("game_id")
        .agg((F.max("time") - F.min("time")).alias("duration"))
    )


def _by_unit(log: DataFrame, evolve_word: str) -> DataFrame:
    """Ability rows counted by player and produced unit: everything below adds these up.

    This is the only pass over detail rows, and the cost join sees counts, not actions.
    """
    name = text.ability_name(F.col("event_contents"))
    return (
        produced(log)
        .groupBy("game_id", "winner", "player", "species", "unit")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("time").alias("first_time"),
            F.max("time").alias("last_time"),
            F.sum(text.has_word(name, text.TRAIN_WORDS)).alias("train_sum"),
            F.sum(text.has_word(name, text.BUILD_WORDS)).alias("build_sum"),
            F.sum(text.has_word(name, (*text.UPGRADE_WORDS, evolve_word))).alias("upgrade_sum"),
            F.sum(text.has_word(name, text.ATTACK_WORDS)).alias("attack_sum"),
        )
    )


def player_rows(
    log: DataFrame, unit_info: DataFrame, evolve_word: str = text.EVOLVE_WORD
) -> DataFrame:
    """One row per player with ability counts, production cost and the game's duration.

    Costs are per player, durations per game, whatever else tells the rows apart.
    """
    game = Window.partitionBy("game_id")
    player = Window.partitionBy("game_id", "player")
    return (
        _by_unit(log, evolve_word)
        .join(unit_info, ["unit", "species"], "left")
        .repartition("game_id")
        .groupBy("game_id", "winner", "player", "species")
        .agg(
            F.min("first_time").alias("first_time"),
            F.max("last_time").alias("last_time"),
            *[F.sum(c).alias(c) for c in COUNTS],
            *[F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0.0)).alias(c) for c in COSTS],
        )
        .select(
            "game_id",
            "winner",
            "player",
            "species",
            (F.max("last_time").over(game) - F.min("first_time").over(game)).alias("duration"),
            *COUNTS,
            *[F.sum(c).over(player).alias(c) for c in COSTS],
        )
    )


def ability_summary(log: DataFrame, evolve_word: str = text.EVOLVE_WORD) -> DataFrame:
    """Ability counts per player. A row counts under every flag its name contains."""
    name = text.ability_name(F.col("event_contents"))
    flagged = ability_rows(log).select(
        "game_id",
        "winner",
        "player",
        "species",
        "time",
        text.has_word(name, text.TRAIN_WORDS).alias("train_sum"),
        text.has_word(name, text.BUILD_WORDS).alias("build_sum"),
        text.has_word(name, (*text.UPGRADE_WORDS, evolve_word)).alias("upgrade_sum"),
        text.has_word(name, text.ATTACK_WORDS).alias("attack_sum"),
    )
    game = Window.partitionBy("game_id")
    return (
        flagged.groupBy("game_id", "winner", "player", "species")
        .agg(
            F.min("time").alias("first_time"),
            F.max("time").alias("last_time"),
            *[F.sum(c).alias(c) for c in COUNTS],
        )
        .select(
            "game_id",
            "winner",
            (F.max("last_time").over(game) - F.min("first_time").over(game)).alias("duration"),
            "player",
            "species",
            *COUNTS,
        )
    )


def production_cost(log: DataFrame, unit_info: DataFrame) -> DataFrame:
    """Supply, minerals and gas each player spent on units."""
    return (
        produced(log)
        .groupBy("game_id", "player", "species", "unit")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(unit_info, ["unit", "species"], "left")
        .groupBy("game_id", "player")
        .agg(*[F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0.0)).alias(c) for c in COSTS])
    )


def map_flags(number: Column, count: int) -> list[Column]:
    """0/1 columns for the maps 0 .. count - 1; a map beyond them fails the job."""
    known = F.when(number.isNull() | number.between(0, count - 1), number).otherwise(
        F.raise_error(F.concat(F.lit("no column for map "), number.cast("string")))
    )
    return scalar.one_hot(known, range(count), "map_{}")


def flatten_players(rows: DataFrame, maps: DataFrame, map_count: int = MAPS) -> DataFrame:
    """Both players of a game side by side, with map and species as 0/1 columns.

    A game without rows of both players drops out. The two sides join on the game, by which
    ``rows`` are dealt already, and agree on the winner; a player has one row per species
    played.
    """
    values = ("species", *COUNTS, *COSTS)

    def side(p: int, *keys: Column) -> DataFrame:
        named = [F.col(v).alias(f"{v}_{p}") for v in values]
        return rows.where(F.col("player") == p).select(*keys, *named)

    left = side(0, F.col("game_id"), F.col("winner"), F.col("duration"))
    right = side(1, F.col("game_id").alias("_game"), F.col("winner").alias("_winner"))
    # not an equality of columns: the game alone stays the join key
    agree = F.coalesce("winner", F.lit(-1)) - F.coalesce("_winner", F.lit(-1)) == 0
    games = left.join(right, (F.col("game_id") == F.col("_game")) & agree)
    return games.join(maps.select("game_id", "map"), "game_id", "left").select(
        "game_id",
        "winner",
        "duration",
        *map_flags(F.col("map"), map_count),
        *[f"{v}_{p}" for p in PLAYERS for v in values],
    )


def with_species_flags(games: DataFrame) -> DataFrame:
    """Species as 0/1 columns instead of codes."""
    flags = [
        c
        for p in PLAYERS
        for c in scalar.one_hot(F.col(f"species_{p}"), SPECIES, f"species{p}_{{}}")
    ]
    return games.select("*", *flags).drop(*[f"species_{p}" for p in PLAYERS])


def game_rows(
    log: DataFrame, unit_info: DataFrame, maps: DataFrame, map_count: int = MAPS
) -> DataFrame:
    """The ability feature table, one row per game.

    ``map_count`` is the number of map columns; pass the ``k`` of fitted map detection.
    """
    return with_species_flags(flatten_players(player_rows(log, unit_info), maps, map_count))
