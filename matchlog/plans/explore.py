"""Exploration queries over the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlog.functions import scalar, text
from matchlog.operators import shaping
from matchlog.sources.schema import PLAYERS
from matchlog.sources.sinks import GAMES_PER_CHUNK


def value_counts(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    """Distinct values with their frequency, most frequent first."""
    return (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias(name))
        .orderBy(F.desc(name), *[F.asc(c) for c in columns])
    )


def game_starts(rows: DataFrame) -> DataFrame:
    """Time of the first row of each game."""
    return rows.groupBy("game_id").agg(F.min("time").alias("first_time"))


def late_starts(log: DataFrame) -> DataFrame:
    """Games by the time of their first ability, latest first."""
    return game_starts(log.where(F.col("event") == "Ability")).orderBy(
        F.desc("first_time"), "game_id"
    )


def start_time_frequency(log: DataFrame, digits: int = 2) -> DataFrame:
    """How many games start at each time."""
    rounded = game_starts(log).select(F.round("first_time", digits).alias("first_time"))
    return value_counts(rounded, "first_time", name="games")


def rows_at_start(log: DataFrame, event: str = "Camera") -> DataFrame:
    """The rows of one event type before anything took time."""
    return log.where((F.col("time") == 0) & (F.col("event") == event))


def games_starting_between(log: DataFrame, low: float, high: float) -> DataFrame:
    """Games whose first row lies in a time range."""
    return game_starts(log).where(F.col("first_time").between(low, high))


def game_timeline(log: DataFrame, game_id: int) -> DataFrame:
    """All rows of one game in time order."""
    return log.where(F.col("game_id") == game_id).orderBy("time", "seq")


def latest_game_timeline(log: DataFrame) -> DataFrame:
    """All rows of the game that starts last, in time order."""
    latest = game_starts(log).orderBy(F.desc("first_time"), "game_id").limit(1)
    return log.join(latest.select("game_id"), "game_id", "left_semi").orderBy("time", "seq")


def game_chunks(log: DataFrame, games: int = GAMES_PER_CHUNK) -> DataFrame:
    """Games and rows per range of ``games`` ids."""
    per_game = log.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    return per_game.groupBy(F.expr(f"game_id div {games}").alias("chunk")).agg(
        F.count(F.lit(1)).alias("games"), F.sum("n").alias("n_rows")
    )


def search_text(log: DataFrame, word: str, n: int = 20) -> DataFrame:
    """The first ``n`` rows by time whose payload contains a word."""
    return (
        log.where(F.contains("event_contents", F.lit(word))).orderBy("time", "seq").limit(n)
    )


def ability_names(log: DataFrame) -> DataFrame:
    """Distinct abilities per species, as written before the location."""
    return (
        log.where(F.col("event") == "Ability")
        .select("species", F.substring_index("event_contents", ";", 1).alias("ability"))
        .distinct()
        .orderBy("species", "ability")
    )


def key_ranges(log: DataFrame) -> DataFrame:
    """Row count, key range and distinct counts, from rows counted per (game, event)."""
    pairs = log.groupBy("game_id", "event").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(
        F.sum("n").alias("n_rows"),
        F.min("game_id").alias("min_game"),
        F.max("game_id").alias("max_game"),
        F.count_distinct("game_id").alias("n_games"),
        F.count_distinct("event").alias("n_events"),
    )


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation and range of each column, one row per column, in one pass."""
    stats: dict[str, callable] = {
        "n": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
    }

    def value(column: str, stat: str) -> Column:
        return F.col(f"{column}_{stat}").cast("bigint" if stat == "n" else "double").alias(stat)

    flat = df.agg(*[f(c).alias(f"{c}_{s}") for c in columns for s, f in stats.items()])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), *[value(c, s) for s in stats]) for c in columns]
    )
    return flat.select(F.inline(rows))


def schema_rows(df: DataFrame) -> DataFrame:
    """Column names and types as a relation."""
    return df.sparkSession.createDataFrame(df.dtypes, "column STRING, type STRING")


def matchup_frequency(games: DataFrame) -> DataFrame:
    """How often each pair of species codes meets; needs ``species_0`` and ``species_1``."""
    return value_counts(with_matchup(games), "species_mix", name="games")


def with_matchup(games: DataFrame) -> DataFrame:
    coded = games.select(
        "*", *[scalar.species_code(F.col(f"species_{p}")).alias(f"code_{p}") for p in PLAYERS]
    )
    return coded.withColumn("species_mix", scalar.matchup(F.col("code_0"), F.col("code_1")))


def segment(games: DataFrame, mix: str) -> DataFrame:
    """Games of one pairing."""
    return with_matchup(games).where(F.col("species_mix") == mix)


def parsed_abilities(log: DataFrame) -> DataFrame:
    """Ability rows with name, location, first produced unit and word flags."""
    contents = F.col("event_contents")
    name = text.ability_name(contents)
    words = {
        "is_train": ("Train",),
        "is_warp": ("Warp",),
        "is_morph": ("Morph",),
        "is_build": ("Build",),
        "is_upgrade": ("Upgrade",),
        "is_research": ("Research",),
        "is_evolve": (text.EVOLVE_WORD,),
        "is_attack": ("Attack",),
    }
    return log.where(F.col("event") == "Ability").select(
        "seq",
        name.alias("ability"),
        text.ability_location(contents).alias("location"),
        text.first_produced(contents).alias("produced"),
        *[text.has_word(name, w).alias(c) for c, w in words.items()],
    )


def parsed_coordinates(log: DataFrame) -> DataFrame:
    """Camera moves, clicks and abilities with a location: coordinates, minute, target."""
    contents = F.col("event_contents")
    located = log.where(F.col("event").isin("Camera", "Right Click", "Ability"))
    return (
        shaping.with_once(located, "pair", text.coordinate_pair(contents))
        .where(F.col("pair") != "")
        .select(
            "seq",
            "event",
            scalar.minute(F.col("time")).alias("slice"),
            text.pair_part(F.col("pair"), 1).alias("x"),
            text.pair_part(F.col("pair"), 2).alias("y"),
            text.target_part(contents, 1).alias("target"),
            text.target_part(contents, 3).try_cast("int").alias("target_x"),
            text.target_part(contents, 4).try_cast("int").alias("target_y"),
        )
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
