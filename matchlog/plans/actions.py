"""Action features: activity per minute, attack strength, event counts, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlog.functions import scalar, text
from matchlog.operators import ordered, shaping
from matchlog.sources.readers import UnitCatalog
from matchlog.sources.schema import EVENTS, PLAYERS, SPECIES

MINUTES = 10
ATTACK_MINUTES = 12
FIRST_ATTACK_SLICE = 5
ATTACK_COLUMNS = (
    [f"p{p}_attack_units" for p in PLAYERS]
    + [
        f"attack_units_p{p}_s{s}"
        for p in PLAYERS
        for s in range(FIRST_ATTACK_SLICE, ATTACK_MINUTES)
    ]
)


def agility(log: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """Abilities and right clicks per player and minute; both players are required."""
    acted = (
        log.where(F.col("event").isin("Ability", "Right Click"))
        .select("game_id", "player", scalar.minute(F.col("time")).alias("slice"))
        .where(F.col("slice") < minutes)
    )
    wide = shaping.spread(
        acted,
        shaping.player_cell(),
        shaping.player_cells(range(minutes), "p{p}_actions_{m}"),
        {"n": F.count(F.lit(1))},
    )
    return scalar.fill_features(shaping.both_present(wide, ("p0_", "p1_")))


def agility_totals(wide: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """Add each player's actions over all minutes."""
    return wide.select(
        "*",
        *[
            scalar.sum_columns(f"p{p}_actions_{m}" for m in range(minutes)).alias(f"p{p}_actions")
            for p in PLAYERS
        ],
    )


def attack_events(
    log: DataFrame, catalog: UnitCatalog, block_rows: int = ordered.BLOCK_ROWS
) -> DataFrame:
    """Attacks with the supply of the units the player had selected right before.

    Kept rows are attacks and selections with a known combat unit. Only the row directly
    before counts, so a second attack in a row has no selection and drops out. Names find
    their supply by a join; a selection's are added up where it is read, before the shuffle.
    """
    contents = F.col("event_contents")
    is_attack = F.col("event") == "Ability"
    considered = (
        log.where(
            (F.col("event") == "Selection") | (is_attack & F.contains(contents, F.lit("Attack")))
        )
        .withColumn("slice", scalar.minute(F.col("time")))
        .where(F.col("slice") < ATTACK_MINUTES)
    )
    row = ["game_id", "player", "seq", "slice"]
    supplies = catalog.dictionary(log.sparkSession).select("unit", "supply").where(F.col("supply").isNotNull())
    selected = (
        considered.where(F.col("event") == "Selection")
        .select(*row, F.explode(text.mention_names(contents)).alias("unit"))
        .join(supplies, "unit")
        .groupBy(*row)
        .agg(F.sum("supply").alias("supply"))
    )
    attacks = considered.where(is_attack).select(*row, F.lit(True).alias("is_attack"), F.lit(None).cast("double").alias("supply"))
    kept = attacks.unionByName(selected.withColumn("is_attack", F.lit(False)))
    return (
        ordered.with_previous(kept, ["game_id", "player"], ["supply"], block_rows=block_rows)
        .where(F.col("is_attack") & F.col("prev_supply").isNotNull())
        .select("game_id", "player", "slice", "seq", F.col("prev_supply").alias("strength"))
    )


def attack_strength(
    log: DataFrame, catalog: UnitCatalog, block_rows: int = ordered.BLOCK_ROWS
) -> DataFrame:
    """Attack supply per player, in total and for the later minutes."""
    cells = {
        p * shaping.CELLS + s: f"p{p}_{s}" for p in PLAYERS for s in range(ATTACK_MINUTES)
    }
    wide = shaping.spread(
        attack_events(log, catalog, block_rows),
        shaping.player_cell(),
        cells,
        {"strength": F.sum("strength")},
    )
    wide = scalar.fill_features(wide)
    totals = [
        scalar.sum_columns(f"p{p}_{s}" for s in range(ATTACK_MINUTES)).alias(f"p{p}_attack_units")
        for p in PLAYERS
    ]
    late = [
        F.col(f"p{p}_{s}").alias(f"attack_units_p{p}_s{s}")
        for p in PLAYERS
        for s in range(FIRST_ATTACK_SLICE, ATTACK_MINUTES)
    ]
    return scalar.conform(wide.select("game_id", *totals, *late), ["game_id", *ATTACK_COLUMNS])


def event_counts(log: DataFrame) -> DataFrame:
    """Rows per player and event type, one column each, named ``<player>_<event>``.

    The columns are those of the known event types; another type fails the job, as it would
    be missing from the counts without a word.
    """
    numbers = {e: i for i, e in enumerate(EVENTS)}
    event_number = F.create_map(*[F.lit(v) for pair in numbers.items() for v in pair])
    unknown = F.raise_error(F.concat(F.lit("unknown event type "), F.col("event"))).cast("int")
    known = log.where(F.col("event").isNotNull()).withColumn(
        "slice", F.coalesce(F.element_at(event_number, F.col("event")), unknown)
    )
    names = {p * shaping.CELLS + i: f"{p}_{e}" for p in PLAYERS for e, i in numbers.items()}
    wide = shaping.spread(known, shaping.player_cell(), names, {"n": F.count("time")})
    return scalar.fill_features(wide)


def first_species(log: DataFrame) -> DataFrame:
    """Each player's species in their first row."""
    firsts = log.groupBy("game_id", "player", "species").agg(F.min("seq").alias("seq"))
    return firsts.groupBy("game_id", "player").agg(F.min_by("species", "seq").alias("species"))


def species_labels(log: DataFrame) -> DataFrame:
    """Species of both players and the winner, from the distinct label rows of a game."""
    distinct = log.select("game_id", "winner", "player", "species").dropDuplicates()
    return (
        distinct.groupBy("game_id")
        .agg(
            *[
                F.min(F.when(F.col("player") == p, F.col("species"))).alias(f"species_{p}")
                for p in PLAYERS
            ],
            F.collect_set("winner").alias("winners"),
        )
        .select("game_id", "species_0", "species_1", F.explode_outer("winners").alias("winner"))
    )


def baseline_set(log: DataFrame) -> DataFrame:
    """Label, species flags and event counts: the input of the first baseline model."""
    labels = species_labels(log)
    flags = [
        c
        for p in PLAYERS
        for c in scalar.one_hot(F.col(f"species_{p}"), SPECIES, f"species{p}_{{}}")
    ]
    return (
        labels.select("game_id", "winner", *flags).join(event_counts(log), "game_id")
    )


def event_series(log: DataFrame) -> DataFrame:
    """Actions per player and minute over the whole game, with the running total."""
    per_minute = log.groupBy(
        "game_id", "player", scalar.minute(F.col("time")).alias("slice")
    ).agg(F.count(F.lit(1)).alias("actions"))
    so_far = Window.partitionBy("game_id", "player").orderBy("slice")
    return per_minute.withColumn("so_far", F.sum("actions").over(so_far))
