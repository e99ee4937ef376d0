"""Which player owns which unit, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlog.functions import scalar, text
from matchlog.operators import ordered, shaping
from matchlog.plans.actions import first_species
from matchlog.sources.readers import UnitCatalog
from matchlog.sources.schema import PLAYERS, SPECIES

TOP_NAMES = 100
_UNIT = ["game_id", "unit_id"]

# A mention is ordered by its row and its place in the row's list, packed in one long so
# that aggregates on it stay in fixed-width buffers.
_PLACES = 1 << 20
_SEQS = 1 << 43


def _mention_order(seq: Column, pos: Column) -> Column:
    return F.when(
        (pos < _PLACES) & (seq < _SEQS), seq * _PLACES + pos
    ).otherwise(F.raise_error(F.lit("mention order does not fit: seq or list too long")))


def selection_mentions(log: DataFrame) -> DataFrame:
    """One row per unit mentioned in a selection, empty names left out."""
    return (
        log.where(F.col("event") == "Selection")
        .select(
            "game_id",
            "player",
            "species",
            "seq",
            F.posexplode(text.mentions(F.col("event_contents"))).alias("pos", "mention"),
        )
        .select(
            "game_id",
            "player",
            "species",
            "seq",
            "pos",
            text.mention_name(F.col("mention")).alias("name"),
            text.mention_id(F.col("mention")).alias("unit_id"),
        )
        .where(F.col("name") != "")
    )


def claims(log: DataFrame, catalog: UnitCatalog) -> DataFrame:
    """Mentions of known combat units by their catalogue number ``code``; ``native`` if the
    mentioning player's species owns the unit."""
    known = catalog.dictionary(log.sparkSession).select("unit", "code", "owners")
    return (
        selection_mentions(log)
        .withColumn("unit", text.unit_stance_removed(F.col("name")))
        .where(~text.is_worker(F.col("unit")))
        .join(known, "unit")
        .select(
            *_UNIT,
            "player",
            "code",
            F.array_contains("owners", F.col("species")).alias("native"),
            "seq",
            _mention_order(F.col("seq"), F.col("pos")).alias("at"),
        )
    )


def ownership(
    log: DataFrame, catalog: UnitCatalog, block_rows: int = ordered.BLOCK_ROWS
) -> DataFrame:
    """Final name of each unit id for each player who holds it, see ``owned_codes``."""
    names = catalog.dictionary(log.sparkSession).select("code", "unit")
    return (
        owned_codes(log, catalog, block_rows)
        .join(names, "code")
        .select("game_id", "player", "unit_id", "unit")
    )


def owned_codes(
    log: DataFrame, catalog: UnitCatalog, block_rows: int = ordered.BLOCK_ROWS
) -> DataFrame:
    """Final catalogue number of each unit id for each player who holds it.

    The first claim decides the owner: the claiming player if the unit is native to their
    species, else the opponent. The owner's later native claims rename the unit, until the
    owner first calls it by a foreign name; then the opponent holds it under that name too,
    and nothing changes any more. The opponent's claims never count.

    So a player's claims matter up to their first foreign one. Both players are followed,
    first inside (unit, stretch) groups, then over one row per stretch; the owner is picked
    at the end. No unit's claims are ever gathered in one task. What is aggregated are
    numbers: the buffers have a fixed width, so Spark hashes and need not sort.
    """
    placed = ordered.with_block(claims(log, catalog), block_rows=block_rows).repartition(
        *_UNIT, ordered.BLOCK
    )

    def by(p: int, native: bool) -> Column:
        return (F.col("player") == p) & (F.col("native") == native)

    inside = Window.partitionBy(*_UNIT, ordered.BLOCK).orderBy("at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    marked = placed.select(
        "*", *[F.max(by(p, False)).over(inside).alias(f"ended{p}") for p in PLAYERS]
    )
    per_block = marked.groupBy(*_UNIT, ordered.BLOCK).agg(
        F.min_by("code", "at").alias("first_code"),
        F.min_by(
            F.when(F.col("native"), F.col("player")).otherwise(1 - F.col("player")), "at"
        ).alias("first_owner"),
        *[
            e
            for p in PLAYERS
            for e in (
                F.max_by("code", F.when(by(p, True) & ~F.col(f"ended{p}"), F.col("at"))).alias(
                    f"own{p}"
                ),
                F.min_by("code", F.when(by(p, False), F.col("at"))).alias(f"foreign{p}"),
            )
        ],
    )
    earlier = Window.partitionBy(*_UNIT).orderBy(ordered.BLOCK).rowsBetween(
        Window.unboundedPreceding, -1
    )
    linked = per_block.select(
        "*",
        *[
            F.coalesce(F.max(F.col(f"foreign{p}").isNotNull()).over(earlier), F.lit(False)).alias(
                f"ended{p}"
            )
            for p in PLAYERS
        ],
    )
    at = F.col(ordered.BLOCK)
    per_unit = linked.groupBy(*_UNIT).agg(
        F.min_by("first_code", at).alias("first_code"),
        F.min_by("first_owner", at).alias("owner"),
        *[
            e
            for p in PLAYERS
            for e in (
                F.max_by(
                    f"own{p}", F.when(F.col(f"own{p}").isNotNull() & ~F.col(f"ended{p}"), at)
                ).alias(f"own{p}"),
                F.min_by(f"foreign{p}", F.when(F.col(f"foreign{p}").isNotNull(), at)).alias(
                    f"foreign{p}"
                ),
            )
        ],
    )

    def of_owner(name: str) -> Column:
        return F.when(F.col("owner") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    held = F.array(
        F.struct(
            F.col("owner").alias("player"),
            F.coalesce(of_owner("own"), F.col("first_code")).alias("code"),
        ),
        F.struct((1 - F.col("owner")).alias("player"), of_owner("foreign").alias("code")),
    )
    return (
        per_unit.select(*_UNIT, F.inline(held))
        .where(F.col("code").isNotNull())
        .select("game_id", "player", "unit_id", "code")
    )


def unit_columns(catalog: UnitCatalog) -> list[str]:
    return [f"p{p}_{u}" for p in PLAYERS for u in catalog.units]


def unit_counts(owned: DataFrame, catalog: UnitCatalog) -> DataFrame:
    """Number of units per name, one column per player and known name; ``owned`` has the
    names' numbers."""
    numbers = dict(enumerate(catalog.units))
    return shaping.spread(
        owned,
        shaping.player_cell(number="code"),
        {p * shaping.CELLS + i: f"p{p}_{u}" for p in PLAYERS for i, u in numbers.items()},
        {"n": F.count(F.lit(1))},
    )


def unit_counts_dense(
    log: DataFrame,
    catalog: UnitCatalog,
    from_zero: bool = True,
    block_rows: int = ordered.BLOCK_ROWS,
) -> DataFrame:
    """Unit counts for every game id up to the last one with a selection, zeros filled in."""
    picked = log.where(F.col("event") == "Selection")
    low = F.lit(0) if from_zero else F.min("game_id")
    bounds = picked.agg(low.alias("low"), F.max("game_id").alias("high"))
    grid = ordered.id_grid(bounds, "low", "high", "game_id").select(F.col("game_id").cast("int"))
    counts = unit_counts(owned_codes(log, catalog, block_rows), catalog)
    return scalar.fill_features(grid.join(counts, "game_id", "left"))


def native_units(catalog: UnitCatalog, log: DataFrame) -> DataFrame:
    """The units of each species, as one sorted array."""
    return (
        catalog.frame(log.sparkSession)
        .groupBy("species")
        .agg(F.array_sort(F.collect_set("unit")).alias("units"))
    )


# --- first-claimer variant: names as written, whoever mentions a unit first keeps it ---


def first_claims(log: DataFrame) -> DataFrame:
    """Accepted mentions: those by the player who mentioned the unit first.

    Mentions are counted per (unit, player, species, name) before units are looked at, so
    a unit's group holds its distinct names only. ``named`` marks the name it ends with.
    """
    counted = (
        selection_mentions(log)
        .withColumn("at", _mention_order(F.col("seq"), F.col("pos")))
        .groupBy(*_UNIT, "player", "species", "name")
        .agg(
            F.count(F.lit(1)).alias("mentions"),
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
        )
        .repartition(*_UNIT)
    )
    unit = Window.partitionBy(*_UNIT)
    return (
        counted.withColumn("owner", F.min_by("player", "first_at").over(unit))
        .withColumn("claimed_at", F.min("first_at").over(unit))
        .where(F.col("player") == F.col("owner"))
        .withColumn("named", F.col("last_at") == F.max("last_at").over(unit))
        .drop("owner")
    )


def holdings(accepted: DataFrame) -> DataFrame:
    """One row per unit: its player, final name and when it was first claimed."""
    return accepted.where("named").select("game_id", "player", "unit_id", "name", "claimed_at")


def name_frequency(accepted: DataFrame) -> DataFrame:
    """Accepted mentions per species and name."""
    return accepted.groupBy("species", "name").agg(F.sum("mentions").alias("mentions"))


def top_names(frequency: DataFrame, k: int = TOP_NAMES) -> DataFrame:
    """The ``k`` most mentioned names per species, numbered from 1; equal counts by name."""
    return ordered.top_per_key(
        frequency, ["species"], [F.desc("mentions"), F.asc("name")], k, "place"
    )


def rare_names(frequency: DataFrame, k: int = TOP_NAMES) -> DataFrame:
    """The names after the ``k`` most mentioned ones."""
    top = top_names(frequency, k).select("species", "name")
    return frequency.join(top, ["species", "name"], "left_anti")


def neutral_names(frequency: DataFrame) -> DataFrame:
    """Names all three species mention: objects of the map rather than units."""
    return (
        frequency.where(F.col("species").isin(*SPECIES))
        .groupBy("name")
        .agg(F.count_distinct("species").alias("n"))
        .where(F.col("n") == len(SPECIES))
        .select("name")
    )


def without_neutral(held: DataFrame, neutral: DataFrame, every: bool = False) -> DataFrame:
    """Holdings without neutral objects.

    By default one object per player and name goes, the last claimed one; ``every``
    removes them all. The neutral names travel as one row, so no name, however common, is a
    join key.
    """
    names = neutral.select(F.array_sort(F.collect_set("name"))).scalar()
    is_neutral = F.coalesce(F.array_contains(names, F.col("name")), F.lit(False))
    if every:
        return held.where(~is_neutral)
    last = (
        held.where(is_neutral)
        .groupBy("game_id", "player", "name")
        .agg(F.max("claimed_at").alias("claimed_at"))
        .select("game_id", "claimed_at")
    )
    # claimed_at tells units of a game apart, so the join has no heavy key
    return held.join(last, ["game_id", "claimed_at"], "left_anti")


def top_slots(
    log: DataFrame,
    accepted: DataFrame,
    k: int = TOP_NAMES,
    ranks: DataFrame | None = None,
) -> DataFrame:
    """Units held per name slot: slot i counts the i-th most mentioned name of the
    player's species. ``accepted`` are the log's ``first_claims``, read twice here;
    ``ranks`` are the training log's when ``log`` is another one."""
    if ranks is None:
        ranks = top_names(name_frequency(accepted), k)
    picked = log.where(F.col("event") == "Selection")
    games = picked.select("game_id").distinct()
    species = first_species(picked)
    per_name = holdings(accepted).groupBy("game_id", "player", "name").agg(
        F.count(F.lit(1)).alias("n")
    )
    slots = (
        per_name.join(species, ["game_id", "player"], "left")
        .withColumn("species", F.coalesce("species", F.lit("T")))
        .join(ranks.select("species", "name", "place"), ["species", "name"])
        .withColumn("slice", F.col("place") - 1)
    )
    wide = shaping.spread(
        slots,
        shaping.player_cell(),
        shaping.player_cells(range(k), "p{p}_u{m}"),
        {"n": F.sum("n")},
    )
    return scalar.fill_features(games.join(wide, "game_id", "left"))


def roster(
    log: DataFrame, owned: DataFrame, spread: int = ordered.BLOCK_ROWS
) -> DataFrame:
    """Both players' units side by side in unit-id order, headed by species and result.

    Positions are exact ranks by ranges of (game, player, unit), whatever the ids look like,
    and heads go to stretches of ``spread`` positions, so no game's units meet in one task.
    """
    placed = ordered.exact_rank(owned, ["game_id", "player"], [F.col("unit_id")])
    sides = placed.groupBy("game_id", "position").agg(
        *[F.max(F.when(F.col("player") == p, F.col("unit"))).alias(f"unit_{p}") for p in PLAYERS]
    )
    return shaping.join_spread(
        sides, roster_heads(log), ["game_id"], F.expr(f"position div {spread}")
    )


def roster_heads(log: DataFrame) -> DataFrame:
    """Each game's two headings: a player's species and whether they won.

    One pass: the species is that of the player's first row, the winner the first row's.
    """
    first = {
        f"species_{p}": F.min_by("species", F.when(F.col("player") == p, F.col("seq")))
        for p in PLAYERS
    }
    games = log.groupBy("game_id").agg(
        F.min_by("winner", "seq").alias("winner"), *[e.alias(n) for n, e in first.items()]
    )
    return games.select(
        "game_id",
        *[
            F.concat(
                f"species_{p}",
                F.when(F.col("winner") == p, F.lit(" (True)")).otherwise(F.lit(" (False)")),
            ).alias(f"head_{p}")
            for p in PLAYERS
        ],
    )
