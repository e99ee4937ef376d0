"""Camera and click features: drift from base, step lengths, time spent near the enemy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlog.functions import scalar, text
from matchlog.operators import ordered, shaping
from matchlog.sources.schema import PLAYERS

MINUTES = 10
LAST_ROWS = 300


def points(log: DataFrame) -> DataFrame:
    """Camera moves and right clicks with integer coordinates, rows without any left out.

    All plans below start from this narrow relation, so it can be parsed once and kept.
    """
    moved = log.where(F.col("event").isin("Camera", "Right Click"))
    paired = shaping.with_once(moved, "pair", text.coordinate_pair(F.col("event_contents")))
    return paired.select(
        "game_id",
        "player",
        "seq",
        scalar.minute(F.col("time")).alias("slice"),
        text.pair_part(F.col("pair"), 1).alias("x"),
        text.pair_part(F.col("pair"), 2).alias("y"),
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def center_drift(moves: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """Distance of each minute's mean position from the player's first position."""
    early = moves.where(F.col("slice") < minutes)
    per_minute = (
        early.groupBy("game_id", "player", "slice")
        .agg(
            F.avg("x").alias("x"),
            F.avg("y").alias("y"),
            F.min("seq").alias("seq"),
            F.min_by("x", "seq").alias("x_first"),
            F.min_by("y", "seq").alias("y_first"),
        )
        .repartition("game_id")
    )
    player = Window.partitionBy("game_id", "player")
    base = [F.min_by(c, "seq").over(player) for c in ("x_first", "y_first")]
    moved = per_minute.withColumn("dist", scalar.distance(F.col("x"), F.col("y"), *base))
    wide = shaping.spread(
        moved,
        shaping.player_cell(),
        shaping.player_cells(range(minutes), "p{p}_center_{m}"),
        {"dist": F.max("dist")},
    )
    return scalar.fill_features(shaping.both_present(wide, ("p0_", "p1_")))


def steps(moves: DataFrame, minutes: int = MINUTES, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Distance of each position from the player's previous one."""
    early = moves.where(F.col("slice") < minutes)
    return (
        ordered.with_previous(early, ["game_id", "player"], ["x", "y"], block_rows=block_rows)
        .where(F.col("prev_x").isNotNull() & F.col("prev_y").isNotNull())
        .select(
            "game_id",
            "player",
            "slice",
            "seq",
            scalar.distance(*[F.col(c) for c in ("prev_x", "prev_y", "x", "y")]).alias("dist"),
        )
    )


def step_stats(
    moves: DataFrame, minutes: int = MINUTES, block_rows: int = ordered.BLOCK_ROWS
) -> DataFrame:
    """Mean and sample deviation of step lengths, per player and per player's minute.

    Totals are combined from the minutes' counts, means and variances. A single step has
    no deviation, an absent player no values: both stay null.
    """
    per_minute = (
        steps(moves, minutes, block_rows)
        .groupBy("game_id", "player", "slice")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("dist").alias("mean"),
            F.var_pop("dist").alias("var"),
            F.stddev_samp("dist").alias("std"),
        )
        .repartition("game_id")
    )
    player = Window.partitionBy("game_id", "player")
    totals = per_minute.withColumn("total_n", F.sum("n").over(player)).withColumn(
        "total_mean", F.sum(F.col("n") * F.col("mean")).over(player) / F.col("total_n")
    )
    off = F.col("mean") - F.col("total_mean")
    totals = totals.withColumn(
        "total_m2", F.sum(F.col("n") * (F.col("var") + off * off)).over(player)
    ).withColumn(
        "total_std",
        F.when(F.col("total_n") > 1, F.sqrt(F.col("total_m2") / (F.col("total_n") - 1))),
    )
    # each minute row also brings its player's totals, as one cell more
    cells = totals.select(
        "game_id",
        F.inline(
            F.array(
                F.struct(shaping.player_cell().alias("cell"), "mean", "std"),
                F.struct(
                    (F.col("player") * shaping.CELLS + minutes).alias("cell"),
                    F.col("total_mean").alias("mean"),
                    F.col("total_std").alias("std"),
                ),
            )
        ),
    )
    names = shaping.player_cells(range(minutes), "cam_moving_p{p}_{}{m}") | {
        p * shaping.CELLS + minutes: f"p{p}_moving_{{}}" for p in PLAYERS
    }
    return shaping.spread(
        cells, F.col("cell"), names, {"mean": F.max("mean"), "std": F.max("std")}
    )


def sided_points(
    moves: DataFrame, last_rows: int = LAST_ROWS, block_rows: int = ordered.BLOCK_ROWS
) -> DataFrame:
    """Positions with ``aggressive`` (nearer the enemy's base than the own) and ``is_last``.

    A base is the player's first position; games without both bases drop out. Bases
    are found per (game, stretch) and handed back to the rows on that key, so
    a long game is spread over many tasks.
    """
    # the join below would demand these keys of one of the two reads only
    keyed = moves.where(F.col("game_id").isNotNull() & F.col("seq").isNotNull())
    placed = ordered.with_block(keyed, block_rows=block_rows)
    placed = placed.where(F.col(ordered.BLOCK).isNotNull()).repartition("game_id", ordered.BLOCK)
    first = {
        f"base_{axis}{p}": F.min_by(
            F.when(F.col("player") == p, F.col(axis)), F.when(F.col("player") == p, F.col("seq"))
        )
        for p in PLAYERS
        for axis in ("x", "y")
    }
    per_block = placed.groupBy("game_id", ordered.BLOCK).agg(*[e.alias(n) for n, e in first.items()])
    whole_game = Window.partitionBy("game_id").orderBy(ordered.BLOCK).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    bases = per_block.select(
        "game_id",
        ordered.BLOCK,
        *[F.first(n, ignorenulls=True).over(whole_game).alias(n) for n in first],
    )
    d0, d1 = (
        scalar.distance(F.col("x"), F.col("y"), F.col(f"base_x{p}"), F.col(f"base_y{p}"))
        for p in PLAYERS
    )
    return (
        ordered.mark_last(placed, bases, ["game_id"], last_rows)
        .where(F.col("base_x0").isNotNull() & F.col("base_x1").isNotNull())
        .withColumn("aggressive", F.when(F.col("player") == 0, d0 > d1).otherwise(d1 > d0))
    )


def home_away(
    moves: DataFrame, last_rows: int = LAST_ROWS, block_rows: int = ordered.BLOCK_ROWS
) -> DataFrame:
    """How often each player looks at the enemy's side, overall and near the end.

    Columns named for one player in the home/enemy group hold the other player's counts,
    as established readers of this table expect. Games without any aggressive row or any
    row at home drop out.
    """
    counts = {}
    for p in PLAYERS:
        mine = F.col("player") == p
        counts |= {
            f"all{p}": F.count_if(mine),
            f"away{p}": F.count_if(mine & F.col("aggressive")),
            f"all_last{p}": F.count_if(mine & F.col("is_last")),
            f"away_last{p}": F.count_if(mine & F.col("is_last") & F.col("aggressive")),
        }
    games = (
        sided_points(moves, last_rows, block_rows)
        .groupBy("game_id")
        .agg(*[e.alias(n) for n, e in counts.items()])
        .where(F.col("away0") + F.col("away1") > 0)
        .where(F.col("all0") + F.col("all1") > F.col("away0") + F.col("away1"))
    )
    home = {p: (F.col(f"all{p}") - F.col(f"away{p}")).cast("double") for p in PLAYERS}
    away = {p: F.col(f"away{p}").cast("double") for p in PLAYERS}
    ratios = games.select(
        "game_id",
        *[
            scalar.float_ratio(F.col(f"away{s}{p}"), F.col(f"all{s}{p}")).alias(
                f"cam_remote_ratio{p}{s}"
            )
            for s in ("", "_last")
            for p in PLAYERS
        ],
        *[home[1 - p].alias(f"camera_home_p{p}") for p in PLAYERS],
        *[away[1 - p].alias(f"camera_enemy_to_p{p}") for p in PLAYERS],
        *[scalar.float_ratio(away[1 - p], home[1 - p]).alias(f"homeaway_p{p}") for p in PLAYERS],
    )
    return scalar.fill_features(ratios)


def last_minutes_pressure(moves: DataFrame, minutes: int = 3) -> DataFrame:
    """Aggressive rows in each player's last occupied minutes.

    Rows are counted per (player, minute) before the minutes are ranked.
    """
    per_minute = aggressive_per_minute(moves)
    recent = Window.partitionBy("game_id", "player").orderBy(F.desc("slice"))
    return (
        per_minute.withColumn("back", F.row_number().over(recent))
        .where(F.col("back") <= minutes)
        .groupBy("game_id", "player")
        .agg(F.sum("aggressive_rows").alias("pressure"), F.min("slice").alias("from_slice"))
    )


def aggressive_per_minute(moves: DataFrame) -> DataFrame:
    """Rows and aggressive rows per player and occupied minute."""
    return (
        sided_points(moves)
        .groupBy("game_id", "player", "slice")
        .agg(
            F.count(F.lit(1)).alias("rows_in_slice"),
            F.count_if("aggressive").alias("aggressive_rows"),
        )
    )
