"""The training matrix: all feature tables joined on the game."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlog.functions import scalar
from matchlog.operators import ordered, shaping
from matchlog.plans import ability, actions, camera, units
from matchlog.session import materialize
from matchlog.sources.readers import UnitCatalog
from matchlog.sources.schema import PLAYERS

KEYS = ("game_id", "winner")


def feature_tables(
    log: DataFrame,
    catalog: UnitCatalog,
    maps: DataFrame,
    last_rows: int = camera.LAST_ROWS,
    block_rows: int = ordered.BLOCK_ROWS,
    map_count: int = ability.MAPS,
    games: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The feature tables by name, each with one row per game; ``games`` lists those of the log
    with their label, whatever events they have.

    Positions are parsed once and kept as a narrow table for the three tables made of them.
    ``map_count`` is the number of map columns, the ``k`` of fitted map detection; ``games``
    the games with their labels, where they are known already.
    """
    moves = materialize(camera.points(log))
    return {
        "games": labelled_games(log) if games is None else games,
        "unit_counts": units.unit_counts_dense(log, catalog, block_rows=block_rows),
        "ability": ability.game_rows(
            log, catalog.frame(log.sparkSession), maps, map_count
        ).drop("winner"),
        "camera_homeaway": camera.home_away(moves, last_rows, block_rows),
        "camera_center_moves": camera.center_drift(moves),
        "user_activity": actions.agility(log),
        "camera_moving_stats": camera.step_stats(moves, block_rows=block_rows),
        "attack_units": actions.attack_strength(log, catalog, block_rows),
    }


def labelled_games(log: DataFrame) -> DataFrame:
    """Every game with its result, null where the log has none."""
    return log.groupBy("game_id").agg(F.max("winner").alias("winner"))


def minute_columns() -> list[str]:
    """Per-minute columns, left out of the final matrix."""
    minutes = range(camera.MINUTES)
    cells = [
        shaping.player_cells(minutes, "p{p}_center_{m}"),
        shaping.player_cells(minutes, "p{p}_actions_{m}"),
        shaping.player_cells(minutes, "cam_moving_p{p}_mean{m}"),
        shaping.player_cells(minutes, "cam_moving_p{p}_std{m}"),
    ]
    return [n for c in cells for n in c.values()] + [
        n for n in actions.ATTACK_COLUMNS if n.startswith("attack_units_")
    ]


def join_tables(tables: dict[str, DataFrame], extra: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Every game of the log or of the unit counts with all tables; missing features become 0.

    ``extra`` takes further tables that come ready-made. The label is never filled; it comes
    with ``games``, so a game needs no events of a certain type to have one.
    """
    others = [t for n, t in tables.items() if n not in ("games", "unit_counts")]
    spine = tables["games"].join(tables["unit_counts"], "game_id", "full")
    joined = shaping.star_join(spine, [*others, *extra])
    return scalar.fill_features(joined, KEYS)


def final_matrix(
    tables: dict[str, DataFrame],
    catalog: UnitCatalog,
    extra: tuple[DataFrame, ...] = (),
    labeled: bool = True,
) -> DataFrame:
    """Joined features with action totals, without per-minute and unit columns.

    A training matrix keeps labelled games only; pass ``labeled=False`` to keep all.
    """
    wide = actions.agility_totals(join_tables(tables, extra))
    narrow = wide.drop(*minute_columns(), *units.unit_columns(catalog))
    return narrow.where(F.col("winner").isNotNull()) if labeled else narrow


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEYS]


def ratio_features(df: DataFrame) -> DataFrame:
    """Player 0's share of each ability count and cost."""
    return df.select(
        "game_id",
        *[
            scalar.share(F.col(f"{c}_0"), F.col(f"{c}_1")).alias(f"{c.removesuffix('_sum')}_ratio")
            for c in (*ability.COUNTS, *ability.COSTS)
        ],
    )


def slot_ratios(slots: DataFrame, k: int) -> DataFrame:
    """Player 0's share of each unit slot."""
    return slots.select(
        "game_id",
        *[scalar.share(F.col(f"p0_u{i}"), F.col(f"p1_u{i}")).alias(f"u{i}_ratio") for i in range(k)],
    )


def near_ratios(near: DataFrame, stem: str = "") -> DataFrame:
    """Each player's share of positions near their own base, from ready-made counts.

    ``stem`` is "" for camera counts and "click_" for right clicks.
    """
    return near.select(
        "game_id",
        *[
            scalar.share(
                F.col(f"player{p}_{stem}near{p}"), F.col(f"player{p}_{stem}near{1 - p}")
            ).alias(f"player{p}_{stem}ratio")
            for p in PLAYERS
        ],
    )
