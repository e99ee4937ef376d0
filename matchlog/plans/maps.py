"""Start positions, and the map a game was played on."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlog.functions import scalar, text
from matchlog.session import materialize
from matchlog.sources.schema import PLAYERS

STARTS = 15
RADIUS = 5.0
SUPPORT = 100
NO_THIRD = 999


def start_positions(log: DataFrame, games: DataFrame | None = None) -> DataFrame:
    """First camera position of both players for every game, null where there is none.

    ``games`` lists the games where that is known already; else the log is read for it.
    """
    camera = log.where(F.col("event") == "Camera")
    firsts = camera.groupBy("game_id").agg(
        *[
            F.min_by(
                text.start_coordinate(F.col("event_contents"), i),
                F.when(F.col("player") == p, F.col("seq")),
            ).alias(f"player{p}_{axis}")
            for p in PLAYERS
            for i, axis in ((1, "x"), (2, "y"))
        ]
    )
    # payloads are read for camera rows only, game ids for all
    games = log.select("game_id").distinct() if games is None else games.select("game_id")
    return games.join(firsts, "game_id", "left")


def start_points(positions: DataFrame) -> DataFrame:
    """Both players' positions under each other, unknown ones left out."""
    sides = [
        positions.select(
            "game_id",
            F.lit(p).alias("player"),
            F.col(f"player{p}_x").alias("location_x"),
            F.col(f"player{p}_y").alias("location_y"),
        )
        for p in PLAYERS
    ]
    return sides[0].unionByName(sides[1]).dropna()


def fit_centres(
    points: DataFrame, k: int = STARTS, seed: int = 7
) -> tuple[KMeansModel, list[tuple[float, float]]]:
    """Cluster the start points; centres come back ordered by (x, y)."""
    assembled = VectorAssembler(
        inputCols=["location_x", "location_y"], outputCol="features"
    ).transform(points)
    model = KMeans(k=k, seed=seed).fit(assembled)
    return model, sorted((float(c[0]), float(c[1])) for c in model.clusterCenters())


def _nearest(x: Column, y: Column, centres: list[tuple[float, float]]) -> Column:
    """(distance, number from 1) of the nearest centre; null without a position."""
    options = [
        F.struct(
            scalar.distance(x, y, F.lit(cx), F.lit(cy)).alias("distance"),
            F.lit(i).alias("starting"),
        )
        for i, (cx, cy) in enumerate(centres, start=1)
    ]
    return F.when(x.isNotNull() & y.isNotNull(), F.array_min(F.array(*options)))


def _within(nearest: Column, radius: float) -> Column:
    return F.when(nearest["distance"] <= radius, nearest["starting"]).otherwise(0)


def assign_starts(
    points: DataFrame, centres: list[tuple[float, float]], radius: float = RADIUS
) -> DataFrame:
    """Number (from 1) of the nearest centre and its distance; 0 outside the radius."""
    near = _nearest(F.col("location_x"), F.col("location_y"), centres)
    return points.withColumn("_near", near).select(
        *points.columns,
        _within(F.col("_near"), radius).alias("starting"),
        F.col("_near.distance").alias("distance"),
    )


def game_starts(
    positions: DataFrame, centres: list[tuple[float, float]], radius: float = RADIUS
) -> DataFrame:
    """Start numbers of both players for every game, 0 where unknown or outside the radius."""
    return positions.select(
        "game_id",
        *[
            _within(
                _nearest(F.col(f"player{p}_x"), F.col(f"player{p}_y"), centres), radius
            ).alias(f"player{p}_starting")
            for p in PLAYERS
        ],
    )


def map_table(games: DataFrame, support: int = SUPPORT) -> DataFrame:
    """The maps, as sorted triples of start numbers with a map number.

    A start's two most frequent opponents (counts below ``support`` rule out the second)
    make a triple; equal triples are one map. There are as many rows as starts at most.
    """
    pairs = (
        games.where(F.col("player0_starting") > 0)
        .groupBy("player0_starting", "player1_starting")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    start = Window.partitionBy("player0_starting").orderBy(F.desc("n"), "player1_starting")
    triples = (
        pairs.withColumn("place", F.row_number().over(start))
        .where(F.col("place") <= 2)
        .groupBy("player0_starting")
        .agg(
            F.max(F.when(F.col("place") == 1, F.col("player1_starting"))).alias("first"),
            F.max(
                F.when((F.col("place") == 2) & (F.col("n") >= support), F.col("player1_starting"))
            ).alias("second"),
        )
        .select(
            F.array_sort(
                F.array("player0_starting", "first", F.coalesce("second", F.lit(NO_THIRD)))
            ).alias("starts")
        )
        .distinct()
    )
    return triples.select(
        (F.row_number().over(Window.orderBy("starts")) - 1).alias("map"),
        *[F.get("starts", F.lit(i)).alias(f"m{i}") for i in range(3)],
    )


def _with_maps(games: DataFrame, maps: DataFrame) -> DataFrame:
    """Games with the whole map table, at most one row per start, as a scalar subquery."""
    rows = F.collect_list(F.struct("map", "m0", "m1", "m2"))
    return games.withColumn("_maps", maps.select(F.array_sort(rows)).scalar())


def resolve_games(games: DataFrame, maps: DataFrame) -> DataFrame:
    """Unknown starts inferred from the opponent's through the map table, and the map.

    Maps are tried in order. A start pairs with the first other one of its map, and the
    third start of a map with the second. A map may pair "unknown" (0) itself. The map
    number goes by player 0's start; the last map with that start wins.
    """

    def inferred(unknown: Column, known: Column, m: Column) -> Column:
        return (
            F.when(unknown != 0, unknown)
            .when((known == m["m0"]) | (known == m["m2"]), m["m1"])
            .when(known == m["m1"], m["m0"])
            .otherwise(unknown)
        )

    def step(acc: Column, m: Column) -> Column:
        p0 = inferred(acc["p0"], acc["p1"], m)
        return F.struct(p0.alias("p0"), inferred(acc["p1"], p0, m).alias("p1"))

    known = F.struct(F.col("player0_starting").alias("p0"), F.col("player1_starting").alias("p1"))
    done = _with_maps(games, maps).select(
        "game_id", "_maps", F.aggregate("_maps", known, step).alias("_s")
    )
    start = F.col("_s.p0")
    fitting = F.filter(
        "_maps", lambda m: (m["m0"] == start) | (m["m1"] == start) | (m["m2"] == start)
    )
    return done.select(
        "game_id",
        start.alias("player0_starting"),
        F.col("_s.p1").alias("player1_starting"),
        F.try_element_at(fitting, F.lit(-1))["map"].alias("map"),
    )


def unresolved(games: DataFrame) -> DataFrame:
    """Games with an unknown start left."""
    return games.where((F.col("player0_starting") == 0) | (F.col("player1_starting") == 0))


def map_data(
    log: DataFrame,
    centres: list[tuple[float, float]],
    radius: float = RADIUS,
    support: int = SUPPORT,
    games: DataFrame | None = None,
) -> DataFrame:
    """Start numbers and map of every game, for given start centres."""
    starts = game_starts(start_positions(log, games), centres, radius)
    return resolve_games(starts, map_table(starts, support))


def fitted_map_data(
    log: DataFrame,
    k: int = STARTS,
    radius: float = RADIUS,
    support: int = SUPPORT,
    seed: int = 7,
) -> DataFrame:
    """``map_data`` with centres clustered from the log itself, which is read once."""
    positions = materialize(start_positions(log))
    _, centres = fit_centres(start_points(positions), k, seed)
    starts = materialize(game_starts(positions, centres, radius))
    return resolve_games(starts, map_table(starts, support))


def unordered_start_key(positions: DataFrame) -> DataFrame:
    """Frequency of the four start coordinates, sorted and written as text."""
    four = [F.col(f"player{p}_{axis}") for p in PLAYERS for axis in ("x", "y")]
    key = F.concat_ws(", ", F.transform(F.array_sort(F.array(*four)), lambda v: v.cast("string")))
    return (
        positions.dropna()
        .select(key.alias("both_starting"))
        .groupBy("both_starting")
        .agg(F.count(F.lit(1)).alias("games"))
    )
