import pytest
from pyspark.sql import functions as F

from matchlog.functions import scalar, text


@pytest.fixture(scope="module")
def parse(spark):
    def run(expr, *contents):
        df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i INT, c STRING")
        return [r.v for r in df.select("i", expr(F.col("c")).alias("v")).orderBy("i").collect()]

    return run


def test_coordinates(parse):
    texts = (
        "at (145.25, 21.5)",
        "Location: (12.0, 89.0, 10)",
        "at (1, 2); Location: (3, 4, 5)",
        "nothing here",
        "at (.5, 3)",
        "",
        None,
    )
    assert parse(lambda c: text.coordinate(c, 1), *texts) == [145, 12, 1, None, None, None, None]
    assert parse(lambda c: text.coordinate(c, 2), *texts) == [21, 89, 2, None, 3, None, None]


def test_target(parse):
    texts = ("Target: Zealot [3F1]; Location: (12.0, 89.0, 10)", "Location: (1.0, 2.0, 3)", "x")
    assert parse(lambda c: text.target_part(c, 1), *texts) == ["Zealot", None, None]
    assert parse(lambda c: text.target_part(c, 2), *texts) == ["3F1", None, None]
    assert parse(lambda c: text.target_part(c, 3), *texts) == ["12", "1", None]


def test_ability_name_and_location(parse):
    texts = (
        "(1360) - Attack; Location: (1.0, 2.0, 3)",
        "(7) - TrainMarine",
        "Stop",
        "(1) - a - b; Target: X [1]; Location: (5, 6, 7)",
    )
    assert parse(text.ability_name, *texts) == ["Attack", "TrainMarine", "Stop", "b"]
    assert parse(text.ability_location, *texts) == ["(1.0, 2.0, 3)", None, None, "(5, 6, 7)"]


def test_produced_units(parse):
    texts = (
        "(1) - TrainMarine",
        "(1) - TrainMarine, TrainGhost",
        "(1) - UpgradeToMothership",
        "(1) - MorphToGreaterSpire",
        "(1) - MorphToLurker",
        "(1) - BuildThor",
        "(1) - BuildBarracks",
        "(1) - ZealotWarpSelection",
        "(1) - WarpInZealot",
        "(1) - MorphToTransportOverlord",
        None,
    )
    assert parse(text.produced_units, *texts) == [
        "Marine",
        "Marine,Ghost",
        "UpgradeMothership",
        "",
        "Lurker",
        "Thor",
        "",
        "Zealot",
        "Zealot",
        "",
        "",
    ]


def test_first_produced(parse):
    texts = ("(1) - UpgradeToMothership", "(1) - BuildTrainMarine", "(1) - Build", "Stop")
    assert parse(text.first_produced, *texts) == ["Mothership", "Marine", "", None]


def test_coordinate_pair_agrees(parse):
    texts = (
        "at (145.25, 21.5)",
        "Location: (12.0, 89.0, 10)",
        "at (1, 2); Location: (3, 4, 5)",
        "at (.5, 3)",
        "at (4.5.6, 3.2.1 end)",
        "at (7, )",
        "at (7,\t8)",
        "at (-1, 2)",
        "at (1, 2",
        "rat (5, 6)",
        "(9, 9)",
        None,
    )
    for axis in (1, 2):
        pair = parse(lambda c: text.pair_part(text.coordinate_pair(c), axis), *texts)
        assert pair == parse(lambda c: text.coordinate(c, axis), *texts)


def test_mentions(parse):
    texts = ("Marine [A1], SiegeTankSieged [B2]", " [C3]", "Marine [a1]", "Big Rock [D4]", None)

    def pairs(c):
        return F.transform(
            text.mentions(c), lambda m: F.struct(text.mention_name(m), text.mention_id(m))
        )

    got = parse(pairs, *texts)
    assert [None if m is None else [tuple(x) for x in m] for m in got] == [
        [("Marine", "A1"), ("SiegeTankSieged", "B2")],
        [("", "C3")],
        [],
        [("Rock", "D4")],
        None,
    ]
    assert parse(text.unit_stance_removed, "SiegeTankSieged", "LurkerBurrowed", "Roach") == [
        "SiegeTank",
        "Lurker",
        "Roach",
    ]


def test_start_coordinate(parse):
    texts = ("at (145.25, 21.5)", "no parentheses", "at (x, 2)")
    assert parse(lambda c: text.start_coordinate(c, 1), *texts) == [145.25, None, None]
    assert parse(lambda c: text.start_coordinate(c, 2), *texts) == [21.5, None, 2.0]


def test_words_are_counted_once_each(parse):
    words = (*text.UPGRADE_WORDS, text.EVOLVE_WORD)
    assert parse(lambda c: text.has_word(c, words), "ResearchUpgrade", "EvolveX", "Evlove") == [
        2,
        0,
        1,
    ]


def test_scalars(spark):
    df = spark.createDataFrame([(3, 0), (0, 0), (1, 4)], "a INT, b INT")
    got = df.select(
        scalar.float_ratio(F.col("a"), F.col("b")), scalar.share(F.col("a"), F.col("b"))
    ).collect()
    assert [r[0] for r in got] == [float("inf"), None, 0.25]
    assert [round(r[1], 6) for r in got] == [1.0, 0.0, 0.2]
    df = spark.createDataFrame([("T",), ("X",), (None,)], "s STRING")
    codes = [r[0] for r in df.select(scalar.species_code(F.col("s"))).collect()]
    assert codes == [1, 0, 0]
    flags = df.select(*scalar.one_hot(F.col("s"), "TPZ", "is_{}")).collect()
    assert [tuple(r) for r in flags] == [(1, 0, 0), (0, 0, 0), (0, 0, 0)]
    odd = spark.createDataFrame([(1, 2)], ["0_Right Click", "a.b-c"])
    assert scalar.plain_names(odd).columns == ["0_Right_Click", "a_b_c"]
    part = spark.createDataFrame([(1, 2.0)], "game_id INT, x DOUBLE")
    assert scalar.conform(part, ["game_id", "y", "x"]).collect()[0] == (1, 0.0, 2.0)
    nulls = spark.createDataFrame([(1, None, None)], "game_id INT, winner INT, x DOUBLE")
    assert scalar.fill_features(nulls, ("game_id", "winner")).collect()[0] == (1, None, 0.0)
