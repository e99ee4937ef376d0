"""Unit ownership against a row-by-row state machine."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchlog.operators import ordered
from matchlog.plans import units
from matchlog.sources.readers import UnitCatalog
from matchlog.sources.sample import UNITS
from matchlog.sources.schema import LOG, WORKERS

SPECIES = {u: s for u, s, *_ in UNITS.rows}
NAMES = ["Marine", "SiegeTankSieged", "Zealot", "Roach", "LurkerBurrowed", "SCV", "Rock", ""]


def random_selections(spark, seed, games=4, rows=150, ids=6):
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        game, player = rng.choice([0, 0, 0, *range(games)]), rng.randint(0, 1)
        species = "TPZ"[(game + player) % 3]
        picked = ", ".join(
            f"{rng.choice(NAMES)} [{rng.randint(0, ids - 1)}]" for _ in range(rng.randint(1, 4))
        )
        data.append((game, 0, float(i), player, species, "Selection", picked, i * 2))
    shuffled = data[:]
    rng.shuffle(shuffled)
    return spark.createDataFrame(shuffled, LOG), data


def said(row):
    for part in row[6].split(", "):
        name, unit_id = part.split(" [")
        yield name, unit_id.rstrip("]")


def owned_by_walking(data):
    held = {}
    for row in data:
        game, player, species = row[0], row[3], row[4]
        for name, unit_id in said(row):
            unit = name.replace("Sieged", "").replace("Burrowed", "")
            if not unit or unit in WORKERS or unit not in SPECIES:
                continue
            if (game, 1 - player, unit_id) in held:
                continue
            side = player if SPECIES[unit] == species else 1 - player
            held[game, side, unit_id] = unit
    return held


@pytest.mark.parametrize("block_rows", [1, 10, 60, 10**6])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ownership(spark, seed, block_rows):
    log, data = random_selections(spark, seed)
    got = {
        (r.game_id, r.player, r.unit_id): r.unit
        for r in units.ownership(log, UNITS, block_rows).collect()
    }
    assert got == owned_by_walking(data)


def test_ownership_cases(make_log, spark):
    log = make_log(
        [
            (0, 0, 0, "Selection", "Marine [A]"),  # native: player 0 owns A
            (0, 1, 1, "Selection", "Marine [A]"),  # the other player's claim is ignored
            (0, 0, 2, "Selection", "SiegeTank [A]"),  # the owner renames
            (0, 0, 3, "Selection", "Zealot [A]"),  # the owner calls it foreign: both hold it
            (0, 0, 4, "Selection", "Marine [A]"),  # settled now
            (0, 0, 5, "Selection", "Zealot [B]"),  # foreign first: player 1 owns B
            (0, 0, 6, "Selection", "Rock [C]"),  # unknown
            (0, 0, 7, "Selection", "SCV [D]"),  # worker
        ]
    )
    got = sorted(tuple(r) for r in units.ownership(log, UNITS).collect())
    assert got == [(0, 0, "A", "SiegeTank"), (0, 1, "A", "Zealot"), (0, 1, "B", "Zealot")]


def test_dense_counts_cover_every_id(make_log):
    log = make_log([(3, 0, 0, "Selection", "Marine [A], Marine [B]")])
    rows = units.unit_counts_dense(log, UNITS).orderBy("game_id").collect()
    assert [r.game_id for r in rows] == [0, 1, 2, 3]
    assert [r.p0_Marine for r in rows] == [0, 0, 0, 2]
    assert units.unit_counts_dense(log, UNITS, from_zero=False).count() == 1


@pytest.mark.parametrize("seed", [4, 5])
def test_first_claims(spark, seed):
    log, data = random_selections(spark, seed)
    held, claimed, freq = {}, {}, Counter()
    for row in data:
        game, player, species = row[0], row[3], row[4]
        for name, unit_id in said(row):
            if name and (game, 1 - player, unit_id) not in held:
                claimed.setdefault((game, player, unit_id), len(claimed))
                held[game, player, unit_id] = name
                freq[species, name] += 1
    accepted = units.first_claims(log).cache()
    got = {
        (r.game_id, r.player, r.unit_id): r.name for r in units.holdings(accepted).collect()
    }
    assert got == held
    ranked = units.name_frequency(accepted)
    assert {(r.species, r.name): r.mentions for r in ranked.collect()} == freq
    top = {(r.species, r.name) for r in units.top_names(ranked, 2).collect()}
    rare = {(r.species, r.name) for r in units.rare_names(ranked, 2).collect()}
    assert not top & rare and top | rare == set(freq)

    neutral = {n for _, n in freq if all((s, n) in freq for s in "TPZ")}
    assert {r.name for r in units.neutral_names(ranked).collect()} == neutral
    last = {}
    for key, name in held.items():
        if name in neutral:
            last[key[0], key[1], name] = max(
                last.get((key[0], key[1], name), key), key, key=claimed.get
            )
    left = units.without_neutral(units.holdings(accepted), units.neutral_names(ranked))
    assert {(r.game_id, r.player, r.unit_id) for r in left.collect()} == set(held) - set(
        last.values()
    )
    bare = units.without_neutral(units.holdings(accepted), units.neutral_names(ranked), True)
    assert {r.name for r in bare.collect()}.isdisjoint(neutral)


def test_slots_use_ranks_of_another_log(make_log, spark):
    log = make_log([(5, 0, 0, "Selection", "Marine [A], Marine [B], Ghost [C]")])
    ranks = spark.createDataFrame(
        [("T", "Ghost", 1), ("T", "Marine", 2)], "species STRING, name STRING, place INT"
    )
    row = units.top_slots(log, units.first_claims(log), 2, ranks).first()
    assert (row.p0_u0, row.p0_u1, row.p1_u0, row.p1_u1) == (1, 2, 0, 0)


def test_roster(make_log):
    log = make_log(
        [
            (0, 0, 0, "Selection", "Marine [B], SiegeTank [A]"),
            (0, 1, 1, "Selection", "Zealot [C]"),
        ]
    )
    rows = units.roster(log, units.ownership(log, UNITS), spread=1).orderBy("position").collect()
    assert [(r.unit_0, r.unit_1) for r in rows] == [("SiegeTank", "Zealot"), ("Marine", None)]
    assert (rows[0].head_0, rows[0].head_1) == ("T (False)", "P (True)")


def test_roster_of_ids_with_one_prefix_spreads_over_tasks(spark, make_log):
    """Ids that share their first characters still end up in many partitions."""
    log = make_log([(0, 0, 0, "Selection", "Marine [B]"), (0, 1, 1, "Selection", "Zealot [C]")])
    owned = spark.range(2000).select(
        F.lit(0).alias("game_id"), F.lit(0).alias("player"),
        F.format_string("SAMEPREFIX%05d", "id").alias("unit_id"), F.lit("Marine").alias("unit"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = ordered.exact_rank(owned, ["game_id", "player"], [F.col("unit_id")])
        files = len(set(ranked.inputFiles()))
        got = units.roster(log, owned, spread=100).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files >= 6
    assert sorted(r.position for r in got) == list(range(1, 2001))
    assert {r.head_0 for r in got} == {"T (False)"}


def test_catalog(spark):
    assert UNITS.units == sorted(SPECIES)
    loaded = UnitCatalog.load(UNITS.frame(spark))
    assert loaded.units == UNITS.units
    assert loaded.frame(spark).exceptAll(UNITS.frame(spark)).count() == 0
    plain, table = (sorted(map(tuple, c.dictionary(spark).collect())) for c in (UNITS, loaded))
    assert plain == table and [r[1] for r in plain] == list(range(len(SPECIES)))
    found = {r[0]: (r[2], r[3]) for r in plain}
    assert found["Roach"] == (["Z"], 2.0) and found["SCV"] == (["T"], None)


def test_catalog_of_any_size(spark):
    """A large table is never brought to the driver and has a number for every name."""
    big = spark.range(30_000).select(
        F.format_string("unit%05d", F.col("id") % 25_000).alias("unit"),
        F.when(F.col("id") < 25_000, "T").otherwise("Z").alias("species"),
        F.col("id").cast("double").alias("supply"),
        *[F.lit(0.0).alias(c) for c in ("minerals", "gas")],
    )
    words = UnitCatalog.load(big).dictionary(spark)
    assert words.agg(F.count_distinct("code"), F.max("code")).first() == (25_000, 24_999)
    first = words.where("unit = 'unit00003'").first()
    assert (first.code, first.owners, first.supply) == (3, ["T", "Z"], 25_003.0)


def test_ownership_needs_no_sorted_aggregate(make_log):
    log = make_log([(0, 0, 0, "Selection", "Marine [B]")])
    plan = units.owned_codes(log, UNITS)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_too_long_a_list_is_refused(spark):
    row = spark.range(1).select(units._mention_order(F.lit(1), F.lit(1 << 20)))
    with pytest.raises(Exception, match="does not fit"):
        row.collect()
