"""Block-wise operators equal the plain ones, whatever the block size and row order."""

import os
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlog.operators import ordered
from matchlog.session import discard, materialize


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    # one key holds most rows
    data = [
        (rng.choice([0, 0, 0, 1, 2]), i * 3, rng.choice([None, 1, 2, 3, 4]), rng.randint(0, 9))
        for i in range(300)
    ]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k INT, seq BIGINT, v INT, w INT").cache()


@pytest.mark.parametrize("block_rows", [1, 7, 100, 10**9])
def test_with_previous(rows, block_rows):
    got = ordered.with_previous(rows, ["k"], ["v", "w"], block_rows=block_rows)
    w = Window.partitionBy("k").orderBy("seq")
    want = rows.select(
        "*", F.lag("v").over(w).alias("prev_v"), F.lag("w").over(w).alias("prev_w")
    )
    key = ["k", "seq"]
    assert got.select(want.columns).orderBy(key).collect() == want.orderBy(key).collect()


@pytest.mark.parametrize("block_rows", [1, 7, 100, 10**9])
@pytest.mark.parametrize("n", [1, 20, 10_000])
def test_mark_last(rows, block_rows, n):
    placed = ordered.with_block(rows, block_rows=block_rows)
    summary = placed.groupBy("k", ordered.BLOCK).agg(F.count(F.lit(1)).alias("n"))
    got = ordered.mark_last(placed, summary, ["k"], n).drop("n")
    w = Window.partitionBy("k").orderBy(F.desc("seq"))
    want = rows.select("k", "seq", (F.row_number().over(w) <= n).alias("is_last"))
    key = ["k", "seq"]
    assert got.select(want.columns).orderBy(key).collect() == want.orderBy(key).collect()


@pytest.mark.parametrize("fine", [1, 3, 64, 10**6])
@pytest.mark.parametrize("n", [1, 2, 50])
def test_last_from_over_run_sizes(rows, fine, n):
    placed = ordered.with_block(rows, block_rows=100)
    got = {r.k: r["_from"] for r in ordered.last_from(placed, ["k"], n, fine=fine).collect()}
    seqs = {}
    for r in rows.collect():
        seqs.setdefault(r.k, []).append(r.seq)
    assert got == {k: sorted(v)[-n] for k, v in seqs.items() if len(v) > n}


def test_last_rows_are_marked_without_sorting_rows(spark, rows):
    placed = ordered.with_block(rows, block_rows=100).repartition("k", ordered.BLOCK)
    summary = placed.groupBy("k", ordered.BLOCK).agg(F.min("v").alias("least"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ordered.mark_last(placed, summary, ["k"], 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sorts = re.findall(r"Sort \[(.*?)\]", plan)
    assert sorts and not any("seq" in s for s in sorts)
    assert "SortMergeJoin [k#" not in "".join(line for line in plan.splitlines() if "_block" in line)


@pytest.mark.parametrize("low, high", [(0, 0), (0, 25), (7, 31), (10, 19)])
def test_id_grid(spark, low, high):
    bounds = spark.createDataFrame([(low, high)], "lo INT, hi INT")
    got = ordered.id_grid(bounds, "lo", "hi", "g", stretch=10)
    assert sorted(r.g for r in got.collect()) == list(range(low, high + 1))


def test_id_grid_of_nothing(spark):
    bounds = spark.createDataFrame([(None, None)], "lo INT, hi INT")
    assert ordered.id_grid(bounds, "lo", "hi", "g").count() == 0


def test_top_per_key(rows):
    top = ordered.top_per_key(rows, ["k"], [F.desc("w"), F.asc("seq")], 2, "place")
    assert top.groupBy("k").count().where("count > 2").count() == 0
    assert top.where("place = 1 and k = 0").first().w == rows.where("k = 0").agg(
        F.max("w")
    ).first()[0]


def test_rank_filter_is_cut_before_the_shuffle(rows):
    plan = ordered.top_per_key(rows, ["k"], [F.asc("seq")], 2, "place")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text


def test_exact_rank_splits_large_keys_and_ties(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 5}", (i * 37) % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, v int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.exact_rank(materialize(df), ["key"], [F.col("v")], "at", "n", split_ties=True).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(((r.key, r.v) for r in got), key=str) == sorted(rows, key=str)
    for key in {k for k, _ in rows}:
        mine = sorted((r.at, r.v, r.n) for r in got if r.key == key)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert [m[1] for m in mine] == sorted(m[1] for m in mine)
        assert {m[2] for m in mine} == {len(mine)}


def test_exact_rank_without_keys_or_rows(spark):
    df = spark.range(1000).withColumn("v", -F.col("id"))
    got = ordered.exact_rank(df, [], [F.col("v")], "at").collect()
    assert all(r["at"] == 1000 - r.id for r in got) and len(got) == 1000
    assert ordered.exact_rank(df.where("id < 0"), [], [F.col("v")], "at", "n").count() == 0


def test_discard_deletes_only_materialised_tables(spark, tmp_path):
    kept = str(tmp_path / "kept")
    spark.range(3).write.parquet(kept)
    discard(spark.read.parquet(kept))
    assert spark.read.parquet(kept).count() == 3
    table = materialize(spark.range(3))
    path = table.inputFiles()[0].removeprefix("file://")
    discard(table)
    assert not os.path.exists(path)
