import os
import re
import time

import pytest
from pyspark.sql import functions as F

from matchlog.operators import shaping
from matchlog.plans import explore
from matchlog.session import materialize, shared_folder
from matchlog.sources import readers, sample, sinks
from matchlog.sources.schema import LOG

FOLDER = "/root/testdata/sf0.001"


def test_csv_order_becomes_seq(spark, tmp_path):
    """Splits are packed out of file order, yet seq follows the file."""
    path = tmp_path / "train.csv"
    lines = ["game_id,winner,time,player,species,event,event_contents"]
    lines += [f'{i},1,{i / 7},{i % 2},T,Camera,"at ({i}, 2)"' for i in range(2000)]
    path.write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        starts = spark.read.text(str(path)).select("_metadata.file_block_start").distinct()
        assert starts.count() > 3
        log = readers.read_log_csv(spark, str(path))
        rows = log.select("seq", "game_id").collect()
        assert log.columns == LOG.names
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 2000 and all(r.seq == r.game_id for r in rows)


def test_ingest_writes_the_rows_once_and_keeps_their_order(spark, tmp_path):
    """Cut into many splits, the log is written to its table and nowhere else."""
    path, table = tmp_path / "train.csv", str(tmp_path / "log")
    events = ["Camera", "Ability", "Selection"]
    lines = ["game_id,winner,time,player,species,event,event_contents"]
    lines += [f'{i},1,{i / 7},{i % 2},T,{events[i % 3]},"at ({i}, 2)"' for i in range(3000)]
    path.write_text("\n".join(lines) + "\n")
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        assert spark.read.text(str(path)).select("_metadata.file_block_start").distinct().count() > 5
        sinks.ingest_csv(spark, str(path), table)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert set(os.listdir(folder)) == before
    assert spark.read.parquet(f"{table}/rows").count() == 3000
    assert spark.read.parquet(f"{table}/splits").count() > 5
    log = readers.read_ingested(spark, table)
    assert log.columns == LOG.names
    assert sorted((r.seq, r.game_id) for r in log.collect()) == [(i, i) for i in range(3000)]
    some = readers.read_ingested(spark, table, "Ability")
    assert sorted(r.seq for r in some.collect()) == list(range(1, 3000, 3))
    plan = re.sub(r"#\d+", "", some._jdf.queryExecution().executedPlan().toString())
    assert re.search(r"PartitionFilters: \[isnotnull\(event\), \(event = Ability\)|PartitionFilters: \[event IN \(Ability\)|PartitionFilters: \[.*event = Ability", plan)


def scanned_rows(df):
    """Rows that the scans of a collected frame put out."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_first_rows_read_a_bounded_part(spark, tmp_path):
    path = str(tmp_path / "log")
    (
        spark.range(200_000).select(F.col("id").alias("seq"), (F.col("id") % 100).alias("event"))
        .coalesce(1).write.option("parquet.block.size", 1 << 16).option("parquet.page.row.count.limit", 1000).parquet(path)
    )
    log = spark.read.parquet(path)
    first = readers.first_rows(log, 100)
    assert [r.seq for r in first.collect()] == list(range(100))
    assert scanned_rows(first) < 20_000
    # a filtered log, of which every hundredth row is left, and fewer rows than asked for
    some = readers.first_rows(log.where("event = 7"), 50)
    assert [r.seq for r in some.collect()] == [7 + 100 * i for i in range(50)]
    assert scanned_rows(some) < 40_000
    late = readers.first_rows(log.where("seq >= 199990"), 100)
    assert [r.seq for r in late.collect()] == list(range(199_990, 200_000))
    assert readers.first_rows(log.where("seq < 0"), 10).count() == 0
    assert readers.first_rows(log, 0).count() == 0


def test_saved_features_join_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "features")
    games = spark.range(500).select(F.col("id").cast("int").alias("game_id"))
    tables = {
        "games": games.withColumn("winner", F.col("game_id") % 2),
        "one": games.where("game_id % 3 = 0").withColumn("a b", F.col("game_id") * 2),
        "two": games.where("game_id % 5 = 0").withColumn("c", F.col("game_id") * 0.5),
    }
    sinks.save_features(tables, path, buckets=4)
    loaded = readers.load_features(spark, path)
    assert list(loaded) == list(tables)
    for name, table in tables.items():
        assert loaded[name].columns == table.columns
        assert loaded[name].exceptAll(table).count() == 0 and loaded[name].count() == table.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = shaping.star_join(loaded["games"], [loaded["one"], loaded["two"]])
        computed = shaping.star_join(tables["games"], [tables["one"], tables["two"]])
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (joined, computed)]
        assert "Exchange" not in plans[0] and "Exchange" in plans[1]
        assert plans[0].count("SortMergeJoin") == 2
        assert joined.exceptAll(computed).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert list(readers.load_features(spark, path, "two")) == ["two"]
    with pytest.raises(KeyError, match="three"):
        readers.load_features(spark, path, "three")


def test_test_csv_has_no_winner(spark, tmp_path):
    path = tmp_path / "test.csv"
    path.write_text("game_id,time,player,species,event,event_contents\n7,0.5,1,Z,Camera,\n")
    row = readers.read_log_csv(spark, str(path)).first()
    assert (row.game_id, row.winner, row.event_contents, row.seq) == (7, None, None, 0)
    train = sample.match_log(spark, FOLDER)
    both = readers.union_logs(train, readers.read_log_csv(spark, str(path)))
    assert both.count() == train.count() + 1 and "winner" not in both.columns


def test_event_partitions_are_pruned(spark, tmp_path):
    log = sample.match_log(spark, FOLDER)
    sinks.write_by_event(log, str(tmp_path / "log"), rows_per_file=300)
    back = readers.read_log(spark, str(tmp_path / "log"))
    assert back.count() == log.count()
    some = readers.read_log(spark, str(tmp_path / "log"), "Ability", "Camera")
    assert some.count() == log.where("event in ('Ability', 'Camera')").count()
    plan = re.sub(r"#\d+", "", some._jdf.queryExecution().executedPlan().toString())
    assert "PartitionFilters: [event IN (Ability,Camera)]" in plan


def test_tables_and_chunks(spark, tmp_path):
    df = spark.range(0, 2500).select(F.col("id").cast("int").alias("game_id"))
    sinks.write_table(df, str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2500
    path = str(tmp_path / "chunks")
    sinks.write_by_game_chunk(df, path)
    # a rerun of one range leaves the others alone
    sinks.write_by_game_chunk(df.where("game_id between 1000 and 1499"), path)
    assert readers.load_chunks(spark, path).count() == 2000
    assert sinks.save_relation(df, str(tmp_path / "kept")).count() == 2500


def test_repeated_headers(spark, tmp_path):
    path = tmp_path / "units.csv"
    path.write_text("game_id,Adept,Zealot,Adept,Zealot\n3,1,2,4,8\n")
    row = readers.read_repeated_headers(spark, str(path)).first()
    assert row.asDict() == {
        "game_id": 3, "p0_Adept": 1, "p0_Zealot": 2, "p1_Adept": 4, "p1_Zealot": 8,
    }


def test_unit_csv(spark, tmp_path):
    path = tmp_path / "unit_info.csv"
    path.write_text("unit,species,supply,minerals,gas\nZergling,Z,0.5,25,0\n")
    catalog = readers.UnitCatalog.read_csv(spark, str(path))
    assert [tuple(r) for r in catalog.frame(spark).collect()] == [("Zergling", "Z", 0.5, 25.0, 0.0)]


def test_exported_column(spark, tmp_path):
    parsed = explore.parsed_abilities(sample.match_log(spark, FOLDER))
    sinks.export_column(parsed, "location", str(tmp_path / "loc"))
    back = spark.read.csv(str(tmp_path / "loc"), header=True)
    assert back.columns == ["location"] and back.count() == parsed.where("location is not null").count()


def test_samples_and_spines(spark):
    log = sample.match_log(spark, FOLDER)
    assert [r.seq for r in readers.first_rows(log, 5).collect()] == [0, 1, 2, 3, 4]
    assert {r.game_id for r in readers.game_range(log, 3, 4).select("game_id").collect()} == {3, 4}
    spine = readers.game_spine(log)
    told = spark.createDataFrame([(3, 0.9)], "game_id INT, winner DOUBLE")
    answers = {r.game_id: r.winner for r in shaping.answer_spine(spine, told).collect()}
    assert answers[3] == 0.9 and answers[4] == 0.5 and len(answers) == spine.count()


def test_sample_log_does_not_depend_on_the_session_zone(spark):
    want = sample.match_log(spark, FOLDER).agg(F.sum("time")).first()[0]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
    try:
        assert sample.match_log(spark, FOLDER).agg(F.sum("time")).first()[0] == pytest.approx(want)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_shuffles_of_a_write_can_go_with_it(spark):
    """Their files are deleted as the write ends, though the frame is still held."""

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in found.mkString("\n").split("\n") if "/shuffle_" in f}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(name)
    dealt = spark.range(50_000).repartition(7, "id")
    table = materialize(dealt, keep_shuffles=False)
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(name) == setting
    assert table.count() == dealt.count() == 50_000
    materialize(dealt)
    assert not files() <= before
