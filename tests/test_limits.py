"""Nothing is lost without a word where a number or name goes past the usual ones."""

import pytest
from pyspark.sql import functions as F

from matchlog.operators import shaping
from matchlog.plans import ability, actions
from matchlog.sources import readers, sample

FOLDER = "/root/testdata/sf0.001"


def test_maps_beyond_the_usual_seven(spark):
    games = spark.range(9).select(F.col("id").cast("int").alias("map"))
    flags = games.select("map", *ability.map_flags(F.col("map"), 9)).collect()
    assert all(row[f"map_{m}"] == int(m == row.map) for row in flags for m in range(9))
    with pytest.raises(Exception, match="no column for map"):
        games.select(*ability.map_flags(F.col("map"), 7)).collect()


def test_cells_beyond_a_thousand(spark):
    rows = spark.createDataFrame([(1, 0, 1200), (1, 1, 200), (1, 1, 200)], "game_id int, player int, slice int")
    names = shaping.player_cells(range(1500), "p{p}_u{m}")
    assert len(names) == 3000
    cells = {k: v for k, v in names.items() if v in ("p0_u1200", "p1_u200", "p0_u200")}
    row = shaping.spread(rows, shaping.player_cell(), cells, {"n": F.count("slice")}).first()
    assert (row.p0_u1200, row.p1_u200, row.p0_u200) == (1, 2, None)


def test_unknown_event_fails(make_log):
    log = make_log([(1, 0, 0.1, "Camera", "at (1.0, 2.0)"), (1, 1, 0.2, "Warp", None)])
    with pytest.raises(Exception, match="unknown event type Warp"):
        actions.event_counts(log).collect()


def test_joined_logs_keep_their_order(spark, tmp_path):
    logs = []
    for name, first in (("train", 0), ("test", 100)):
        lines = "".join(f"{first + i},0.5,1,Z,Camera,\n" for i in range(50))
        (tmp_path / f"{name}.csv").write_text("game_id,time,player,species,event,event_contents\n" + lines)
        logs.append(readers.read_log_csv(spark, str(tmp_path / f"{name}.csv")))
    both = readers.union_logs(*logs)
    games = [r.game_id for r in readers.first_rows(both, 100).collect()]
    assert games == [*range(50), *range(100, 150)]
    assert both.select("seq").distinct().count() == 100


def test_quoted_header(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('"game_id","a,b"\n1,2\n')
    assert readers.csv_header(spark, str(path)) == ["game_id", "a,b"]


def test_events_reach_the_scan(spark):
    log = sample.match_log(spark, FOLDER, "Ability")
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan
    assert log.count() == sample.match_log(spark, FOLDER).where("event = 'Ability'").count()
