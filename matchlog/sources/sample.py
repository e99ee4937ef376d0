"""A match log derived from the generic ``events`` table, and a small unit catalogue.

The events table has no game payloads, so each event row becomes one action row with a
payload spelled from its value and property. One "minute" of game time is one day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlog.sources.readers import UnitCatalog

# Unit, species, supply, minerals, gas.
UNITS = UnitCatalog(
    (
        ("Marine", "T", 1.0, 50.0, 0.0),
        ("SiegeTank", "T", 3.0, 150.0, 125.0),
        ("SCV", "T", 1.0, 50.0, 0.0),
        ("Zealot", "P", 2.0, 100.0, 0.0),
        ("Stalker", "P", 2.0, 125.0, 50.0),
        ("UpgradeMothership", "P", 8.0, 400.0, 400.0),
        ("Zergling", "Z", 0.5, 25.0, 0.0),
        ("Roach", "Z", 2.0, 75.0, 25.0),
        ("Lurker", "Z", 3.0, 150.0, 150.0),
    )
)

# Start-position centres on the sample log, for the queries that need fixed ones.
CENTRES = ((15.0, 25.0), (15.0, 75.0), (50.0, 25.0), (50.0, 75.0), (110.0, 50.0))

_EVENT = """CASE event_type WHEN 'view' THEN 'Camera' WHEN 'click' THEN 'Right Click'
  WHEN 'purchase' THEN 'Ability' WHEN 'signup' THEN 'Selection' ELSE 'SetControlGroup' END"""

_CONTENTS = """CASE event_type
  WHEN 'view' THEN concat('at (', xi, '.25, ', k, '.5)')
  WHEN 'click' THEN concat('Location: (', xi, '.0, ', k, '.0, 10)')
  WHEN 'purchase' THEN concat('(', k, ') - ',
    CASE k % 8 WHEN 0 THEN 'TrainMarine' WHEN 1 THEN 'BuildSiegeTank' WHEN 2 THEN 'WarpInZealot'
      WHEN 3 THEN 'MorphToLurker' WHEN 4 THEN 'UpgradeToMothership' WHEN 5 THEN 'ResearchStim'
      ELSE 'Attack' END, '; Location: (', xi, '.0, ', k, '.0, 10)')
  WHEN 'signup' THEN concat(
    CASE k % 5 WHEN 0 THEN 'Marine' WHEN 1 THEN 'Zealot' WHEN 2 THEN 'Zergling' WHEN 3 THEN 'SCV'
      ELSE 'SiegeTankSieged' END, ' [A', k % 7, '], ',
    CASE xi % 4 WHEN 0 THEN 'Stalker' WHEN 1 THEN 'Roach' WHEN 2 THEN 'LurkerBurrowed'
      ELSE 'MineralField' END, ' [B', xi % 7, ']')
  END"""


_SOURCES = {"Camera": "view", "Right Click": "click", "Ability": "purchase", "Selection": "signup"}


def match_log(spark: SparkSession, sf_dir: str, *events: str) -> DataFrame:
    """The match log of one data folder, one row per event.

    ``events`` keeps those of these types, by a filter on the stored column that reaches the
    scan.
    """
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    if events:
        rows = rows.where(F.col("event_type").isin(*[_SOURCES[e] for e in events]))
    return (
        rows.selectExpr(
            "event_id",
            "user_id",
            "event_type",
            # the zone-less timestamp read as UTC, whatever the session zone is
            "unix_micros(from_utc_timestamp(CAST(ts AS TIMESTAMP), current_timezone())) AS us",
            "CAST(FLOOR(value) AS INT) AS xi",
            "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k",
        )
        .selectExpr(
            "CAST(user_id AS INT) AS game_id",
            "CAST(user_id % 2 AS INT) AS winner",
            "event_id AS seq",
            "(us - 1704067200000000) / 86400000000.0D AS time",
            "CAST(event_id % 2 AS INT) AS player",
            """CASE (user_id * 2 + event_id % 2) % 3
               WHEN 0 THEN 'T' WHEN 1 THEN 'P' ELSE 'Z' END AS species""",
            f"{_EVENT} AS event",
            f"{_CONTENTS} AS event_contents",
        )
    )


def with_targets(log: DataFrame) -> DataFrame:
    """The log with a target before every third row's location, as clicks on units have it;
    some names are ill-formed and name no target."""
    name = "CASE seq % 7 WHEN 0 THEN 'Lurker Den' WHEN 1 THEN '' WHEN 2 THEN 'SiegeTank' ELSE 'Zealot' END"
    target = f"concat('Target: ', {name}, ' [', hex(seq), CASE WHEN seq % 5 = 0 THEN 'x' ELSE '' END, ']; ')"
    clicked = F.expr("event = 'Right Click' AND seq % 3 = 0")
    contents = F.concat(F.expr(target), F.col("event_contents"))
    return log.withColumn("event_contents", F.when(clicked, contents).otherwise(F.col("event_contents")))
