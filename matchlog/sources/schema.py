"""Schemas and fixed names of the match-log data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The eight event types of the log.
EVENTS = (
    "Ability",
    "AddToControlGroup",
    "Camera",
    "ControlGroup",
    "GetControlGroup",
    "Right Click",
    "Selection",
    "SetControlGroup",
)

# Species codes and worker units.
SPECIES = ("T", "P", "Z")
WORKERS = ("SCV", "Drone", "Probe")

PLAYERS = (0, 1)

# One row per player action. ``seq`` is the position of the row in its source.
LOG = T.StructType(
    [
        T.StructField("game_id", T.IntegerType()),
        T.StructField("winner", T.IntegerType()),
        T.StructField("time", T.DoubleType()),
        T.StructField("player", T.IntegerType()),
        T.StructField("species", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("event_contents", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)

UNIT_INFO = T.StructType(
    [
        T.StructField("unit", T.StringType()),
        T.StructField("species", T.StringType()),
        T.StructField("supply", T.DoubleType()),
        T.StructField("minerals", T.DoubleType()),
        T.StructField("gas", T.DoubleType()),
    ]
)

MAP_DATA = T.StructType(
    [
        T.StructField("game_id", T.IntegerType()),
        T.StructField("player0_starting", T.IntegerType()),
        T.StructField("player1_starting", T.IntegerType()),
        T.StructField("map", T.IntegerType()),
    ]
)


def csv_schema(columns: list[str]) -> T.StructType:
    """The log schema for a CSV whose header lists ``columns`` (a test file has no winner)."""
    known = {f.name: f for f in LOG.fields if f.name != "seq"}
    return T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in columns])
