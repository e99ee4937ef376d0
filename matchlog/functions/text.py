"""Payload parsers, as built-in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlog.sources.schema import WORKERS

# Payload patterns. Coordinates, target with coordinates, unit mentions,
# and the unit named by a production ability.
COORDINATES = r"(?:Location:|at)\s\(([0-9]*)[.0-9]*,\s([0-9]*)[.0-9]*.*?\)"
TARGET = (
    r"(?:Target:\s([A-Za-z]*)\s\[([0-9A-Z]*)\][\s;]*)?"
    r"Location:\s\(([0-9]*)[.0-9]*,\s([0-9]*)[.0-9]*.*?\)"
)
MENTIONS = r"([0-9A-Za-z]*)\s\[([0-9A-Z]*)\]"
# The first location again, x and y kept together in one group.
COORDINATE_PAIR = r"(?:Location:|at)\s\(([0-9]*[.0-9]*,\s[0-9]*)[.0-9]*.*?\)"
FIRST_PRODUCED = r"(?:Build|Train|Morph|Spawn|UpgradeTo|TransformTo|WarpIn)+([0-9A-Za-z]*)"

# Verb of each production family and the pattern of its abilities.
PRODUCTION_VERBS = (
    ("Train", r"Train[A-Za-z]*"),
    ("Build", r"BuildSiegeTank|BuildWidowMine|BuildHellion|BuildThor"),
    ("WarpIn", r"WarpIn[A-Za-z]*"),
    ("WarpSelection", r"[A-Za-z]*WarpSelection"),
    ("UpgradeTo", r"UpgradeToMothership"),
    ("Morph", r"Morph[A-Za-z]*"),
)

# Text removed from a produced unit's name, in this order, before the verb.
PRODUCTION_NOISE = (" ", "To", "GreaterSpire", "TransportOverlord")

# Word looked for in the ability name, per flag. The misspelt last research
# word is the compatible default; pass "Evolve" to count evolutions.
TRAIN_WORDS = ("Train", "Warp", "Morph")
BUILD_WORDS = ("Build",)
UPGRADE_WORDS = ("Upgrade", "Research")
EVOLVE_WORD = "Evlove"
ATTACK_WORDS = ("Attack",)


def coordinate_pair(contents: Column) -> Column:
    """The text "x, y" of the first location, y cut to its integer part; "" without one."""
    return F.regexp_extract(contents, COORDINATE_PAIR, 1)


def pair_part(pair: Column, axis: int) -> Column:
    """Integer part of x (axis 1) or y (axis 2) of a coordinate pair; null if there is none."""
    if axis == 1:
        return F.substring_index(F.substring_index(pair, ",", 1), ".", 1).try_cast("int")
    return F.substring_index(pair, ",", -1).try_cast("int")


def coordinate(contents: Column, axis: int) -> Column:
    """Integer part of x (axis 1) or y (axis 2) in the first location; null without one."""
    return F.regexp_extract(contents, COORDINATES, axis).try_cast("int")


def target_part(contents: Column, part: int) -> Column:
    """Part 1-4 (name, id, x, y) of the first targeted location; null when absent."""
    return F.nullif(F.regexp_extract(contents, TARGET, part), F.lit(""))


def ability_name(contents: Column) -> Column:
    """The name after the ability number, without the location."""
    return F.substring_index(F.substring_index(contents, ";", 1), "- ", -1)


def ability_location(contents: Column) -> Column:
    """The location text after the last semicolon; null if there is no semicolon."""
    last = F.substring_index(F.substring_index(contents, ";", -1), ": ", -1)
    return F.when(F.contains(contents, F.lit(";")), last)


def has_word(text: Column, words: tuple[str, ...]) -> Column:
    """How many of ``words`` occur in ``text`` (0 for null)."""
    hits = [F.coalesce(F.contains(text, F.lit(w)).cast("int"), F.lit(0)) for w in words]
    return reduce(lambda a, b: a + b, hits)


def produced_units(contents: Column) -> Column:
    """Unit names of a production ability.

    Each verb family contributes its hits, stripped of noise and of the verb; several hits
    of one family stay comma-joined, so they match no single unit.
    """

    def family(verb: str, pattern: str) -> Column:
        hits = F.array_join(F.regexp_extract_all(contents, F.lit(pattern), 0), ",")
        for noise in (*PRODUCTION_NOISE, verb):
            hits = F.replace(hits, F.lit(noise), F.lit(""))
        # every pattern holds its verb, so most texts need no regex
        return F.when(F.contains(contents, F.lit(verb)), hits).otherwise("")

    return F.concat(*[family(*v) for v in PRODUCTION_VERBS])


def first_produced(contents: Column) -> Column:
    """Name after the first production verb; null if there is none."""
    return F.when(
        F.rlike(contents, F.lit(FIRST_PRODUCED)), F.regexp_extract(contents, FIRST_PRODUCED, 1)
    )


def mentions(contents: Column) -> Column:
    """Array of the unit mentions ``Name [ID]`` in a selection, in order."""
    return F.regexp_extract_all(contents, F.lit(MENTIONS), 0)


def mention_name(mention: Column) -> Column:
    """The name before the bracket; may be empty."""
    return mention.substr(F.lit(1), F.instr(mention, "[") - 2)


def mention_id(mention: Column) -> Column:
    """The id inside the bracket."""
    return F.substring_index(F.substring_index(mention, "[", -1), "]", 1)


def mention_names(contents: Column) -> Column:
    """Array of the unit names mentioned in a selection."""
    return F.regexp_extract_all(contents, F.lit(MENTIONS), 1)


def unit_stance_removed(name: Column) -> Column:
    """Unit name without its sieged or burrowed stance."""
    stances = ("Sieged", "Burrowed")
    has_stance = F.contains(name, F.lit(stances[0])) | F.contains(name, F.lit(stances[1]))
    # few names have one; the others need no regex
    return F.when(has_stance, F.regexp_replace(name, "|".join(stances), "")).otherwise(name)


def is_worker(name: Column) -> Column:
    return name.isin(*WORKERS)


def start_coordinate(contents: Column, axis: int) -> Column:
    """Decimal x (axis 1) or y (axis 2) between the first parentheses."""
    inside = F.split_part(F.split_part(contents, F.lit("("), F.lit(2)), F.lit(")"), F.lit(1))
    return F.split_part(inside, F.lit(","), F.lit(axis)).try_cast("double")
