"""Pivots with fixed columns and joins of feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlog.sources.schema import PLAYERS


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections do not compute again.

    Spark substitutes plain columns into the filters above them; it does not look into the
    output of a generator, here an array of one element.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def spread(
    df: DataFrame,
    cell: Column,
    names: dict[int, str],
    aggregates: dict[str, Column],
    key: str = "game_id",
) -> DataFrame:
    """Pivot to one row per ``key`` with a fixed set of columns.

    ``cell`` numbers the cells and ``names`` gives a name per number, holding ``{}`` when
    there are several ``aggregates``. Partial counts per (key, cell) are combined on the
    map side, and the number of output columns does not depend on the data.
    """
    wide = (
        df.withColumn("_cell", cell)
        .groupBy(key)
        .pivot("_cell", list(names))
        .agg(*[expr.alias(a) for a, expr in aggregates.items()])
    )
    # pivoted columns come value by value, aggregates in order within each
    return wide.toDF(key, *[n.format(a) for n in names.values() for a in aggregates])


#: A cell is a player and a number below this.
CELLS = 1 << 20


def player_cells(minutes: range, name: str) -> dict[int, str]:
    """Cell numbers and names for every (player, minute): see ``player_cell``."""
    if minutes and minutes[-1] >= CELLS:
        raise ValueError(f"a player has at most {CELLS} cells")
    return {
        p * CELLS + m: name.replace("{p}", str(p)).replace("{m}", str(m))
        for p in PLAYERS
        for m in minutes
    }


def player_cell(player: str = "player", number: str = "slice") -> Column:
    return F.col(player) * CELLS + F.col(number)


def both_present(df: DataFrame, prefixes: tuple[str, str]) -> DataFrame:
    """Keep rows with a value in some column of each of two groups."""
    groups = [[F.col(c) for c in df.columns if c.startswith(p)] for p in prefixes]
    first, second = (F.coalesce(*g).isNotNull() for g in groups)
    return df.where(first & second)


def star_join(spine: DataFrame, tables: list[DataFrame], key: str = "game_id") -> DataFrame:
    """Left-join feature tables, each with one row per ``key``, to a spine."""
    for t in tables:
        spine = spine.join(t, key, "left")
    return spine


def answer_spine(spine: DataFrame, predictions: DataFrame, default: float = 0.5) -> DataFrame:
    """Every game of the spine with its prediction, or ``default``."""
    return spine.join(predictions, "game_id", "left").fillna(default, [c for c in predictions.columns if c != "game_id"])


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """Rows with what ``table`` has for their keys, inner, no key's rows in one task.

    ``table`` has one row per key. It is first joined to the distinct (keys, ``spread``),
    then to the rows on both, so each of its rows goes as often as its key is spread out.
    """
    dealt = rows.withColumn("_deal", spread)
    wanted = dealt.select(*keys, "_deal").distinct().join(table, keys)
    return dealt.join(wanted, [*keys, "_deal"]).drop("_deal")
