"""Scalar helpers shared by the feature plans."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO_EPSILON = 0.00000001


def minute(time: Column) -> Column:
    """The minute a time falls in."""
    return F.floor(time).cast("int")


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x0 - x1, y0 - y1
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def share(a: Column, b: Column, epsilon: float = RATIO_EPSILON) -> Column:
    """a's share of a + b, kept finite by ``epsilon``."""
    return a / (a + b + F.lit(epsilon))


def float_ratio(a: Column, b: Column) -> Column:
    """a / b with floating-point rules: x/0 is infinite and 0/0 null."""
    return F.when(b != 0, a.cast("double") / b).when(a > 0, F.lit(float("inf")))


def one_hot(value: Column, options: Iterable, name: str) -> list[Column]:
    """One 0/1 column per option; null gives all zeros."""
    return [
        F.coalesce((value == F.lit(o)).cast("int"), F.lit(0)).alias(name.format(o)) for o in options
    ]


def species_code(species: Column) -> Column:
    """T, P, Z as 1, 2, 3; anything else 0."""
    return (
        F.when(species == "T", 1).when(species == "P", 2).when(species == "Z", 3).otherwise(0)
    )


def matchup(first: Column, second: Column) -> Column:
    """Both species codes written next to each other."""
    return F.concat(first.cast("string"), second.cast("string"))


def sum_columns(names: Iterable[str]) -> Column:
    """Row-wise sum."""
    return F.expr(" + ".join(f"`{n}`" for n in names))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def plain_names(df: DataFrame) -> DataFrame:
    """Columns renamed so that only letters, digits and underscores are left."""
    return df.toDF(*[re.sub(r"[\W]", "_", c) for c in df.columns])


def conform(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """Exactly ``columns`` in order; absent ones filled with ``fill``."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in columns])


def fill_features(
    df: DataFrame, keep: tuple[str, ...] = ("game_id",), value: float = 0
) -> DataFrame:
    """Nulls replaced in every column but ``keep``.

    The key stays a plain column: Spark then still knows that the rows are partitioned by
    it and that it is unique.
    """
    return df.fillna(value, subset=[c for c in df.columns if c not in keep])
