"""Order-dependent operators that stay bounded when one key holds much of the log.

The position ``seq`` is unique over the whole log, so a stretch of ``block_rows``
consecutive positions holds at most that many rows. Ordered work runs inside
(key, stretch) groups; what crosses stretches is one summary row per (key, stretch).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlog.session import materialize

BLOCK_ROWS = 1_000_000
BLOCK = "_block"


def with_block(df: DataFrame, order: str = "seq", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the stretch each row lies in."""
    return df.withColumn(BLOCK, F.expr(f"`{order}` div {block_rows}"))


def with_previous(
    df: DataFrame,
    keys: list[str],
    values: list[str],
    order: str = "seq",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``prev_<value>``: the value in the key's previous row, null for its first row.

    Rows are shuffled once by (key, stretch). Inside a stretch this is a plain ``lag``;
    the first row of each stretch gets the last values of the key's stretch before it,
    found on a second read of the same shuffle.
    """
    carried = [c for c in df.columns if c not in (*keys, order)]
    placed = with_block(df, order, block_rows).repartition(*keys, BLOCK)

    inside = Window.partitionBy(*keys, BLOCK).orderBy(order)
    within = (
        placed.select(
            "*",
            F.row_number().over(inside).alias("_at"),
            *[F.lag(v).over(inside).alias(f"prev_{v}") for v in values],
        )
        .where(F.col("_at") > 1)
        .drop("_at", BLOCK)
    )

    across = Window.partitionBy(*keys).orderBy(BLOCK)
    heads = (
        placed.groupBy(*keys, BLOCK)
        .agg(
            F.min(order).alias(order),
            *[F.min_by(c, order).alias(c) for c in carried],
            *[F.max_by(v, order).alias(f"_last_{v}") for v in values],
        )
        .select(
            *df.columns,
            *[F.lag(f"_last_{v}").over(across).alias(f"prev_{v}") for v in values],
        )
    )
    return within.unionByName(heads)


def last_from(
    rows: DataFrame, keys: list[str], n: int, order: str = "seq", fine: int = 1024
) -> DataFrame:
    """The position from which on a row is among the last ``n`` of its key, for keys that
    have more rows than that. ``rows`` carry their stretch; positions are unique.

    The stretch in which the n-th last row lies is found from counts per stretch, then the
    run of ``fine`` positions from counts per run in it, then the row among those few.
    """
    back = Window.partitionBy(*keys).orderBy(F.desc("_run")).rowsBetween(Window.unboundedPreceding, -1)

    def reached(counts: DataFrame, left: Column) -> DataFrame:
        """The run in which the last ``left`` rows begin, and how many of them it holds."""
        later = counts.withColumn("_later", F.coalesce(F.sum("_n").over(back), F.lit(0)))
        return later.where(
            (F.col("_later") < left) & (F.col("_later") + F.col("_n") >= left)
        ).withColumn("_left", left - F.col("_later"))

    run = F.expr(f"`{order}` div {fine}")
    per_run = rows.groupBy(*keys, BLOCK, run.alias("_run")).agg(F.count(F.lit(1)).alias("_n"))
    per_block = per_run.groupBy(*keys, BLOCK).agg(F.sum("_n").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    full = per_block.withColumn("_all", total).where(F.col("_all") > n)
    blocks = reached(full.withColumn("_run", F.col(BLOCK)), F.lit(n)).select(*keys, BLOCK, "_left")
    runs = per_run.join(blocks.hint("shuffle_hash"), [*keys, BLOCK])
    runs = reached(runs, F.col("_left")).select(*keys, BLOCK, "_run", "_left")
    near = rows.select(*keys, BLOCK, order, run.alias("_run")).join(
        runs.hint("shuffle_hash"), [*keys, BLOCK, "_run"]
    )
    newest = F.sort_array(F.collect_list(order), asc=False)
    return near.groupBy(*keys).agg(
        F.element_at(newest, F.max("_left").cast("int")).alias("_from")
    )


def mark_last(
    rows: DataFrame,
    summary: DataFrame,
    keys: list[str],
    n: int,
    order: str = "seq",
) -> DataFrame:
    """Add ``is_last``: whether a row is among the last ``n`` of its key.

    ``rows`` carry their stretch; ``summary`` has one row per (key, stretch), whose columns
    the rows get. Rows are compared with one position per key and never put in order.
    """
    offsets = summary.join(last_from(rows, keys, n, order), keys, "left")
    return (
        rows.join(offsets.hint("shuffle_hash"), [*keys, BLOCK])
        .withColumn("is_last", F.coalesce(F.col(order) >= F.col("_from"), F.lit(True)))
        .drop("_from")
    )


def exact_rank(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str = "position",
    total: str | None = None,
    split_ties: bool = False,
) -> DataFrame:
    """Add the 1-based rank of each row within ``keys`` (nulls are a key of their own), and
    with ``total`` the number of the key's rows.

    Rows are dealt by ranges of (keys, order) and sorted inside each partition, however many
    rows a key has; Spark takes the limits of the ranges from a sample of each partition. A
    key's rows then fill stretches of consecutive partitions: a row's rank is its place in
    the partition, less that of the key's first row there, plus the key's rows in the
    partitions before, which are one count per (key, partition).

    Equal (keys, order) share a partition. ``split_ties`` numbers them apart first, so that
    a row repeated without end spreads too; ``df`` must then read its rows in a fixed order,
    as a scan does.
    """
    given = df.columns
    by = [F.col(k).asc() for k in keys] + order
    if split_ties:
        df = df.withColumn("_tie", F.monotonically_increasing_id())
        by = [*by, F.col("_tie")]
    placed = materialize(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_slot", F.monotonically_increasing_id())
        .drop("_tie")
    ).withColumn("_part", F.shiftright("_slot", 33))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*keys, "_part")
        .agg(F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
            F.col("_part").alias("_at"),
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 - F.col("_first")).alias("_shift"),
            *([F.sum("_n").over(whole).alias(total)] if total else []),
        )
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return placed.join(starts, reduce(Column.__and__, same, F.col("_part") == F.col("_at"))).select(
        *given, (F.col("_slot") + F.col("_shift")).alias(name), *([total] if total else [])
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each key with their rank.

    Spark cuts every map task's output to ``k`` rows per key before the shuffle.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def id_grid(bounds: DataFrame, low: str, high: str, name: str, stretch: int = 100_000) -> DataFrame:
    """Every integer from ``low`` to ``high`` of a one-row relation.

    The range is cut into stretches first, so that many tasks fill it in.
    """
    first, last = F.expr(f"`{low}` div {stretch}"), F.expr(f"`{high}` div {stretch}")
    return (
        bounds.where(F.col(low).isNotNull())
        .select(low, high, F.explode(F.sequence(first, last)).alias("_stretch"))
        .repartition("_stretch")
        .select(
            F.explode(
                F.sequence(
                    F.greatest(F.col(low).cast("long"), F.col("_stretch") * stretch),
                    F.least(F.col(high).cast("long"), F.col("_stretch") * stretch + (stretch - 1)),
                )
            ).alias(name)
        )
    )
