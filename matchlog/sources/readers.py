"""Scans: logs, samples, dimensions, the game spine and foreign headers."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlog.operators import ordered
from matchlog.session import materialize
from matchlog.sources import schema


SPLIT = ["_file", "_start"]


def located(raw: DataFrame) -> DataFrame:
    """Rows read from files, with the split each comes from and a number that grows along it."""
    return raw.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )


def split_shifts(rows: DataFrame) -> DataFrame:
    """What to add to a split's row numbers to get positions in the source: file order is
    split order, so the rows of the splits before. There is one row per ~128 MB of input."""
    before = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*SPLIT).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return sizes.select(
        *SPLIT, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )


def positioned(rows: DataFrame, shifts: DataFrame) -> DataFrame:
    """Located rows with ``seq``. How the shifts are joined is Spark's choice, by their size."""
    return (
        rows.join(shifts, SPLIT)
        .withColumn("seq", F.col("_row") + F.col("_shift"))
        .drop(*SPLIT, "_row", "_shift")
    )


def with_source_order(df: DataFrame) -> DataFrame:
    """Add ``seq``, the dense position of each row in its source files.

    The rows are first written down with the numbers they got: another scan may cut and
    number its splits differently. ``sinks.ingest_csv`` makes that copy the log table itself.
    """
    rows = materialize(located(df))
    return positioned(rows, materialize(split_shifts(rows)))


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The column names in the first line of a CSV."""
    return list(spark.read.csv(path, header=False).first())


def read_log_csv(spark: SparkSession, path: str) -> DataFrame:
    """A raw log CSV with its row order frozen as ``seq``; a missing winner becomes null."""
    return as_log(with_source_order(scan_csv(spark, path)))


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """A raw log CSV in the columns of its header."""
    return spark.read.schema(schema.csv_schema(csv_header(spark, path))).csv(path, header=True)


def as_log(rows: DataFrame) -> DataFrame:
    """Rows in the columns of a log; what is missing is null."""
    missing = [f for f in schema.LOG.fields if f.name not in rows.columns]
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in missing]
    return rows.select("*", *nulls).select(schema.LOG.names)


def read_ingested(spark: SparkSession, path: str, *events: str) -> DataFrame:
    """A log that ``sinks.ingest_csv`` wrote; ``events`` prune its partitions."""
    rows = spark.read.parquet(f"{path}/rows")
    rows = rows.where(F.col("event").isin(*events)) if events else rows
    return as_log(positioned(rows, spark.read.parquet(f"{path}/splits")))


def read_log(spark: SparkSession, path: str, *events: str) -> DataFrame:
    """A log table written by ``sinks.write_by_event``; ``events`` prune its partitions."""
    log = spark.read.parquet(path)
    return log.where(F.col("event").isin(*events)) if events else log


def first_rows(log: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in source order, read up to a bound on the position.

    The bound starts at 2 n and doubles until ``n`` rows lie below it, or none above. It goes
    to the scan, which skips files and row groups by their statistics; so a prefix costs about
    its own size, also of a filtered log.
    """
    bound = 2 * n
    while n and log.where(F.col("seq") < bound).limit(n).count() < n:
        if log.where(F.col("seq") >= bound).isEmpty():
            break
        bound *= 2
    return log.where(F.col("seq") < bound).orderBy("seq").limit(n)


def game_range(log: DataFrame, first: int, last: int) -> DataFrame:
    """Games ``first`` to ``last``, both included."""
    return log.where(F.col("game_id").between(first, last))


def union_logs(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train without its label, followed by test: test's positions start after train's last,
    so that positions stay unique over the joined log. The shift is a scalar subquery."""
    last = train.select(F.coalesce(F.max("seq") + 1, F.lit(0))).scalar()
    start = test.select(F.coalesce(F.min("seq"), F.lit(0))).scalar()
    moved = test.drop("winner").withColumn("seq", F.col("seq") + F.greatest(last - start, F.lit(0)))
    return train.drop("winner").unionByName(moved, allowMissingColumns=True)


def game_spine(df: DataFrame) -> DataFrame:
    """Every game that needs an answer."""
    return df.select("game_id").distinct()


def read_repeated_headers(spark: SparkSession, path: str, key: str = "game_id") -> DataFrame:
    """A CSV whose columns appear once per player under the same name.

    First copies become ``p0_<name>``, second copies ``p1_<name>``.
    """
    seen: set[str] = set()
    names = []
    for name in csv_header(spark, path):
        names.append(name if name == key else f"p{int(name in seen)}_{name}")
        seen.add(name)
    # Read by position: without a declared header Spark keeps the repeated names apart.
    layout = ", ".join(f"`{n}` {'INT' if n == key else 'DOUBLE'}" for n in names)
    return spark.read.schema(layout).csv(path, header=True, enforceSchema=True)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A feature table written by ranges of games."""
    return spark.read.parquet(path).drop("game_chunk")


def load_features(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """Feature tables that ``sinks.save_features`` wrote, all or those named.

    They are declared with their buckets, so joins on the game need no shuffle.
    """
    listed = {r.name: r for r in spark.read.json(f"{path}/manifest").collect()}
    found = {}
    for name in names or listed:
        if name not in listed:
            raise KeyError(f"no feature table {name} in {path}; there are {sorted(listed)}")
        table = f"matchlog_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {table} ({listed[name].columns}) USING parquet "
            f"CLUSTERED BY (game_id) SORTED BY (game_id) INTO {listed[name].buckets} BUCKETS "
            f"LOCATION '{path}/{name}'"
        )
        found[name] = spark.table(table)
    return found


@dataclass(frozen=True)
class UnitCatalog:
    """The unit dimension, one row per (unit, species): ``rows`` known here, or a ``table``
    of any size. Names have numbers in their order, on which units are counted."""

    rows: tuple[tuple, ...] = ()
    table: DataFrame | None = None

    @classmethod
    def load(cls, df: DataFrame) -> UnitCatalog:
        """A unit table; its rows stay where they are."""
        columns = df.select(schema.UNIT_INFO.names)
        return cls(table=materialize(columns.withColumn("_row", F.monotonically_increasing_id())))

    @classmethod
    def read_csv(cls, spark: SparkSession, path: str) -> UnitCatalog:
        return cls.load(spark.read.schema(schema.UNIT_INFO).csv(path, header=True))

    @property
    def units(self) -> list[str]:
        """Distinct unit names in order: the columns of a table that has one for each."""
        if self.table is None:
            return sorted({r[0] for r in self.rows})
        names = self.table.select("unit").where(F.col("unit").isNotNull()).distinct()
        return [r.unit for r in names.orderBy("unit").collect()]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The catalogue as a relation; known rows are a local one, whose size is known."""
        if self.table is not None:
            return self.table.drop("_row")
        columns = [list(c) for c in zip(*self.rows)] or [[] for _ in schema.UNIT_INFO.names]
        return spark.createDataFrame(pa.table(columns, names=schema.UNIT_INFO.names))

    def dictionary(self, spark: SparkSession) -> DataFrame:
        """(unit, code, owners, supply) per name: its number from 0, the species that own it,
        and for units other than workers the supply, the last row's if there are several."""
        if self.table is None:
            supply = {r[0]: float(r[2]) for r in self.rows if r[0] not in schema.WORKERS}
            owners = [sorted({r[1] for r in self.rows if r[0] == u}) for u in self.units]
            columns = [self.units, list(range(len(self.units))), owners, [supply.get(u) for u in self.units]]
            kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return spark.createDataFrame(pa.table(arrays, names=["unit", "code", "owners", "supply"]))
        per_name = self.table.where(F.col("unit").isNotNull()).groupBy("unit").agg(
            F.array_sort(F.collect_set("species")).alias("owners"),
            F.max_by("supply", "_row").alias("supply"),
        )
        numbered = ordered.exact_rank(per_name, [], [F.col("unit")])
        return numbered.select(
            "unit",
            (F.col("position") - 1).cast("int").alias("code"),
            "owners",
            F.when(~F.col("unit").isin(*schema.WORKERS), F.col("supply")).alias("supply"),
        )
