"""Writers. Each is one set-based job; nothing is appended row by row or chunk by chunk."""

from __future__ import annotations

import uuid

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlog.sources import readers

ROWS_PER_FILE = 4_000_000
GAMES_PER_CHUNK = 1000
BUCKETS = 200


def ingest_csv(spark: SparkSession, source: str, path: str) -> None:
    """A raw log CSV to a log table by event type, in one write of its rows.

    Each row keeps its split and its number there; the counts per split, read back from those
    two columns, go beside the rows, and ``readers.read_ingested`` makes positions of them.
    Rows are gathered by (event, split); Spark splits large and merges small partitions.
    """
    (
        readers.located(readers.scan_csv(spark, source))
        .hint("rebalance", "event", *readers.SPLIT)
        .sortWithinPartitions("event", "_row")
        .write.mode("overwrite")
        .partitionBy("event")
        .parquet(f"{path}/rows")
    )
    shifts = readers.split_shifts(spark.read.parquet(f"{path}/rows"))
    shifts.write.mode("overwrite").parquet(f"{path}/splits")


def save_features(
    tables: dict[str, DataFrame], path: str, buckets: int = BUCKETS
) -> None:
    """Write feature tables by name, each bucketed and sorted by game, and then a manifest.

    All get the same buckets, one file each, so that any of them join without a shuffle.
    The manifest lists a table's columns and buckets once it is whole.
    """
    listed = []
    for name, table in tables.items():
        temporary = f"matchlog_{uuid.uuid4().hex}"
        (
            table.repartition(buckets, "game_id")
            .write.mode("overwrite")
            .bucketBy(buckets, "game_id")
            .sortBy("game_id")
            .option("path", f"{path}/{name}")
            .saveAsTable(temporary)
        )
        spark = table.sparkSession
        spark.sql(f"DROP TABLE {temporary}")  # the files stay
        columns = ", ".join(f"`{c}` {t}" for c, t in table.dtypes)
        listed.append((name, columns, buckets))
    manifest = spark.createDataFrame(listed, "name STRING, columns STRING, buckets INT")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def write_by_event(log: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Split the log by event type, so that later scans read only the types they need.

    Rows are gathered by (event, stretch of source order): files stay bounded however
    frequent an event or a game is, and the rows of a game stay together. Spark splits
    large and merges small partitions by their measured size.
    """
    (
        log.withColumn("_stretch", F.floor(F.col("seq") / rows_per_file))
        .hint("rebalance", "event", "_stretch")
        .drop("_stretch")
        .sortWithinPartitions("event", "seq")
        .write.mode("overwrite")
        .partitionBy("event")
        .parquet(path)
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite a feature table."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def write_by_game_chunk(df: DataFrame, path: str, games: int = GAMES_PER_CHUNK) -> None:
    """Write a feature table by ranges of games; a rerun replaces only the ranges it covers.

    A feature table has one row per game, so a range holds at most ``games`` rows.
    """
    (
        df.withColumn("game_chunk", F.expr(f"game_id div {games}"))
        .repartition("game_chunk")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("game_chunk")
        .parquet(path)
    )


def save_relation(df: DataFrame, path: str) -> DataFrame:
    """Persist a keyed intermediate relation and return it as read back."""
    df.write.mode("overwrite").parquet(path)
    return load_relation(df.sparkSession, path)


def load_relation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def export_column(df: DataFrame, column: str, path: str) -> None:
    """Write the non-null values of one parsed column as CSV."""
    write_table(df.select(column).where(F.col(column).isNotNull()), path, "csv")
