"""Session settings for tests and the benchmark, and the one place that materialises."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[SparkSession, str] = {}
_DELETE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str | int = 8, app: str = "matchlog") -> SparkSession:
    """A local session; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MATCHLOG_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC")
        # no Python call sites in error messages, for quicker plan building
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or _LOCAL_FOLDERS.get(spark)
        or spark.sparkContext.getCheckpointDir()
    )
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = _LOCAL_FOLDERS[spark] = tempfile.mkdtemp(prefix="matchlog-")
    return folder


def checkpoint_folder(spark: SparkSession) -> None:
    """Let the context checkpoint to the shared folder, unless it has a folder for that."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def materialize(df: DataFrame, keep_shuffles: bool = True) -> DataFrame:
    """Write ``df`` as a table to the shared folder and return the table.

    For relations read more than once. It cuts the lineage, outlives lost executors and,
    being columnar, is read only as far as needed. Without ``keep_shuffles`` the shuffle files
    of the write are deleted as it ends, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/matchlog-{uuid.uuid4().hex}"
    if keep_shuffles:
        df.write.parquet(path)
    else:
        before = spark.conf.get(_DELETE_SHUFFLES, None)
        spark.conf.set(_DELETE_SHUFFLES, "true")
        try:
            # a frame made under the setting, whose execution looks at it
            df.select("*").write.parquet(path)
        finally:
            if before is None:
                spark.conf.unset(_DELETE_SHUFFLES)
            else:
                spark.conf.set(_DELETE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more.

    Only tables of that name in the shared folder are touched.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = shared_folder(spark).rstrip("/")
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        name = path.rsplit("/", 1)[1]
        if name.startswith("matchlog-"):
            place = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            place.getFileSystem(conf).delete(place, True)
