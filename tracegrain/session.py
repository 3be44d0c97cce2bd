"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_ARROW_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
TASK_ROWS, LEAST_TASKS = 2_000, 12


def build_session(master: str = "local[*]", app: str = "tracegrain", shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts; a private one only where the cluster names none."""
    root = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{_CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_CHECKPOINT_KEY, root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back, so a lost executor costs no replay."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; it goes when the application ends."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def coarse(df: DataFrame, rows: int) -> DataFrame:
    """`df` dealt to so few partitions as about `rows` rows need, TASK_ROWS in each; unchanged where there are no more shuffle partitions than that.

    For tables to be written: Hadoop's local file system starts two processes for each file, so thousands of tiny files take longer than their
    rows.  Rows are shuffled, since a task that reads many partitions in turn holds the sort buffers of all of them.
    """
    parts = max(LEAST_TASKS, -(-rows // TASK_ROWS))
    return df.repartition(parts) if parts < parallelism(df.sparkSession) else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet below the shared checkpoint folder and read it back.

    Unlike a checkpoint the result is columnar, pruned and compressed.  The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` itself where it is a `stored` table, else stored."""
    return df if vars(df).get("_stored_at") else stored(df, name)


def discard(df: DataFrame) -> None:
    """Delete the folder of a `stored` table that nothing reads any more; other tables are left alone."""
    path = vars(df).get("_stored_at")
    if path:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def swept(spark: SparkSession) -> None:
    """Have the driver's JVM collect garbage: Spark deletes the shuffle files of jobs whose results nothing refers to any more, and a loop leaves many."""
    spark._jvm.System.gc()


@contextmanager
def arrow_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that are planned inside send batches of at most `most` bytes, or one row, to Python; both sides hold such a batch more than once."""
    before = spark.conf.get(_ARROW_BYTES_KEY)
    spark.conf.set(_ARROW_BYTES_KEY, str(most))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_BYTES_KEY, before)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
