"""Entity history and edges kept as files and advanced by batches.

A folder holds one row for each point of a key (`facts.points`: what one event says of it, tombstones too), also those that repeat the active state,
since a late row between may turn them into versions.  Rows lie in partitions by hash of the session, and of the name within it, so
that a session with a third of all rows is several partitions and a batch of few sessions touches few.

`merge` reads the partitions that the batch touches, adds its points, finds versions and windows anew there and replaces those partitions only
(dynamic partition overwrite).  Whatever the batches and their order, the result is that of `facts.versions` over all of them.  A batch that is
merged again changes nothing, which is also how an interrupted merge is mended: points have the key, seq and kind as their identity.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ordered import neighbour, slice_of
from ..session import discard, stored, swept
from . import facts

SESSION_BUCKETS = 64
NAME_BUCKETS = 4
_KEY = ["session", "entity_type", "name"]
_PLACE = ["bucket", "part"]
_POINT = ["ts_us", "source_hash", "summary", "props_text"]
_EDGE = ["session", "source_type", "source", "relation", "target_type", "target"]
_EDGE_REST = ["valid_from", "valid_to", "inferred", "confidence", "method", "seq", "source_hash", "idx"]


def _placed(rows: DataFrame, *names: str) -> DataFrame:
    spot = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    return rows.withColumn("bucket", spot(SESSION_BUCKETS, "session")).withColumn("part", spot(NAME_BUCKETS, *names))


def _held(spark: SparkSession, path: str, touched: DataFrame | None = None) -> DataFrame | None:
    """The stored rows, those of the `touched` partitions only; None before the first merge."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    # a row for each partition at most, a constant
    return rows if touched is None else rows.join(F.broadcast(touched), _PLACE, "left_semi")


def _latest(old: DataFrame | None, new: DataFrame, identity: list[str], order: Column, columns: list[str]) -> DataFrame:
    both = new.withColumn("_new", F.lit(1))
    if old is not None:
        both = both.unionByName(old.select(*new.columns).withColumn("_new", F.lit(0)))
    return both.groupBy(*_PLACE, *identity).agg(F.max_by(F.struct(*columns), order).alias("s")).select(*_PLACE, *identity, "s.*")


def _replace(rows: DataFrame, path: str, name: str) -> None:
    """Writes the partitions that `rows` has, once they are complete, and leaves the others."""
    done = stored(rows, name)
    done.repartition(*_PLACE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PLACE).parquet(path)
    discard(done)


def merge(path: str, assertions: DataFrame, tombstones: DataFrame | None = None) -> None:
    """Adds a batch of entity assertions, and tombstones, to the history below `path`."""
    spark = assertions.sparkSession
    batch = stored(_placed(facts.points(assertions, tombstones), "entity_type", "name"), "points")
    old = _held(spark, path, batch.select(*_PLACE).distinct())
    rows = _latest(old, batch, [*_KEY, "seq", "gone"], F.col("_new"), _POINT)
    sliced = stored(rows.withColumn("_slice", slice_of("seq")), "sliced")
    marked = stored(facts.changes(sliced), "marked")
    found = neighbour(marked.filter("changed"), _KEY, ["seq", "gone"], F.col("ts_us"), "valid_to", forward=True)
    repeats = marked.filter("not changed").withColumn("valid_to", F.lit(None).cast("bigint"))
    _replace(found.unionByName(repeats).drop("_slice"), path, "history-part")
    for done in (batch, sliced, marked):
        discard(done)
    swept(spark)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The history as `facts.versions` gives it."""
    return spark.read.parquet(path).filter("changed and not gone").select(
        *_KEY, "summary", "props_text", F.col("ts_us").alias("valid_from"), "valid_to", F.col("seq").alias("source_seq"), "source_hash")


def merge_edges(path: str, edges: DataFrame) -> None:
    """Adds a batch of typed edge assertions (`facts.typed_edges`) to the edges below `path`; of one edge the last assertion stays."""
    batch = stored(_placed(edges.select(*_EDGE, *_EDGE_REST), "source", "target"), "edges")
    old = _held(edges.sparkSession, path, batch.select(*_PLACE).distinct())
    _replace(_latest(old, batch, _EDGE, F.struct("seq", "idx", "_new"), _EDGE_REST), path, "edge-table")
    discard(batch)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """The edges as `facts.upsert_edges` gives them."""
    return spark.read.parquet(path).select(*_EDGE, *_EDGE_REST[:-1]).withColumnRenamed("seq", "source_seq")
