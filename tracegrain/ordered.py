"""Ordered work on keyed rows without putting one key in one task.

A key may hold a third of all rows, so no helper here opens a window over a bare key.  Rows carry a
slice number (a run of consecutive positions inside a key); row-level work happens per (key, slice) and
only one summary row per slice is ever ordered across slices.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut, parallelism

SLICE_ROWS = 4096


def slice_of(seq: Column | str, width: int = SLICE_ROWS) -> Column:
    """Slice number of a 1-based gap-free position."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.floor((seq - 1) / F.lit(width)).cast("bigint")


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "seq",
                partitions: int | None = None) -> DataFrame:
    """1-based position of each row inside its key, in `order` (which must be unique inside the key).

    Range partitioning on (key, order) splits a hot key over many tasks.  The partition number has to be
    the same for both uses below, so the ranged rows are cut to the checkpoint folder first.
    """
    n = partitions or parallelism(df.sparkSession)
    ranged = cut(df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id()))
    group = [*keys, "_slice"]
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranged.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter("_base > 0").drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return (
        ranged.withColumn("_rn", local).join(bases, group, "left")
        .withColumn(out, (F.col("_rn") + F.coalesce("_base", F.lit(0))).cast("bigint"))
        .drop("_slice", "_rn", "_base")
    )


def halo(df: DataFrame, seq: str, before: int = 0, after: int = 0, width: int = SLICE_ROWS) -> DataFrame:
    """Add `_slice` and `_own`; rows near a slice border are also copied to the neighbour slice.

    Fixed-offset windows (lag 1, an n-gram of 8) then run inside (key, slice) on whole neighbourhoods.
    At most (before + after) / width of the rows are copied.
    """
    pos = F.pmod(F.col(seq) - 1, F.lit(width))
    own = slice_of(seq, width)
    homes = [F.struct(own.alias("s"), F.lit(True).alias("own"))]
    extra = []
    if before:  # this row is context before the next slice
        extra.append(F.when(pos >= width - before, F.struct((own + 1).alias("s"), F.lit(False).alias("own"))))
    if after:  # this row is context after the previous slice
        extra.append(F.when((pos < after) & (own > 0), F.struct((own - 1).alias("s"), F.lit(False).alias("own"))))
    return (
        df.withColumn("_home", F.explode(F.array_compact(F.array(*homes, *extra))))
        .withColumns({"_slice": F.col("_home.s"), "_own": F.col("_home.own")}).drop("_home")
    )


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
              slice_col: str = "_slice", forward: bool = False) -> DataFrame:
    """Previous (or next, `forward=True`) row's `value` inside a key, over any number of slices.

    `slice_col` must be monotone in `order`.  Inside a slice this is a plain lag/lead; the border row of
    each slice comes from a map-side combined aggregate and an ordered pass over slice summaries.
    """
    group = [*keys, slice_col]
    boxed = F.struct(value.alias("v"))
    rank = F.struct(*order)
    inside = Window.partitionBy(*group).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(slice_col)
    edge = F.min_by(boxed, rank) if forward else F.max_by(boxed, rank)
    shift = F.lead if forward else F.lag
    borders = df.groupBy(*group).agg(edge.alias("_edge")).withColumn("_carry", shift("_edge").over(across)).drop("_edge")
    return (
        df.withColumn("_in", shift(boxed).over(inside)).join(borders, group, "left")
        .withColumn(out, F.coalesce("_in", "_carry")["v"]).drop("_in", "_carry")
    )


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
                  slice_col: str = "_slice", include_current: bool = False) -> DataFrame:
    """Last non-null `value` before (or up to) each row inside its key."""
    group = [*keys, slice_col]
    end = 0 if include_current else -1
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    across = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    borders = (
        df.withColumn("_v", value).filter("_v is not null").groupBy(*group)
        .agg(F.max_by("_v", F.struct(*order)).alias("_edge"))
    )
    # every slice needs a carry, also those without a value of their own
    borders = (
        df.select(*group).distinct().join(borders, group, "left")
        .withColumn("_carry", F.last("_edge", ignorenulls=True).over(across)).drop("_edge")
    )
    return (
        df.withColumn("_in", F.last(value, ignorenulls=True).over(inside)).join(borders, group, "left")
        .withColumn(out, F.coalesce("_in", "_carry")).drop("_in", "_carry")
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, out: str,
                slice_col: str = "_slice", inclusive: bool = True) -> DataFrame:
    """Running total of `amount` inside a key: local total plus the total of all earlier slices."""
    group = [*keys, slice_col]
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    across = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        df.groupBy(*group).agg(F.sum(amount).alias("_t"))
        .withColumn("_base", F.sum("_t").over(across)).drop("_t")
    )
    zero = F.lit(0)
    return (
        df.withColumn("_in", F.sum(amount).over(inside)).join(bases, group, "left")
        .withColumn(out, F.coalesce("_in", zero) + F.coalesce("_base", zero)).drop("_in", "_base")
    )


def tree_fold(df: DataFrame, keys: Sequence[str], seq: str, state: Column, compose: Callable[[Column, Column], Column],
              identity: Column, out: str, width: int = SLICE_ROWS, levels: int = 3) -> DataFrame:
    """Ordered fold with an associative `compose`, never holding more than `width` states in one group.

    Level one folds runs of `width` positions, level two runs of `width` results, and so on; three levels
    cover width**3 rows of one key.
    """
    level = df.select(*keys, F.col(seq).alias("_pos"), state.alias("_state"))
    for step in range(levels):
        last = step == levels - 1
        parent = F.floor((F.col("_pos") - (1 if step == 0 else 0)) / F.lit(width)).cast("bigint")
        grouped = level if last else level.withColumn("_parent", parent)
        group = list(keys) if last else [*keys, "_parent"]
        ordered = F.transform(
            F.array_sort(F.collect_list(F.struct("_pos", "_state"))), lambda x: x["_state"])
        level = grouped.groupBy(*group).agg(ordered.alias("_states"))
        folded = F.aggregate("_states", identity, compose)
        keep = [*keys] if last else [*keys, F.col("_parent").alias("_pos")]
        level = level.select(*keep, folded.alias(out if last else "_state"))
    return level


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi join whose hot keys are spread over `salts` tasks; `right` is repeated per salt.

    `left` may be preserved (inner, left, semi, anti); the salt follows the row content, not a random draw, so a
    recomputed task gives the same rows.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per key.  The rank filter lets Spark prune to k rows per key and task before the shuffle."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(out) <= k)
