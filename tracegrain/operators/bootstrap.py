"""Poisson bootstrap: resampling weights from a hash of (row, replicate), summed where the rows lie.

Every row takes part in a replicate with a weight drawn from the Poisson distribution of mean 1.  The draw is a hash of the row's key and the
replicate's number, so it does not depend on partitions, order or repeated attempts, and SQL can repeat it.  A replicate's statistic is a
ratio of weighted sums; sums are combined in each task, so what is shuffled is one row per task, group and replicate, for any number
of rows and of distinct values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICATES = 200
# P(weight <= k) of a Poisson variable of mean 1, for k = 0, 1, 2 …
STEPS = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(10))


def weights(key: Column, block: Column) -> Column:
    """The weights of four replicates: an md5 of `key:block` gives four numbers in [0, 1)."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), block.cast("string")).cast("binary"))
    uniform = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0) for i in range(4)]
    drawn = lambda u: sum((F.when(u >= s, 1).otherwise(0) for s in STEPS[1:]), F.when(u >= STEPS[0], 1).otherwise(0))
    return F.array(*[drawn(u) for u in uniform])


def replicates(rows: DataFrame, group: list[str], key: Column, numerator: Column, denominator: Column | None = None, count: int = REPLICATES) -> DataFrame:
    """group, replicate, statistic: sum(weight * numerator) / sum(weight * denominator); without a denominator the mean."""
    base = rows.select(*group, key.alias("_key"), numerator.cast("double").alias("_n"), (F.lit(1.0) if denominator is None else denominator.cast("double")).alias("_d"))
    base = base.filter("_n is not null and _d is not null")
    drawn = base.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(-(-count // 4) - 1))))
    drawn = drawn.select(*group, "_block", "_n", "_d", F.posexplode(weights(F.col("_key"), F.col("_block"))).alias("_i", "_w")).filter("_w > 0")
    sums = drawn.groupBy(*group, (F.col("_block") * 4 + F.col("_i")).alias("replicate")).agg(
        F.sum(F.col("_w") * F.col("_n")).alias("_n"), F.sum(F.col("_w") * F.col("_d")).alias("_d"))
    return sums.filter(F.col("replicate") < count).filter("_d <> 0").select(*group, "replicate", (F.col("_n") / F.col("_d")).alias("statistic"))


def intervals(rows: DataFrame, group: list[str], key: Column, numerator: Column, denominator: Column | None = None,
              count: int = REPLICATES, level: float = 0.95) -> DataFrame:
    """group, low, high: the central `level` of the replicates' statistics."""
    drawn = replicates(rows, group, key, numerator, denominator, count)
    edge = (1 - level) / 2
    return drawn.groupBy(*group).agg(F.percentile("statistic", edge).alias("low"), F.percentile("statistic", 1 - edge).alias("high"))
