"""Mixing sources to target weights by Pfair scheduling (operator 9), in DataFrame functions only.

A source's rows form blocks of `block_rows`.  With a quota of q blocks in a period of H slots, its block k may not start before slot
floor(k*H/q) and must be done by ceil((k+1)*H/q).  In each slot the waiting block with the earliest deadline goes (of equals the
first source by name); these windows can always be met, so after any number of slots each source is less than one block away
from its share.  The pattern repeats with the period: the fold over one period (H slots, however large the
corpus) runs once, and block j goes to slot (j div q)*H + slot(j mod q).

Quotas are the target weights in units of 1/`period`, rounded, at least one block each, so that H is about `period` or, with more
sources than that, their number.  A row's place in its source is its rank by the digest of its id.  It is counted in two steps, within
runs of equal digest prefixes and over the counts of the runs, so a source with a third of all rows is spread over as many tasks as it needs.

No row is dropped or repeated: when a source is exhausted its further slots stay empty.  `position` sorts the mix.

Defined results: null sources are a source of their own; rows with equal ids take adjacent places in any order; an empty table gives an
empty mix; sources without a given weight get none of the slots but one per period; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16
PERIOD = 1000
EXPONENT = 0.5
RUN_ROWS = 2048


def ranks(docs: DataFrame, key: str, source: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """key, source, place: 0-based rank of each row in its source by md5 of its key."""
    rows = docs.count()
    prefix = 1
    while rows > run_rows * 16 ** prefix and prefix < 31:
        prefix += 1
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    placed = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), digest.alias("digest")).withColumn("run", F.substring("digest", 1, prefix))
    earlier = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("source", "run").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    bases = bases.select(F.col("source").alias("base_source"), F.col("run").alias("base_run"), "base")
    inside = F.row_number().over(Window.partitionBy("source", "run").orderBy("digest", "key"))
    return (
        placed.withColumn("inside", inside)
        .join(bases, F.col("source").eqNullSafe(F.col("base_source")) & (F.col("run") == F.col("base_run")))
        .select("key", "source", (F.col("base") + F.col("inside") - 1).alias("place"))
    )


def quotas(docs: DataFrame, source: str, weights: DataFrame | None = None, period: int = PERIOD, exponent: float = EXPONENT) -> DataFrame:
    """source, quota: blocks per period; `weights` has source and weight, else rows ** exponent."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        wanted = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(exponent)))
    else:
        given = weights.groupBy(F.col("source").alias("given")).agg(F.max("weight").cast("double").alias("weight"))
        wanted = sizes.join(given, F.col("source").eqNullSafe(F.col("given")), "left").withColumn(
            "weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    total = wanted.agg(F.sum("weight").alias("total"))
    share = F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(F.lit(0.0))
    return wanted.join(F.broadcast(total)).select("source", F.greatest(F.round(share * period), F.lit(1)).cast("int").alias("quota"))


def pattern(quota: DataFrame) -> DataFrame:
    """source, quota, k, slot, slots: the earliest-deadline-first pattern of one period, folded over its slots."""
    table = quota.agg(F.array_sort(F.collect_list(F.struct("source", "quota"))).alias("own"), F.sum("quota").cast("int").alias("slots")).filter("slots > 0")
    own, slots = F.col("own"), F.col("slots")
    start = F.struct(F.transform(own, lambda s: F.lit(0)).alias("done"), F.array().cast("array<struct<i:int,k:int>>").alias("order"))

    def step(state, t):
        def window(s, i):
            k = F.get(state["done"], i)
            release, deadline = F.floor(k * slots / s["quota"]), F.ceil((k + 1) * slots / s["quota"])
            return F.when((k < s["quota"]) & (release <= t), F.struct(deadline.cast("int").alias("deadline"), i.cast("int").alias("i"), k.alias("k")))

        pick = F.array_min(F.transform(own, window))
        return F.struct(F.transform(state["done"], lambda k, i: F.when(i == pick["i"], k + 1).otherwise(k)).alias("done"),
                        F.concat(state["order"], F.array(F.struct(pick["i"].alias("i"), pick["k"].alias("k")))).alias("order"))

    order = F.aggregate(F.sequence(F.lit(0), slots - 1), start, step, lambda state: state["order"])
    return table.select("own", "slots", F.posexplode(order).alias("slot", "turn")).select(
        F.get("own", F.col("turn.i"))["source"].alias("slot_source"), F.get("own", F.col("turn.i"))["quota"].alias("quota"),
        F.col("turn.k").alias("k"), "slot", "slots")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS,
        period: int = PERIOD, exponent: float = EXPONENT) -> DataFrame:
    """`key`, `source`, `quota`, `slots`, `block`, `slot` (of the block in the mix) and `position` (of the row) for every row."""
    shape = pattern(quotas(docs, source, weights, period, exponent))
    sources = shape.filter("k = 0").select(F.col("slot_source").alias("quota_source"), "quota", "slots")
    turns = shape.select(F.col("slot_source").alias("turn_source"), F.col("k").alias("turn_k"), F.col("slot").alias("turn_slot"))
    blocks = ranks(docs, key, source).withColumn("block", F.floor(F.col("place") / block_rows))
    blocks = blocks.join(sources, F.col("source").eqNullSafe(F.col("quota_source"))).withColumn("k", F.col("block") % F.col("quota"))
    slot = F.floor(F.col("block") / F.col("quota")) * F.col("slots") + F.col("turn_slot")
    return blocks.join(turns, F.col("source").eqNullSafe(F.col("turn_source")) & (F.col("k") == F.col("turn_k"))).select(
        F.col("key").alias(key), F.col("source").alias(source), "quota", "slots", "block", slot.alias("slot"),
        (slot * block_rows + F.col("place") % block_rows).alias("position"))


def ordered(docs: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of `docs`, all columns, in the order of the mix."""
    place = mix(docs, key, source).groupBy(F.col(key).alias("_key"), F.col(source).alias("_source")).agg(F.min("position").alias("_position"))
    placed = docs.join(place, F.col(key).eqNullSafe(F.col("_key")) & F.col(source).eqNullSafe(F.col("_source")))
    return placed.orderBy("_position").select(*[docs[c] for c in docs.columns])
