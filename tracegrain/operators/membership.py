"""A mergeable membership filter: a blocked Bloom filter as a table of bit blocks.

A value sets BITS of the 512 bits of one block.  Blocks are built by `bit_or`, which Spark combines in each task before it shuffles, and filters of the same
size merge by `bit_or` again, so a filter grows with its terms in any order and number of parts.  The number of blocks follows from the
number of terms and the wanted rate of false positives.  A lookup is one join row per value; a filter of at most BROADCAST_BLOCKS blocks (4 MB) is
broadcast, a larger one is joined by block.  There are no false negatives.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8  # of 64 bits
BITS = 8  # one bit in each word
BROADCAST_BLOCKS = 1 << 16
_NAMES = [f"w{i}" for i in range(WORDS)]


@dataclass
class Filter:
    """`rows`: block, w0 … w7; `blocks` of which those without a value have no row."""

    rows: DataFrame
    blocks: int


def blocks_for(terms: int, rate: float) -> int:
    """Blocks that keep the rate of false positives at about `rate`: a block's load varies (Poisson), so the rate is averaged over it."""
    def expected(load: float) -> float:
        p, total = math.exp(-load), 0.0
        for n in range(int(load + 12 * math.sqrt(load) + 12)):
            total += p * (1 - (1 - 1 / 64) ** n) ** BITS
            p *= load / (n + 1)
        return total

    low, high = 0.01, 400.0  # terms a block
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if expected(middle) <= rate else (low, middle)
    return max(1, math.ceil(terms / low))


def _place(value: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a value, and its bit in each word: 6 bits of a second hash apiece."""
    second = F.xxhash64(value, F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(F.xxhash64(value), F.lit(blocks)), [bit(i) for i in range(WORDS)]


def build(terms: DataFrame, term: str = "term", rate: float = 0.01, blocks: int | None = None) -> Filter:
    """A filter of the distinct non-null terms; `blocks` where filters are to be merged."""
    known = terms.filter(F.col(term).isNotNull())
    blocks = blocks or blocks_for(known.agg(F.approx_count_distinct(term, 0.01)).first()[0], rate)
    block, bits = _place(F.col(term), blocks)
    marked = known.select(block.alias("block"), *[b.alias(n) for b, n in zip(bits, _NAMES, strict=True)])
    return Filter(marked.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in _NAMES]), blocks)


def merge(*filters: Filter) -> Filter:
    """The filter of all terms of the given ones, which must have one size."""
    if len({f.blocks for f in filters}) != 1:
        raise ValueError("filters of different sizes do not merge")
    both = reduce(DataFrame.unionByName, [f.rows for f in filters])
    return Filter(both.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in _NAMES]), filters[0].blocks)


def might_contain(rows: DataFrame, column: str, held: Filter, out: str = "maybe") -> DataFrame:
    """`rows` with `out`: false where the value is certainly not among the terms; a null value is not."""
    block, bits = _place(F.col(column), held.blocks)
    side = held.rows.select(F.col("block").alias("_block"), *[F.col(n).alias(f"_{n}") for n in _NAMES])
    if held.blocks <= BROADCAST_BLOCKS:
        side = F.broadcast(side)
    asked = rows.withColumns({"_at": block} | {f"_b{i}": b for i, b in enumerate(bits)})
    hit = reduce(lambda a, b: a & b, [F.col(f"_b{i}").bitwiseAND(F.col(f"_w{i}")) != 0 for i in range(WORDS)])
    met = asked.join(side, F.col("_at") == F.col("_block"), "left").withColumn(out, F.coalesce(hit & F.col(column).isNotNull(), F.lit(False)))
    return met.select(*rows.columns, out)
