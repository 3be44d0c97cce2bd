"""Document fingerprints by SpotSigs (operator 1), in DataFrame functions only.

A spot is a common word (an anchor) that a content word follows; its signature is the anchor with the chain of the next CHAIN
content words, common words between them skipped.  The beginning of a text is an anchor too.  Where no common word stands among REACH words on
either side (other languages, tables, code), a content word whose hash is below those of all these words is an anchor itself, before the
content words that follow it, so signatures cover such stretches as well and an edit changes those nearby only.  A fingerprint is the set of the hashed
signatures, written as their sorted list.  Likeness is the Jaccard measure of two sets.

`near_pairs` finds pairs at or above a threshold t in a whole corpus: sets are dealt into partitions by length whose bounds grow by 1/t, so a pair lies
in one partition or two neighbours; within them only the rarest signatures of a set are indexed (a pair at t shares one of
them), lengths that rule t out are pruned, and the rest is verified.

Following documents by id are reached without a global window: ids are cut into slices at approximate quantiles, a window runs inside each
slice, and one row per slice carries the first text of the next one.

Defined results: null texts are empty; a text without words or with common words only has its whole text as its one signature, an empty text
has none; two empty fingerprints are alike (1.0), an empty one and another are not (0.0).  Rows of equal id follow each
other by text; null ids come first.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import parallelism, stored

CHAIN = 2
REACH = 2
THRESHOLD = 0.8

# Frequent function words of the four languages.
COMMON_WORDS = tuple("""
the of and to in a is that it was for on are as with they be at have this from or had by but not what all were we when your can there an which do
der die das und zu den von mit ist des sich auf für im dem ein eine als auch es werden aus er hat nach bei um am sind
de la le et les en un du une que est pour qui dans par plus pas au sur ne se ce il avec
el y los del las por para con no su al lo como más pero
""".split())


def spots(docs: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Adds `out`: the sorted distinct signatures of the column `text` (not null).

    Each array is a column of its own: the lambdas below refer to them at several places, and must not evaluate them anew for each word.
    """
    words, content = f"_{out}_words", f"_{out}_content"
    common = lambda c: c.isin(*COMMON_WORDS)
    split = F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")
    pairs = F.transform(words, lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get(words, i - 1), F.lit("the")).alias("before")))
    spot = lambda s, i: F.when(common(s["before"]), F.hash(
        s["before"], s["w"], *[F.get(content, i + j)["w"] for j in range(1, chain)]))
    hashed, own = f"_{out}_hashed", f"_{out}_own"
    code = F.transform(words, lambda w: F.when(~common(w), F.xxhash64(w)))  # null for a common word
    near = lambda i: [F.get(hashed, i + j) for j in range(-REACH, REACH + 1) if j]
    inside = lambda i: F.greatest(i - REACH, F.lit(0))
    bare = lambda i: ~F.exists(F.slice(hashed, inside(i) + 1, i + REACH + 1 - inside(i)), lambda h: h.isNull())
    least = lambda h, i: h < F.coalesce(F.least(*near(i)), F.lit((1 << 63) - 1))
    anchored = F.transform(words, lambda w, i: F.when((i > 0) & bare(i) & least(F.get(hashed, i), i), F.hash(
        F.lit(""), w, *[F.get(words, i + j) for j in range(1, CHAIN + 1)])))
    found = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.transform(content, spot)), F.array_compact(own))))
    whole = F.when(F.length(text) > 0, F.array(F.hash(text))).otherwise(F.array().cast("array<int>"))
    return (
        docs.withColumn(words, split)
        .withColumn(content, F.filter(pairs, lambda s: ~common(s["w"])))
        .withColumn(hashed, code)
        .withColumn(own, anchored)
        .withColumn(out, found)
        .withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(whole))
        .drop(words, content, hashed, own)
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard measure of two signature sets; sets that differ in being empty need no comparison."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(
        shared / (F.size(a) + F.size(b) - shared))


def written(signatures: Column) -> Column:
    return F.array_join(signatures.cast("array<string>"), ",")


def length_partition(size: Column, threshold: float = THRESHOLD) -> Column:
    """Number of the length partition: sets a factor of more than 1/threshold apart are never in neighbouring partitions."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / -math.log(threshold) + 1e-9)).otherwise(-1).cast("int")


def near_pairs(prints: DataFrame, key: str = "doc_id", signatures: str = "signatures", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Pairs of representatives (a, b, likeness) with likeness >= threshold, and the membership (key, representative).

    Equal fingerprints form a class, represented by its smallest key, so copies are never paired with each other.
    """
    rows = prints.select(F.col(key).alias("key"), F.col(signatures).alias("set")).filter(F.size("set") > 0)
    members = rows.groupBy("set").agg(F.min("key").alias("rep"))
    classes = stored(members.select("rep", "set", F.size("set").alias("n")), "spot-classes")
    frequency = classes.select(F.explode("set").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    ordered = classes.select("rep", "n", F.explode("set").alias("s")).join(frequency, "s")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "s"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    part = length_partition(F.col("n"), threshold)
    prefix = ordered.filter("df > 1").withColumn("at", place).filter(F.col("at") <= keep).select("rep", "n", "s", part.alias("part"))
    left = prefix.withColumn("part", F.explode(F.array("part", F.col("part") + 1))).select(F.col("rep").alias("a"), F.col("n").alias("n_a"), "s", "part")
    right = prefix.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), "s", "part")
    order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    found = left.join(right, ["s", "part"]).filter(order & (F.col("n_a") >= F.col("n_b") * threshold - 1e-9)).select("a", "b").distinct()
    one = classes.select(F.col("rep").alias("a"), F.col("set").alias("set_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
    pairs = found.join(one, "a").join(two, "b").withColumn("likeness", likeness(F.col("set_a"), F.col("set_b")))
    return (pairs.filter(F.col("likeness") >= threshold).select("a", "b", "likeness"),
            rows.join(members, "set").select(F.col("key").alias(key), "rep"))


def _slices(docs: DataFrame, key: str, count: int) -> Column:
    """Slice number of a key: a two-level search in the approximate quantiles of all keys."""
    shares = [i / count for i in range(1, count)]
    bounds = sorted(set(docs.agg(F.percentile_approx(key, shares, max(10_000, 20 * count)).alias("b")).first()["b"] or [])) if shares else []
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    groups = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    below = lambda array: F.size(F.filter(array, lambda x: x <= F.col(key)))
    tops = F.split(F.lit(",".join(str(g[0]) for g in groups)), ",").cast("array<bigint>")
    lists = F.from_json(F.lit(str(groups)), "array<array<bigint>>")
    top = below(tops)
    return F.when(F.col(key).isNull() | (top == 0), F.lit(0)).otherwise((top - 1) * width + below(F.get(lists, top - 1)))


def with_next(docs: DataFrame, key: str, carried: list[str], out: str) -> DataFrame:
    """Adds `out`: a struct of the columns `carried` of the next row by (key, first carried column); the last row gets the first one's."""
    placed = docs.withColumn("_slice", _slices(docs.select(key), key, 2 * parallelism(docs.sparkSession)))
    load = F.struct(*carried)
    borders = placed.groupBy("_slice").agg(F.min(F.struct(F.col(key), *carried)).alias("_first"))
    around = borders.select("_slice", F.coalesce(F.lead("_slice").over(Window.orderBy("_slice")), F.min("_slice").over(Window.partitionBy())).alias("_from"))
    firsts = borders.select(F.col("_slice").alias("_from"), F.struct(*[F.col(f"_first.{c}").alias(c) for c in carried]).alias("_border"))
    carry = around.join(firsts, "_from").select("_slice", "_border")
    inside = placed.withColumn("_inside", F.lead(load).over(Window.partitionBy("_slice").orderBy(key, carried[0])))
    return inside.join(carry, "_slice").withColumn(out, F.coalesce("_inside", "_border")).drop("_slice", "_inside", "_border")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `signatures`, `fingerprint`, `length_partition` of every row."""
    rows = spots(docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")), "_text", "signatures")
    return rows.select(key, "signatures", written(F.col("signatures")).alias("fingerprint"), length_partition(F.size("signatures")).alias("length_partition"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Every document against an edited form (its second half taken from the next document) and against the next document."""
    rows = spots(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "own")
    paired = with_next(rows, "doc_id", ["text", "own"], "next")
    cut = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    both = paired.select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", F.col("next.own").alias("next_own"), edited.alias("edited"))
    done = spots(both, "edited", "changed")
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("own")).alias("fingerprint"),
        written(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
        length_partition(F.size("own")).alias("length_partition"), F.size("own").cast("long").alias("n_spots"))
