"""Vector search, hashing embeddings and embedding-distance operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ordered import top_k
from ..session import cut

QUERY_BLOCK = 2048  # queries and vectors that meet in one cell
CORPUS_BLOCK = 16384
OVERSAMPLE = 4


def unit(vector: Column) -> Column:
    """Unit-length copy of an array column as doubles; a zero vector stays zero.

    The norm is an argument of the zip, not part of its lambda, so it is computed once per row.
    """
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(F.zip_with(v, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    return F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(left: Column, right: Column) -> Column:
    size = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(size > 0, dot(left, right) / size).otherwise(F.lit(0.0))


def _cells(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Both sides dealt into cells (space, block, shard), queries first; a cell lies in one partition.

    A space is a dimension and, where both sides have the column, a version: vectors of different spaces never meet.  Blocks of
    queries and shards of the corpus follow the counts of each space, so a cell holds about QUERY_BLOCK x CORPUS_BLOCK.
    """
    tagged = "version" in corpus.columns and "version" in queries.columns

    def rows(df: DataFrame, key: str, side: int) -> DataFrame:
        version = F.coalesce(F.col("version").cast("string"), F.lit("")) if tagged else F.lit("")
        space = F.concat_ws(":", F.size("vector").cast("string"), version)
        return df.filter("vector is not null").select(space.alias("space"), F.lit(side).alias("side"), F.col(key).alias(key), F.col("vector").cast("array<double>").alias("vector"))

    asked, held = rows(queries, "query_id", 0), rows(corpus, "vec_id", 1)
    parts = lambda df, size, out: df.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(out))
    shape = parts(asked, QUERY_BLOCK, "blocks").join(parts(held, CORPUS_BLOCK, "shards"), "space")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(shape, "space").withColumn("block", own("query_id", "blocks")).withColumn("shard", every("shards"))
    held = held.join(shape, "space").withColumn("shard", own("vec_id", "shards")).withColumn("block", every("blocks"))
    both = asked.drop("blocks", "shards").unionByName(held.drop("blocks", "shards"), allowMissingColumns=True)
    return both.repartition("space", "block", "shard").sortWithinPartitions("space", "block", "shard", "side")


def _units(vectors: list) -> np.ndarray:
    rows = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _int8(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers up to 127 and the scale of each row; kept as floats, whose products are exact at these sizes and fast."""
    peak = np.abs(units).max(axis=1, keepdims=True)
    whole = np.clip(np.rint(units * (127.0 / np.where(peak == 0, 1, peak))), -127, 127)
    return whole.astype(np.float32 if units.shape[1] < 1000 else np.float64), peak[:, 0] / 127.0


class _Cell:
    """The k best rows per query of one cell."""

    def __init__(self, k: int, int8: bool):
        self.k, self.int8, self.ids, self.asked, self.held, self.matrix = k, int8, [], [], [], None
        self.best: list[list[tuple]] = []

    def score(self) -> None:
        if not self.ids or not self.held:
            return
        if self.matrix is None:
            unit = _units(self.asked)
            self.matrix, self.best = (_int8(unit)[0] if self.int8 else unit), [[] for _ in self.ids]
        keys, unit = [key for key, _ in self.held], _units([v for _, v in self.held])
        if self.int8:
            whole, scale = _int8(unit)
            scores = np.round((self.matrix @ whole.T).astype(np.float64) * scale[None, :], 9)
        else:
            scores = np.round(self.matrix @ unit.T, 6)
        for i, row in enumerate(scores):
            edge = -np.partition(-row, self.k - 1)[self.k - 1] if row.size > self.k else -np.inf
            near = np.flatnonzero((row >= edge) & (self.int8 or row > 0))
            self.best[i] = sorted(self.best[i] + [(-row[j], keys[j]) for j in near])[:self.k]
        self.held = []

    def rows(self) -> list[tuple]:
        self.score()
        return [(query, key, float(-value)) for query, best in zip(self.ids, self.best, strict=False) for value, key in best]


def _partial_top(corpus: DataFrame, queries: DataFrame, k: int, int8: bool = False) -> DataFrame:
    """k best rows per query and cell: query_id, vec_id, score."""
    types = dict(corpus.select("vec_id").dtypes) | dict(queries.select("query_id").dtypes)

    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, cell, kinds = None, _Cell(k, int8), None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

        for batch in batches:
            kinds = [batch.schema.field("query_id").type, batch.schema.field("vec_id").type, pa.float64()]
            vectors = batch.column("vector")
            flat, bounds = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            out = []
            for i, (space, block, shard, side, query, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("space", "block", "shard", "side", *names[:2])), strict=True)):
                if place != (space, block, shard):
                    out += cell.rows()
                    place, cell = (space, block, shard), _Cell(k, int8)
                vector = np.nan_to_num(flat[bounds[i]:bounds[i + 1]])
                if side == 0:
                    cell.ids.append(query)
                    cell.asked.append(vector)
                elif cell.ids:
                    cell.held.append((key, vector))
                    if len(cell.held) == 4096:
                        cell.score()
            yield table(out)
        if kinds:
            yield table(cell.rows())

    return _cells(corpus, queries).mapInArrow(run, f"query_id {types['query_id']}, vec_id {types['vec_id']}, score double")


def exact_search(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Cosine top-k per query, positive scores only, ties by id: (query_id, vec_id, score, rank).

    Cells of queries and vectors are scored by matrix products and give k rows per query; no pair of rows crosses the network.
    Corpus: vec_id, vector; queries: query_id, vector; either may have version, and only equal dimensions and versions are compared.
    """
    return top_k(_partial_top(corpus, queries, k), ["query_id"], [F.desc("score"), F.col("vec_id")], k)


def quantised_candidates(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best k x OVERSAMPLE rows per query by int8 dot product."""
    n = k * OVERSAMPLE
    return top_k(_partial_top(corpus, queries, n, int8=True), ["query_id"], [F.desc("score"), F.col("vec_id")], n, out="_r").drop("_r")


def quantised_search(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """int8 candidate pass, then exact float64 rerank of the survivors."""
    survivors = quantised_candidates(corpus, queries, k).select("query_id", "vec_id")
    pairs = survivors.join(corpus.select("vec_id", "vector"), "vec_id").join(queries.select("query_id", F.col("vector").alias("_q")), "query_id")
    scored = pairs.select("query_id", "vec_id", F.round(cosine(F.col("vector"), F.col("_q")), 6).alias("score")).filter("score > 0")
    return top_k(scored, ["query_id"], [F.desc("score"), F.col("vec_id")], k)


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector per group; the dimension bounds what one group collects."""
    cells = vectors.select(group, F.posexplode("vector").alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return cells.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("vector"))


EMBED_BYTES = 1 << 22  # text whose tokens are held at a time, or one text


def _token_sums(dim: int):
    """Signed token counts per bucket of each lower-cased text."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def sums(texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        out, begin = [], 0
        while begin < len(texts):
            before = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, before + EMBED_BYTES, "right")))
            parts = pc.split_pattern_regex(texts.slice(begin, end - begin), r"[ \t\n\x0b\f\r]+")
            row, tokens = pc.list_parent_indices(parts).to_numpy(), pc.list_flatten(parts)
            # blanks at a text's ends leave empty tokens, which count only where there are no others
            full = pc.not_equal(tokens, "").to_numpy(zero_copy_only=False)
            alone = np.setdiff1d(np.arange(end - begin), row[full])
            coded = tokens.filter(pa.array(full)).dictionary_encode()
            digests = [hashlib.sha256(token.encode()).hexdigest() for token in ("", *coded.dictionary.to_pylist())]
            bucket = np.array([int(h[:8], 16) % dim for h in digests])
            sign = np.array([1.0 if int(h[9], 16) % 2 else -1.0 for h in digests])
            row = np.concatenate([row[full], alone])
            code = np.concatenate([coded.indices.to_numpy(zero_copy_only=False) + 1, np.zeros(len(alone), dtype=np.int64)]).astype(np.int64)
            out.append(np.bincount(row * dim + bucket[code], sign[code], minlength=(end - begin) * dim))
            begin = end
        flat = np.concatenate(out) if out else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(flat))

    return sums


def hash_embedding(texts: DataFrame, key: str, text: Column, dim: int = 64, unique: bool = False) -> DataFrame:
    """Feature-hash embedding: SHA-256 picks a bucket and a sign per whitespace token, then unit length.

    A text's tokens are counted where the text lies, each distinct token of a batch is hashed once, and only sums leave the task.  Texts of one key are
    one text; where keys are `unique` nothing moves at all.  Output: key, vector.
    """
    rows = texts.select(key, _token_sums(dim)(F.lower(text)).alias("_s"))
    if not unique:
        none = F.array_repeat(F.lit(0.0), dim)
        rows = rows.groupBy(key).agg(F.collect_list("_s").alias("_a")).select(
            key, F.aggregate("_a", none, lambda s, x: F.zip_with(s, x, lambda a, b: a + b)).alias("_s"))
    return rows.select(key, unit(F.col("_s")).alias("vector"))


def re_embed(stored: DataFrame, texts: DataFrame, key: str, text: Column, tag: str, dim: int = 64) -> DataFrame:
    """Rows of another version embedded again under `tag`; current rows pass through (stored: key, vector, version)."""
    current = stored.filter(F.col("version") == tag)
    stale = texts.join(stored.filter(F.col("version") != tag).select(key), key, "left_semi")
    return current.select(key, "vector", "version").unionByName(hash_embedding(stale, key, text, dim).withColumn("version", F.lit(tag)))


def version_counts(stored: DataFrame) -> DataFrame:
    return stored.groupBy("version").agg(F.count(F.lit(1)).alias("entities"))


def _sums(vectors: DataFrame, group: str) -> DataFrame:
    """Sum of unit vectors and row count per group."""
    cells = vectors.select(group, F.posexplode("u").alias("i", "x")).groupBy(group, "i").agg(F.sum("x").alias("x"))
    total = cells.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("s"))
    return total.join(vectors.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group)


def medoids(vectors: DataFrame, group: str) -> DataFrame:
    """Row with the smallest mean cosine distance to the others of its group.

    sum over others of (1 - cos) = (n - 1) - (v . S - v . v) with S the sum of unit vectors, so one pass
    replaces all pairs.
    """
    rows = vectors.select(group, "vec_id", unit(F.col("vector")).alias("u"))
    joined = rows.join(_sums(rows, group), group)
    others = F.greatest(F.col("n") - 1, F.lit(1))
    distance = F.when(F.col("n") > 1, 1.0 - (dot(F.col("u"), F.col("s")) - dot(F.col("u"), F.col("u"))) / others).otherwise(F.lit(0.0))
    scored = joined.select(group, "vec_id", F.round(distance, 9).alias("distance"))
    return scored.groupBy(group).agg(F.min(F.struct("distance", "vec_id")).alias("m")).select(
        group, F.col("m.vec_id").alias("vec_id"), F.col("m.distance").alias("distance"))


def mean_distance(vectors: DataFrame, group: str) -> DataFrame:
    """Mean pairwise cosine distance per group from |S|^2, without pairs."""
    rows = vectors.select(group, "vec_id", unit(F.col("vector")).alias("u"))
    sums = _sums(rows, group)
    own = rows.groupBy(group).agg(F.sum(dot(F.col("u"), F.col("u"))).alias("_own"))
    out = sums.join(own, group)
    pairs = F.col("n") * (F.col("n") - 1)
    spread = F.when(pairs > 0, 1.0 - (dot(F.col("s"), F.col("s")) - F.col("_own")) / pairs).otherwise(F.lit(0.0))
    return out.select(group, F.col("n").alias("rows"), F.round(spread, 6).alias("spread"))


def k_centres(vectors: DataFrame, group: str, k: int, cut_every: int = 4) -> DataFrame:
    """Medoid first, then k - 1 rounds of the row farthest from all chosen: (group, position, vec_id).

    A round keeps one number per row (similarity to the nearest chosen row) and picks one row per group
    with a map-side combined maximum.
    """
    rows = vectors.select(group, "vec_id", unit(F.col("vector")).alias("u"))
    last = medoids(vectors, group).select(group, "vec_id")
    chosen = last.withColumn("position", F.lit(1))
    state = rows.withColumn("near", F.lit(-2.0))
    for step in range(2, k + 1):
        centre = rows.join(last, [group, "vec_id"]).select(group, F.col("vec_id").alias("_cid"), F.col("u").alias("_c"))
        state = (state.join(centre, group).filter("vec_id <> _cid")
                 .withColumn("near", F.greatest("near", F.round(dot(F.col("u"), F.col("_c")), 9))).drop("_c", "_cid"))
        if (step - 1) % cut_every == 0:
            state = cut(state)
        last = state.groupBy(group).agg(F.min(F.struct("near", "vec_id")).alias("m")).select(group, F.col("m.vec_id").alias("vec_id"))
        chosen = chosen.unionByName(last.withColumn("position", F.lit(step)))
    return chosen


def kth_score(truth: DataFrame, k: int) -> DataFrame:
    """Score of the k-th exact hit per query (truth: query_id, vec_id, score)."""
    ranked = top_k(truth, ["query_id"], [F.desc("score"), F.col("vec_id")], k, out="_r")
    return ranked.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("want"))


def recall_at_k(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Strict and tie-aware recall@k per query; `found` rows carry exact scores, so a tie at the border counts as a hit."""
    ideal = top_k(truth, ["query_id"], [F.desc("score"), F.col("vec_id")], k, out="_r").select("query_id", "vec_id", F.lit(1).alias("_hit"))
    border = kth_score(truth, k)
    rows = border.join(found.select("query_id", "vec_id", "score"), "query_id", "left").join(ideal, ["query_id", "vec_id"], "left")
    return rows.groupBy("query_id").agg(
        F.round(F.count("_hit") / F.first("want"), 6).alias("strict_recall"),
        F.round(F.least(F.lit(1.0), F.count_if(F.col("score") >= F.col("kth")) / F.first("want")), 6).alias("tie_aware_recall"))
