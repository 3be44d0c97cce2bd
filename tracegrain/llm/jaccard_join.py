"""N-gram Jaccard self-join by token-combination prefixes (operator 6).

Sets of word shingles link when their Jaccard measure is at least THRESHOLD.  All shingles have one global order: rare ones first, by
length (long words seldom meet by chance) and hash, then frequent ones by count.  A set's prefix is its beginning in this order, and its signatures are

* each rare shingle of the prefix by itself, and
* each pair of frequent shingles of the prefix that lie in the same group.

Two linked sets differ in at most n - ceil(0.8 n) shingles of either.  If they shared no signature, the prefix of one of them would hold, besides
one shared frequent shingle per group, only shingles that the other set lacks; so a prefix is extended until (rare ones) + (frequent
ones less one per group) exceeds that number, and then none is lost.  Groups are dealt by hash; how many there are follows the size
class of the set (sizes grow by 1/0.8), so that a group holds a few shingles, and a set speaks for its own class and the next.

Whether a shingle is frequent is counted over all documents: tasks send the counts' hashes in packed blocks by hash range.  The most
frequent FREQUENT_TOKENS with at least FREQUENT_COUNT documents are broadcast.  The choice moves work only, never a result.

Equal sets are one node from the start.  The sets that share a signature are compared with its smallest node (the centre) first.  The links found
give components; the sets of a centre that are not linked to it are then compared with all sets of that centre which are in another component, in
blocks, where neither size nor distance to the centre rules it out (Jaccard distance is a metric).  So a group of thousands of near copies costs
one comparison each, and no pair is left out that could connect two components.  Pairs are screened first by sizes, then by bitmaps of the parities
of hashed shingles: the bits in which two differ are no more than the shingles in which the sets differ, so what fails is not linked for certain, and
shingles move only for the rest.  A bitmap has at least two bits for each shingle; of two lengths the longer is folded.  Comparisons are exact counts of
shared shingles.

Defined results: null or blank texts have no shingles, n_shingles 0 and their own id as component; texts below five words have one shingle;
repeated rows belong to the component of their id; rows without an id get none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import arrow_bytes, coarse, stored
from .arrow import BATCH_BYTES, pieces, released
from .components import components
from .shingle_sets import digest, shingles, signed

PERCENT = 80
FREQUENT_COUNT = 3
FREQUENT_TOKENS = 1_000_000
GROUP_TOKENS = 4
LEAST_SIZE = 4  # smaller sets link with equal sets only
FLUSH_TOKENS = 1 << 20
SEEN_SETS = 200_000
FIRST_BLOCK, SECOND_BLOCK = 256, 1024
BROADCAST_NODES = 500_000
LEAST_BITS = 2048


class Seen(set):
    """Digests that a task has met lately; a bounded set that only saves work."""

    def fresh(self, value: int) -> bool:
        if value in self:
            return False
        if len(self) >= SEEN_SETS:
            self.clear()
        self.add(value)
        return True


def needed(n: int) -> int:
    """One more than the most shingles that a set of n may have beyond a linked set."""
    return n - -(-PERCENT * n // 100) + 1


def size_class(n: int) -> int:
    return int(math.log(n) / math.log(100 / PERCENT) + 1e-9)


def groups_of(klass: int) -> int:
    return max(1, int((100 / PERCENT) ** klass * (100 - PERCENT) / 100 / GROUP_TOKENS))


def signatures(tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Signed 64-bit signatures of a set; `frequent` (sorted, the upper 40 bits of shingles) and its `counts` say what is frequent."""
    n = len(tokens)
    if n < LEAST_SIZE:
        return np.empty(0, np.int64)
    count = np.zeros(n, np.int64)
    if len(frequent):
        key = tokens >> np.uint64(24)
        at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
        count = np.where(frequent[at] == key, counts[at], 0)
    rare, want = tokens[count == 0], needed(n)
    if len(rare) >= want:
        return rare[:want].view(np.int64)
    common = tokens[count > 0][np.argsort(count[count > 0], kind="stable")].tolist()
    out = [rare.view(np.int64)]
    for klass in (size_class(n), size_class(n) + 1):
        n_groups, members, held = groups_of(klass), {}, len(rare)
        for token in common:
            if held >= want:
                break
            own = members.setdefault((token >> 16) % n_groups, [])
            held += bool(own)
            own.append(token)
        pairs = [(min(a, b), max(a, b)) for own in members.values() for i, a in enumerate(own) for b in own[:i]]
        out.append(np.array([signed(xxhash.xxh3_64_intdigest(b"%d %d %d" % (klass, a, b))) for a, b in pairs], dtype=np.int64))
    return np.unique(np.concatenate(out))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, tokens) of batches with key and text."""
    for batch in released(batches):
        for part in pieces(batch, "text"):
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                yield key, shingles(text)


def classes(docs: DataFrame) -> DataFrame:
    """key, n_shingles, node (digest of the set; null for an empty set) and bits (its bitmap) of every row of (key, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in pieces(batch, "text"):
                sets = [tokens for _, tokens in _sets([part])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.int64()),
                     pa.array([bitmap(s).tobytes() if len(s) >= LEAST_SIZE else None for s in sets], pa.binary())], names=["key", "n_shingles", "node", "bits"])

    return docs.mapInArrow(run, "key long, n_shingles long, node long, bits binary")


def frequent_tokens(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles over all documents (upper 40 bits, sorted) and their counts; at most FREQUENT_TOKENS."""
    bits = max(1, (buckets - 1).bit_length())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, Seen()

        def flush() -> pa.RecordBatch:
            key = np.sort(np.concatenate(held)) >> np.uint64(24)
            bucket = (key >> np.uint64(40 - bits)).astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            low = (key & np.uint64((1 << (40 - bits)) - 1)).astype("<u4" if bits >= 8 else "<u8")
            blocks = [b.tobytes() for b in np.split(low, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

        for _, tokens in _sets(batches):
            if len(tokens) >= LEAST_SIZE and seen.fresh(digest(tokens)):
                held.append(tokens)
                size += len(tokens)
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(bucket: int, blocks: list[bytes]) -> pa.RecordBatch:
            value, n = np.unique(np.frombuffer(b"".join(blocks), dtype="<u4" if bits >= 8 else "<u8"), return_counts=True)
            value, n = value[n >= FREQUENT_COUNT], n[n >= FREQUENT_COUNT]
            return pa.RecordBatch.from_arrays([pa.array((value.astype(np.int64) | (bucket << (40 - bits))), pa.int64()), pa.array(n, pa.int64())], names=["token", "n"])

        own, blocks = None, []
        for batch in released(batches):
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != own and blocks:
                    yield counted(own, blocks)
                    blocks = []
                own = bucket
                blocks.append(block)
        if blocks:
            yield counted(own, blocks)

    blocks = docs.mapInArrow(pack, "bucket int, block binary").repartition("bucket").sortWithinPartitions("bucket")
    top = blocks.mapInArrow(count, "token long, n long").orderBy(F.desc("n"), "token").limit(FREQUENT_TOKENS).toArrow()
    token, n = top.column("token").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(token, kind="stable")
    return token[order].astype(np.uint64), np.minimum(n[order], 2 ** 31 - 1).astype(np.int32)


def _index(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """signature, node."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of, counts = shared.value
        seen, out, nodes, size = Seen(), [], [], 0
        for _, tokens in _sets(batches):
            node = digest(tokens)
            if len(tokens) >= LEAST_SIZE and seen.fresh(node):
                own = signatures(tokens, tokens_of, counts)
                out.append(own)
                nodes.append(np.full(len(own), node))
                size += len(own)
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(nodes))], names=["signature", "node"])
                    out, nodes, size = [], [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(nodes))], names=["signature", "node"])

    return docs.mapInArrow(run, "signature long, node long")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _linked(shared: int, n: int, m: int) -> bool:
    return 100 * shared >= PERCENT * (n + m - shared)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles at each of so many places: a power of two, at least LEAST_BITS and two for each shingle."""
    bits = max(LEAST_BITS, 1 << (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (along the last axis) as they are at a smaller number of places."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _possible(bits: np.ndarray, sizes: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Whether sets with these bitmaps (of one length) and sizes can be linked to the one with `own` and n."""
    words = min(bits.shape[-1], own.shape[-1])
    apart = np.bitwise_count(folded(bits, words) ^ folded(own, words)).sum(axis=-1, dtype=np.int64)
    few = apart * (100 + PERCENT) <= (sizes + n) * (100 - PERCENT)
    return few & (np.minimum(sizes, n) * 100 >= np.maximum(sizes, n) * PERCENT)


def _screen(rows: DataFrame) -> DataFrame:
    """centre, node, possible from centre, node, bits, n, centre_bits, centre_n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            bits, other = ([np.frombuffer(b, np.uint64) for b in batch.column(k).to_pylist()] for k in (2, 4))
            n, m = (batch.column(k).to_pylist() for k in (3, 5))
            possible = [bool(_possible(*row)) for row in zip(bits, n, other, m, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(possible, pa.bool_())], names=["centre", "node", "possible"])

    return rows.select("centre", "node", "bits", "n", "centre_bits", "centre_n").mapInArrow(run, "centre long, node long, possible boolean")


def _compare(rows: DataFrame) -> DataFrame:
    """centre, node, distance, linked from node, tokens, centre, centre_tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            own = [(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            shared = [_shared(a, b) for a, b in own]
            linked = [_linked(s, len(a), len(b)) for s, (a, b) in zip(shared, own, strict=True)]
            distance = [1 - s / (len(a) + len(b) - s) for s, (a, b) in zip(shared, own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance, pa.float64()), pa.array(linked, pa.bool_())],
                                             names=["centre", "node", "distance", "linked"])

    return rows.select("centre", "node", "tokens", "centre_tokens").mapInArrow(run, "centre long, node long, distance double, linked boolean")


def _dealt(members: DataFrame, payload: DataFrame) -> DataFrame:
    """Members of centres in blocks, with the columns of `payload` (node and others): the unlinked ones of `u` (side 0) and all of `m` (side 1), sorted, a
    block in one partition.  Centres whose members are all in one component have nothing left to find."""
    stars = members.groupBy("centre").agg(F.count(F.lit(1)).alias("n_all"), F.sum((~F.col("linked")).cast("long")).alias("n_open"),
                                          F.min("part").alias("low"), F.max("part").alias("high"))
    parts = stars.filter("n_open > 0 and low <> high").select(
        F.col("centre").alias("_centre"), F.ceil(F.col("n_open") / FIRST_BLOCK).cast("int").alias("n_u"), F.ceil(F.col("n_all") / SECOND_BLOCK).cast("int").alias("n_m"))
    own = members.join(parts, F.col("centre") == F.col("_centre")).join(payload, "node")
    spread = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n.cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["centre", "u", "m", "side", "node", "part", "distance", *(c for c in payload.columns if c != "node")]
    first = own.filter("not linked").withColumn("u", spread(F.col("n_u"), 1)).withColumn("m", every(F.col("n_m"))).withColumn("side", F.lit(0))
    second = own.withColumn("m", spread(F.col("n_m"), 2)).withColumn("u", every(F.col("n_u"))).withColumn("side", F.lit(1))
    placed = first.select(*columns).union(second.select(*columns)).repartition("centre", "u", "m")
    return placed.sortWithinPartitions("centre", "u", "m", "side")


def _near(distances: np.ndarray, distance: float) -> np.ndarray:
    """What distances to the centre allow; an unknown one (NaN) rules nothing out."""
    return ~(np.abs(distances - distance) > 1 - PERCENT / 100 + 1e-9)


def _active(members: DataFrame, small: DataFrame) -> DataFrame:
    """centre, node of the members that, by bitmaps, can be linked to a member in another component; members has centre, node, distance, linked, part."""
    def tables(first: list[tuple]) -> list[tuple]:
        lengths = {}
        for row in first:
            lengths.setdefault(len(row[3]), []).append(row)
        return [tuple(np.array([row[k] for row in rows]) for k in range(5)) for rows in lengths.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, held = None, [], None
        for batch in released(batches):
            found = set()
            for centre, u, m, side, node, part, distance, n, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != (centre, u, m):
                    own, first, held = (centre, u, m), [], None
                bits = np.frombuffer(bits, np.uint64)
                if side == 0:
                    first.append((node, part, distance, bits, n))
                elif first:
                    held = held or tables(first)
                    for nodes, parts, distances, all_bits, sizes in held:
                        near = _possible(all_bits, sizes, bits, n) & _near(distances, distance) & (parts != part)
                        if near.any():
                            found.add((centre, node))
                            found.update((centre, x) for x in nodes[near].tolist())
            found = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["centre", "node"])

    return _dealt(members, small.select("node", "n", "bits")).mapInArrow(run, "centre long, node long").distinct()


def _blocks(members: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links (a, b) of unlinked members with others, those that connect components of their block; members has centre, node, distance, linked, part."""
    def links(first: list[tuple], second: tuple, parent: dict[int, int], table: tuple) -> Iterator[tuple[int, int]]:
        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        node, part, distance, tokens = second
        all_tokens, owner, sizes, distances = table
        n = len(tokens)
        at = np.searchsorted(tokens, all_tokens)
        shared = np.bincount(owner[tokens[np.minimum(at, n - 1)] == all_tokens], minlength=len(first))
        near = (100 * shared >= PERCENT * (sizes + n - shared)) & _near(distances, distance)
        for i in np.flatnonzero(near):
            a, b = root(first[i][1]), root(part)
            if a != b:
                parent[a] = b
                yield first[i][0], node

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, table, parent = None, [], None, {}
        for batch in released(batches):
            found = []
            for centre, u, m, side, node, part, distance, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != (centre, u, m):
                    own, first, table, parent = (centre, u, m), [], None, {}
                row = (node, part, distance, np.frombuffer(tokens, "<u8"))
                if side == 0:
                    first.append(row)
                elif first:
                    if table is None:
                        table = (np.concatenate([f[3] for f in first]), np.repeat(np.arange(len(first)), [len(f[3]) for f in first]),
                                 np.array([len(f[3]) for f in first]), np.array([f[2] for f in first]))
                    found += links(first, row, parent, table)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return _dealt(members, tokens).mapInArrow(run, "a long, b long").filter("a <> b")


def links(docs: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """Links (a, b) between nodes that give the components of all links; `docs` has key and text, about `rows` rows, `nodes` node, its smallest key, n and bits."""
    buckets = 1 << min(20, max(8, (max(1, rows) // 256).bit_length()))
    index = _index(docs, frequent_tokens(docs, buckets))
    centre = F.first("node").over(Window.partitionBy("signature").orderBy("node"))
    stars = stored(coarse(index.withColumn("centre", centre).filter("centre <> node").select("centre", "node").distinct(), rows), "stars")
    around = lambda df: df.select(*[F.col(c).alias("centre" if c == "node" else f"centre_{c}") for c in df.columns])
    sizes, small = nodes.select("node", "n"), nodes.select("node", "n", "bits")
    fits = F.least("n", "centre_n") * 100 >= F.greatest("n", "centre_n") * PERCENT
    sized = stored(coarse(stars.join(sizes, "node").join(around(sizes), "centre").select("centre", "node", fits.alias("fits")), rows), "sized")
    screened = stored(coarse(_screen(sized.filter("fits").join(small, "node").join(around(small), "centre")), rows), "screened")
    unlike = sized.filter("not fits").select("centre", "node").union(screened.filter("not possible").select("centre", "node"))
    unlike = unlike.select("centre", "node", F.lit(float("nan")).alias("distance"), F.lit(False).alias("linked"))
    hopeful = screened.filter("possible").select("centre", "node")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in pieces(batch, "text", 1 << 20):
                sets = [tokens for _, tokens in _sets([part])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"])

    def fetched(wanted: DataFrame) -> DataFrame:
        """node and tokens of the nodes in `wanted`."""
        ids = stored(coarse(wanted.distinct().join(nodes, "node").select(F.col("key").alias("_key")), rows), "wanted")
        if ids.count() <= BROADCAST_NODES:  # their ids go to the texts; beyond that both sides are shuffled
            ids = F.broadcast(ids)
        texts = docs.join(ids, F.col("key") == F.col("_key"), "left_semi")
        return stored(coarse(texts.mapInArrow(packed, "node long, tokens binary").dropDuplicates(["node"]), rows), "tokens")

    # shingles are fetched for the pairs that passed, then for members that may link two components
    tokens = fetched(hopeful.select("node").union(hopeful.select("centre")))
    compared = stored(coarse(_compare(hopeful.join(tokens, "node").join(around(tokens), "centre")).union(unlike), rows), "compared")
    tree = stored(coarse(components(compared.filter("linked").select(F.col("centre").alias("a"), F.col("node").alias("b"))), rows), "tree")
    members = stored(coarse(compared.join(tree, "node", "left").select(
        "centre", "node", "distance", "linked", F.coalesce("component", "node").alias("part")), rows), "members")
    active = stored(coarse(_active(members, small), rows), "active")
    more = _blocks(members.join(active, ["centre", "node"], "left_semi"), fetched(active.select("node")))
    return tree.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_shingles`, `component_id` of every row."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    with arrow_bytes(docs.sparkSession, BATCH_BYTES):  # rows hold a bitmap or all shingles of two texts
        own = stored(classes(rows), "classes")
        n_rows = own.count()
        nodes = own.filter("node is not null and key is not null").groupBy("node").agg(
            F.min("key").alias("key"), F.min("n_shingles").alias("n"), F.min("bits").alias("bits"))
        nodes = stored(coarse(nodes, n_rows), "nodes")
        parts = components(links(rows.filter("key is not null"), nodes, n_rows))  # a set without an id is no node and must not be a centre
    named = nodes.select("node", "key").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = named.groupBy("part").agg(F.min("key").alias("component_id"))
    placed = named.join(least, "part").select(F.col("node").alias("_node"), "component_id")
    return own.drop("bits").join(placed, F.col("node") == F.col("_node"), "left").select(
        F.col("key").alias(key), "n_shingles", F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without those whose component has a smaller id."""
    copies = join(docs, key, text).filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("_copy")).distinct()
    return docs.join(copies, F.col(key).cast("long") == F.col("_copy"), "left_anti")
