"""Graph traversal and personalised PageRank over edge tables.

Edges: src, dst, relation (and citation for causal edges).  A hub may own a third of all edges, so edge rows are
spread by (node, salt) and the small frontier row is repeated per salt, or by packed cells that go on as another one when full.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ordered import salted_join
from ..session import cut, discard, parallelism, stored, swept


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions; `edges` is read once."""
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.withColumn("_way", both).withColumns({"src": F.col("_way.src"), "dst": F.col("_way.dst")}).drop("_way")


def traverse(edges: DataFrame, starts: DataFrame, depth: int = 2, relation: str | None = None, salts: int = 8) -> DataFrame:
    """Bounded breadth-first search: (start, node, hops, relations, citations); the first, smallest path wins.

    One join per level against unseen nodes only.  Starts: start.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    if relation is not None:
        edges = edges.filter(F.col("relation") == relation)
    if "citation" not in edges.columns:
        edges = edges.withColumn("citation", F.lit(None).cast("string"))
    steps = edges.select("src", "dst", "relation", "citation").distinct()  # copies of an edge would share one salt
    empty = F.array().cast("array<string>")
    frontier = starts.select("start", F.col("start").alias("node"), empty.alias("relations"), empty.alias("citations"), F.array("start").alias("path"))
    seen = frontier.select("start", "node")
    found = None
    for hop in range(1, depth + 1):
        ahead = frontier.withColumnRenamed("node", "src").withColumnRenamed("relations", "_rels").withColumnRenamed("citations", "_cites")
        reached = salted_join(steps, ahead, ["src"], salts=salts).select(
            "start", F.col("dst").alias("node"), F.struct(
                F.concat("path", F.array("dst")).alias("path"), F.concat("_rels", F.array("relation")).alias("relations"),
                F.concat("_cites", F.array("citation")).alias("citations")).alias("p"))
        level = reached.join(seen, ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min("p").alias("p"))
        level = level.select("start", "node", F.lit(hop).alias("hops"), "p.relations", "p.citations", "p.path")
        if hop < depth:
            level = cut(level)
            seen = seen.unionByName(level.select("start", "node"))
            frontier = level.drop("hops")
        found = level if found is None else found.unionByName(level)
    return found.drop("path")


def causal_neighbours(edges: DataFrame, starts: DataFrame, direction: str, depth: int = 2, relation: str | None = None) -> DataFrame:
    """Directed search over causal edges; `predecessors` walks them backwards.  Every hop keeps relation and citation."""
    if direction not in ("successors", "predecessors"):
        raise ValueError("direction must be successors or predecessors")
    if direction == "predecessors":
        edges = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return traverse(edges, starts, depth, relation)


TEST_EVERY = 5
CELL_EDGES = 1 << 22
GROUP_NODES = 1 << 20
DEAL_EDGES = 1 << 21
SWEEP_EVERY = 3
_CHUNK = 1 << 16


def _deflated(x: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, compressed."""
    return zlib.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _inflated(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _sparse(x: np.ndarray) -> tuple[bytes, bytes]:
    at = np.flatnonzero(x)
    return at.astype("<i4").tobytes(), x[at].tobytes()


def _add(x: np.ndarray, idx: bytes, values: bytes, factor: float = 1.0) -> None:
    x[np.frombuffer(idx, "<i4")] += factor * np.frombuffer(values, "<f8")


def _blobs(rows: DataFrame, keys: list[str], columns: dict[str, str], parts: int) -> DataFrame:
    """One row per `keys` with each of `columns` (name: numpy kind) as the bytes of its values, in the order of the first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, schema = None, [], None

        def packed() -> pa.RecordBatch:
            found = [[k] for k in own] + [[b"".join(x)] for x in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, schema, strict=True)], names=[*keys, *columns])

        for batch in batches:
            schema = [batch.schema.field(k).type for k in keys] + [pa.binary()] * len(columns)
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            values, at = [batch.column(c).to_numpy(zero_copy_only=False).astype(kind) for c, kind in columns.items()], 0
            for key, run in groupby(names):
                if key != own and held:
                    yield packed()
                    held = []
                own, end = key, at + sum(1 for _ in run)
                held.append([v[at:end].tobytes() for v in values])
                at = end
        if held:
            yield packed()

    kinds = dict(rows.dtypes)
    rows = rows.select(*keys, *columns).repartition(parts, *keys).sortWithinPartitions(*keys, next(iter(columns)))
    return rows.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{c} binary" for c in columns)]))


class _Layout:
    """Edges in cells by groups of nodes at both ends, packed; nodes numbered within their group.

    Groups are hashes of nodes; a cell holds the edges from one group to another as sorted pairs of numbers, two to three bytes each, and
    a cell of more than `hub_edges` edges goes on as another one, so a hub's edges are spread.  With `both` an edge leads both ways and is held once.
    What moves in a step is one packed vector per group, query and cell on the way in and on the way out: nodes x side numbers, not one per edge.
    A null node passes nothing on.
    """

    def __init__(self, edges: DataFrame, hub_edges: int | None, both: bool):
        self.spark, self.both = edges.sparkSession, both
        self.most = hub_edges or 2 * CELL_EDGES
        edges = stored(edges.select("src", "dst"), "edges")
        ways = [F.struct(F.col(end).alias("node"), F.lit(int(out)).alias("out")) for end, out in (("src", True), ("dst", both))]
        nodes = edges.select(F.explode(F.array(*ways)).alias("e")).groupBy("e.node").agg(F.sum("e.out").alias("deg"))
        nodes = stored(nodes.withColumn("deg", F.when(F.col("node").isNull(), 0).otherwise(F.col("deg")).cast("long")), "degrees")
        self.side = max(1, math.ceil(math.sqrt((1 + both) * edges.count() / CELL_EDGES)), math.ceil(nodes.count() / GROUP_NODES))
        self.parts = max(parallelism(self.spark), self.side)
        for seed in range(16):
            key = lambda c, seed=seed: F.xxhash64(F.lit(seed), c)
            rows = nodes.withColumn("hash", key("node")).withColumn("group", F.pmod("hash", F.lit(self.side)).cast("int"))
            order = Window.partitionBy("group").orderBy("hash")  # about GROUP_NODES rows
            self.nodes = stored(rows.withColumns({"idx": F.row_number().over(order) - 1, "twin": F.col("hash").eqNullSafe(F.lag("hash").over(order))}), "nodes")
            if self.nodes.filter("twin").isEmpty():
                break
            discard(self.nodes)
        else:
            raise ValueError("no seed keeps the nodes apart")
        discard(nodes)
        self.dangling = not self.nodes.filter("deg = 0").isEmpty()
        self.groups = stored(_blobs(self.nodes, ["group"], {"hash": "<i8", "deg": "<i8"}, self.parts), "groups")
        self.cells = stored(self._cells(edges.select(key("src").alias("a"), key("dst").alias("b"))), "cells")
        discard(edges)
        # a row per cell: each cell is a task of a step
        self.places = stored(self.cells.select("cell", "g", "h", (F.row_number().over(Window.orderBy("cell")) - 1).alias("place")), "places")
        self.tasks = max(1, self.places.count())
        ends = F.array_distinct(F.array("g", "h")) if both else F.array("g")
        self.ends = self.places.select("place", F.explode(ends).alias("group"))
        swept(self.spark)

    def _deal(self, edges: DataFrame) -> DataFrame:
        """cell, kind, a, b: hashes of both ends, packed by cell within each task."""
        side, both = self.side, self.both

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def packed() -> pa.RecordBatch:
                a, b = (np.concatenate(x) for x in zip(*held, strict=True))
                if both:
                    turn = a % side > b % side
                    a, b = np.where(turn, b, a), np.where(turn, a, b)
                cell = a % side * side + b % side
                order = np.lexsort((a, cell))
                a, b, cell = a[order], b[order], cell[order]
                cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
                spans = list(zip(cuts, cuts[1:], strict=False))
                return pa.RecordBatch.from_arrays([pa.array(cell[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(spans), 2, np.int32)),
                                                   *(pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (a, b))], names=["cell", "kind", "a", "b"])

            for batch in batches:
                held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")])
                size += batch.num_rows
                if size >= DEAL_EDGES:
                    yield packed()
                    held, size = [], 0
            if size:
                yield packed()

        return edges.mapInArrow(run, "cell int, kind int, a binary, b binary")

    def _cells(self, edges: DataFrame) -> DataFrame:
        """cell, g, h, n_g, n_h, keys, m: edges as sorted numbers of pairs (differences, packed) and how often each is there (empty: once)."""
        side, both, most = self.side, self.both, self.most
        cell = self.spark.range(side * side).select(F.col("id").cast("int").alias("cell"), F.floor(F.col("id") / side).cast("int").alias("g"), (F.col("id") % side).cast("int").alias("h"))
        if both:
            cell = cell.filter("g <= h")
        lists = [self.groups.withColumnRenamed("group", end).join(cell, end).select("cell", F.lit(kind).alias("kind"), F.col("hash").alias("a"), F.lit(None).cast("binary").alias("b"))
                 for kind, end in enumerate(("g", "h"))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, named, held, size, turn = None, [None, None], [], 0, 0

            def packed() -> pa.RecordBatch:
                a, b = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(a, kind="stable")
                rows, columns = np.searchsorted(named[0], a[order]), np.searchsorted(named[1], b[order])
                keys, m = np.unique(rows * len(named[1]) + columns, return_counts=True)
                row = [at + turn * side * side, at // side, at % side, len(named[0]), len(named[1]), _deflated(np.diff(keys, prepend=np.int64(0))), _deflated(m) if m.max() > 1 else b""]
                kinds = [pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["cell", "g", "h", "n_g", "n_h", "keys", "m"])

            for batch in batches:
                for place, kind, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if place != at:
                        if held:
                            yield packed()
                        at, held, size, turn = place, [], 0, 0
                    a = np.frombuffer(a, "<i8")
                    if kind < 2:
                        named[kind] = a
                        continue
                    b = np.frombuffer(b, "<i8")
                    while size + len(a) >= most:  # a full cell goes on as another one
                        held.append((a[:most - size], b[:most - size]))
                        a, b = a[most - size:], b[most - size:]
                        yield packed()
                        held, size, turn = [], 0, turn + 1
                    if len(a):
                        held.append((a, b))
                        size += len(a)
            if held:
                yield packed()

        rows = lists[0].unionByName(lists[1]).unionByName(self._deal(edges))
        rows = rows.repartitionById(max(self.parts, side * side), F.col("cell")).sortWithinPartitions("cell", "kind")
        return rows.mapInArrow(run, "cell long, g int, h int, n_g int, n_h int, keys binary, m binary")

    def passed(self, sent: DataFrame) -> DataFrame:
        """group, query, idx, x: what arrives at the ends of edges, in parts, of rows `sent` (group, query, idx, x) with what each edge of a node carries."""
        both, query = self.both, dict(sent.dtypes)["query"]
        blank = {"g": "int", "h": "int", "n_g": "int", "n_h": "int"}
        held = self.cells.join(self.places.select("cell", "place"), "cell").select("place", F.lit(0).alias("kind"), F.lit(None).cast(query).alias("query"), F.lit(None).cast("int").alias("group"),
                                 F.col("keys").alias("idx"), F.col("m").alias("x"), *blank)
        news = sent.join(self.ends, "group").select("place", F.lit(1).alias("kind"), "query", "group", "idx", "x", *(F.lit(None).cast(t).alias(c) for c, t in blank.items()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, own, x, kind_of = (), None, {}, None
            rows = columns = m = None

            def along(start: np.ndarray, end: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
                carried = value[start]
                at = np.flatnonzero(carried)
                return np.bincount(end[at], carried[at] if m is None else carried[at] * m[at], n)

            def arrived() -> Iterator[pa.RecordBatch]:
                g, h, n_g, n_h = place
                found = [(h, along(rows, columns, x[g], n_h))] if g in x else []
                if both and h in x:
                    found.append((g, along(columns, rows, x[h], n_g)))
                blobs = [_sparse(y) for _, y in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in found], pa.int32()), pa.array([own] * len(found), kind_of), pa.array([b[0] for b in blobs], pa.binary()),
                     pa.array([b[1] for b in blobs], pa.binary())], names=["group", "query", "idx", "x"])

            for batch in batches:
                kind_of = batch.schema.field("query").type
                for _, kind, query, group, idx, value, *cell in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if x and (kind == 0 or query != own):
                        yield from arrived()
                        x = {}
                    if kind == 0:
                        place = tuple(cell)
                        rows, columns = np.divmod(np.cumsum(_inflated(idx)), place[3])
                        m = _inflated(value) if value else None
                    else:
                        own, x[group] = query, np.zeros(place[2] if group == place[0] else place[3])
                        _add(x[group], idx, value)
            if x:
                yield from arrived()

        rows = held.unionByName(news)
        rows = rows.repartitionById(self.tasks, F.col("place")).sortWithinPartitions("kind", "query")
        return rows.mapInArrow(run, f"group int, query {query}, idx binary, x binary")

    def restart(self, seeds: DataFrame) -> DataFrame:
        """group, query, idx, x: the share of each seed (query, node) that is a node; seeds of a query are all alike."""
        start = stored(self.nodes.join(seeds.select("query", "node").distinct(), "node").select("group", "query", "idx"), "seeds")
        count = start.groupBy("query").agg(F.count(F.lit(1)).alias("_n"))
        return stored(_blobs(start.join(count, "query").withColumn("x", 1 / F.col("_n")), ["group", "query"], {"idx": "<i4", "x": "<f8"}, self.parts), "restart")

    def round(self, state: DataFrame | None, active: DataFrame | None, restart: DataFrame, alpha: float, settle: float, back: float = 0.0) -> DataFrame:
        """The state after all nodes whose rest exceeds `_least` of their query (`active`) pass on alpha of it and settle a share of `settle`.

        State: group, query, idx, mass, rest, deg (packed), left (the sum of rests) and n (how many there are).  `back` goes to the seeds, with what dead ends pass on.
        Without a state it is the seeds' `back`.
        """
        query = dict(restart.dtypes)["query"]
        columns = {"group": "int", "query": query, "kind": "int", "idx": "binary", "mass": "binary", "rest": "binary", "factor": "double"}
        row = lambda df, **own: df.select(*(own.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()))
        place = {"group": F.col("group"), "query": F.col("query"), "idx": F.col("idx")}
        inputs = [row(self.groups, group=F.col("group"), kind=F.lit(0), idx=F.col("deg"))]
        if state is None:
            inputs.append(row(restart, **place, kind=F.lit(2), rest=F.col("x"), factor=F.lit(back)))
        else:
            judged = state.join(active, "query", "left")
            inputs.append(row(judged, **place, kind=F.lit(1), mass=F.col("mass"), rest=F.col("rest"), factor=F.col("_least")))
            pushed = judged.filter("_least IS NOT NULL")
            inputs.append(row(self.passed(pushed.mapInArrow(_shares(alpha), f"group int, query {query}, idx binary, x binary")), **place, kind=F.lit(3), rest=F.col("x")))
            if self.dangling:
                lost = pushed.mapInArrow(_lost(alpha), f"query {query}, lost double").groupBy("query").agg(F.sum("lost").alias("_lost"))
                inputs.append(row(restart.join(active, "query").join(lost, "query", "left"), **place, kind=F.lit(2), rest=F.col("x"), factor=F.coalesce("_lost", F.lit(0.0)) + back))
            elif back:
                inputs.append(row(restart.join(active, "query"), **place, kind=F.lit(2), rest=F.col("x"), factor=F.lit(back)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, deg, mass, rest, kind_of = None, None, None, None, None

            def settled() -> pa.RecordBatch:
                own = np.flatnonzero((mass != 0) | (rest != 0))
                row = [*at, own.astype("<i4").tobytes(), mass[own].tobytes(), rest[own].tobytes(), deg[own].tobytes(), float(rest.sum()), int((rest > 0).sum())]
                kinds = [pa.int32(), kind_of, *[pa.binary()] * 4, pa.float64(), pa.int64()]
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["group", "query", "idx", "mass", "rest", "deg", "left", "n"])

            for batch in batches:
                kind_of = batch.schema.field("query").type
                for group, query, kind, idx, held, more, factor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if at is not None and (kind == 0 or at != (group, query)):
                        yield settled()
                        at = None
                    if kind == 0:
                        deg = np.frombuffer(idx, "<i8")
                        continue
                    if at is None:
                        at, mass, rest = (group, query), np.zeros(len(deg)), np.zeros(len(deg))
                    if kind == 1:
                        _add(mass, idx, held)
                        _add(rest, idx, more)
                        if factor is not None:
                            push = rest > factor
                            mass[push] += settle * rest[push]
                            rest[push] = 0
                    else:
                        _add(rest, idx, more, 1.0 if factor is None else factor)
            if at is not None:
                yield settled()

        rows = reduce(DataFrame.unionByName, inputs).repartitionById(self.side, F.col("group")).sortWithinPartitions("group", "query", "kind")
        return stored(rows.mapInArrow(run, f"group int, query {query}, idx binary, mass binary, rest binary, deg binary, left double, n long"), "walks")

    def named(self, state: DataFrame, values: str) -> DataFrame:
        """query, node, mass: the positive `values` of a state by node."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, (group, idx, x) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("group", "idx", "x")), strict=True)):
                    at, x = np.frombuffer(idx, "<i4"), np.frombuffer(x, "<f8")
                    at, x = at[x > 0], x[x > 0]
                    for j in range(0, len(at), _CHUNK):
                        n = len(at[j:j + _CHUNK])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, group, np.int32)), batch.column("query").take(pa.array([i] * n)), pa.array(at[j:j + _CHUNK]), pa.array(x[j:j + _CHUNK])],
                                                         names=["group", "query", "idx", "mass"])

        rows = state.select("group", "query", "idx", F.col(values).alias("x")).mapInArrow(run, f"group int, query {dict(state.dtypes)['query']}, idx int, mass double")
        return rows.join(self.nodes.select("group", "idx", "node"), ["group", "idx"]).select("query", "node", "mass")


def _pushed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """group, query, idx, rest, deg of the entries whose rest is large, for each row of a state, and the kind of the query."""
    for batch in batches:
        for group, query, idx, rest, deg, least in zip(*(batch.column(c).to_pylist() for c in ("group", "query", "idx", "rest", "deg", "_least")), strict=True):
            idx, rest, deg = np.frombuffer(idx, "<i4"), np.frombuffer(rest, "<f8"), np.frombuffer(deg, "<i8")
            on = rest > least
            yield group, query, idx[on], rest[on], deg[on], batch.schema.field("query").type


def _shares(alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, query, idx, rest, deg, kind in _pushed(batches):
            on = deg > 0
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([query], kind), pa.array([idx[on].tobytes()], pa.binary()),
                                              pa.array([(alpha * rest[on] / deg[on]).tobytes()], pa.binary())], names=["group", "query", "idx", "x"])

    return run


def _lost(alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, query, _, rest, deg, kind in _pushed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([query], kind), pa.array([float(alpha * rest[deg == 0].sum())])], names=["query", "lost"])

    return run


def _change(before: DataFrame, after: DataFrame) -> float:
    """The L1 distance of the rests of two states of one query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("idx", "rest", "_idx", "_rest")), strict=True):
                idx, rest, old, was = (np.frombuffer(x or b"", kind) for x, kind in zip(row, ("<i4", "<f8") * 2, strict=True))
                x = np.zeros(max(idx.max(initial=0), old.max(initial=0)) + 1)
                x[idx] += rest
                x[old] -= was
                yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(x).sum())])], names=["change"])

    old = before.select("group", F.col("idx").alias("_idx"), F.col("rest").alias("_rest"))
    both = after.select("group", "idx", "rest").join(old, "group", "full").drop("group")
    return both.mapInArrow(run, "change double").agg(F.coalesce(F.sum("change"), F.lit(0.0)).alias("d")).first()["d"]


def pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, iterations: int = 20, tol: float = 1e-8,
             hub_edges: int | None = None, both: bool = False) -> DataFrame:
    """Personalised PageRank (node, mass) on directed `edges` (src, dst; parallel edges count); zero mass is left out.

    With `both` every edge leads both ways, as those of `undirected` do, but is held once.  Dangling mass goes back to the seeds.  Edges are laid out once
    in packed cells (`_Layout`), and only packed vectors move per iteration.  Convergence is tested at every TEST_EVERY-th iteration,
    against the mass TEST_EVERY iterations before, whatever the graph is like.
    """
    layout = _Layout(edges, hub_edges, both)
    one = F.lit(1).alias("query")
    restart = layout.restart(seeds.select(one, "node"))
    if restart.isEmpty():
        if layout.nodes.isEmpty():
            return layout.nodes.select("node", F.lit(0.0).alias("mass"))
        raise ValueError("none of the seeds is a node of the graph")
    every = layout.spark.range(1).select(one, F.lit(-1.0).alias("_least"))
    state = anchor = layout.round(None, None, restart, alpha, 0.0, 1.0)
    for step in range(1, iterations + 1):
        done, state = state, layout.round(state, every, restart, alpha, 0.0, 1 - alpha)
        if done is not anchor:
            discard(done)
        if step % TEST_EVERY == 0 and step < iterations:
            delta = _change(anchor, state)
            discard(anchor)
            anchor = state
            if delta < tol:
                break
        if step % SWEEP_EVERY == 0:
            swept(layout.spark)
    return layout.named(state, "rest").select("node", "mass")


def push_walks(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, tol: float = 1e-3, rounds: int = 200, hub_edges: int | None = None, both: bool = False) -> DataFrame:
    """Personalised PageRank of many queries at once by forward push: query, node, mass, error.

    `seeds`: query, node; a query walks from its seeds in the graph, all alike, and one without such a seed has no rows.  Every (query, node) holds
    what the walk has settled (mass) and what it has still to pass on (rest).  A round settles 1 - alpha of the rest of all nodes whose rest is
    large for their query and pushes alpha of it along their edges; dead ends push to the seeds.  A query is done when its rests sum to
    `tol` or less; `error` is that sum, and exactly the L1 distance to the walk's limit.  A rest is large if it exceeds tol / 2 over
    the query's number of rests, so those that stay behind never hold more than tol / 2 together.

    Queries share each round's job.  Edges lie in packed cells as for `pagerank` (and lead both ways with `both`); a cell takes one query after the other, so
    only packed rests move and a task holds a cell and two vectors.  The state has an entry for each node that a query's walk has reached, and the
    files of a round go when the next has been written.  With tol = 0 each round pushes all rests: `rounds` steps exactly.
    """
    layout = _Layout(edges, hub_edges, both)
    restart = layout.restart(seeds)
    state = layout.round(None, None, restart, alpha, 0.0, 1.0)
    for turn in range(1, rounds + 1):
        totals = stored(state.filter("n > 0").groupBy("query").agg(F.sum("left").alias("left"), F.sum("n").alias("_n")), "rests")
        active = totals.filter(F.col("left") > tol).select("query", (F.lit(tol / 2) / F.col("_n")).alias("_least"))
        if active.isEmpty():
            break
        done, state = state, layout.round(state, active, restart, alpha, 1 - alpha)
        discard(done)
        discard(totals)
        if turn % SWEEP_EVERY == 0:
            swept(layout.spark)
    error = state.groupBy("query").agg(F.sum("left").alias("error"))
    return layout.named(state, "mass").join(error, "query").select("query", "node", "mass", "error")


def top_mass(mass: DataFrame, n: int) -> DataFrame:
    return mass.orderBy(F.desc("mass"), "node").limit(n)


def explain_outcomes(edges: DataFrame, outcomes: DataFrame, evidence: DataFrame, depth: int = 2) -> DataFrame:
    """Causal predecessors of each outcome, else its text evidence (outcomes: start; evidence: start, node, score)."""
    causes = causal_neighbours(edges, outcomes, "predecessors", depth).select(
        "start", "node", F.lit("causal").alias("via"), F.col("hops").cast("double").alias("weight"))
    rest = evidence.join(causes.select("start").distinct(), "start", "left_anti").select("start", "node", F.lit("evidence").alias("via"), F.col("score").alias("weight"))
    return causes.unionByName(rest)
