"""History and edges advanced by batches against a rebuild; walks by push against their limit."""

import os
import random

import numpy as np
import pytest

from tracegrain.operators import facts, graph, history

ASSERT = "session string, seq bigint, idx int, ts_us bigint, source_hash string, name string, entity_type string, summary string, props map<string,string>"
GONE = "session string, entity_type string, name string, seq bigint, ts_us bigint"


def assertions(n, seed):
    rng = random.Random(seed)
    rows, gone = [], []
    for seq in range(1, n + 1):
        session = rng.choice(("hot", "hot", "hot", "a", "b"))
        name = f"n{rng.randrange(4)}"
        if rng.random() < 0.15:
            gone.append((session, "task", name, seq, seq * 10))
        else:
            rows += [(session, seq, i, seq * 10, f"h{seq}", name, "task", rng.choice(("open", "done", None)), {"k": str(rng.randrange(2))}) for i in range(rng.choice((1, 1, 2)))]
    return rows, gone


def plain(df):
    return sorted(map(repr, df.collect()))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_batches_give_the_rebuild(spark, tmp_path, seed):
    rows, gone = assertions(60, seed)
    rng = random.Random(seed)
    of = {seq: rng.randrange(3) for seq in range(1, 61)}  # events arrive in any order
    path = str(tmp_path / "history")
    frames = lambda part: (spark.createDataFrame([r for r in rows if part is None or of[r[1]] == part], ASSERT),
                           spark.createDataFrame([g for g in gone if part is None or of[g[3]] == part], GONE))
    for part in (2, 0, 0, 1):  # one of them twice
        history.merge(path, *frames(part))
    assert plain(history.read(spark, path)) == plain(facts.versions(*frames(None)))


def test_late_row_splits_a_window_and_other_partitions_stay(spark, tmp_path):
    path = str(tmp_path / "history")
    row = lambda session, seq, state: (session, seq, 0, seq * 10, f"h{seq}", "n", "task", state, {})
    first = [row(s, q, "open") for s in ("a", "b", "c") for q in (1, 9)]
    history.merge(path, spark.createDataFrame(first, ASSERT))
    assert {(r.session, r.valid_from, r.valid_to) for r in history.read(spark, path).collect()} == {(s, 10, None) for s in "abc"}
    before = files(path)
    history.merge(path, spark.createDataFrame([row("b", 5, "done")], ASSERT))
    after = files(path)
    assert len(set(before) - set(after)) == 1 and len(set(after) - set(before)) == 1  # the partition of b alone
    got = sorted((r.valid_from, r.summary, r.valid_to) for r in history.read(spark, path).filter("session = 'b'").collect())
    assert got == [(10, "open", 50), (50, "done", 90), (90, "open", None)]
    history.merge(path, spark.createDataFrame([], ASSERT))
    assert files(path) == after


def test_edges_by_batches(spark, tmp_path):
    rng = random.Random(6)
    schema = ("session string, source_type string, source string, relation string, target_type string, target string, valid_from bigint, valid_to bigint, "
              "inferred boolean, confidence double, method string, seq bigint, source_hash string, idx int")
    rows = [("s", "t", f"a{rng.randrange(3)}", "r", "t", f"b{rng.randrange(3)}", q * 10, None, False, 1.0, None, q, f"h{q}", 0) for q in range(1, 60)]
    path = str(tmp_path / "edges")
    for part in (1, 0, 2, 1):
        history.merge_edges(path, spark.createDataFrame([r for r in rows if r[11] % 3 == part], schema))
    assert plain(history.read_edges(spark, path)) == plain(facts.upsert_edges(spark.createDataFrame(rows, schema)).select(*history.read_edges(spark, path).columns))


EDGES = [("hub", f"n{i}") for i in range(40)] + [(f"n{i}", "hub") for i in range(0, 40, 2)] + [("n1", "n2"), ("n2", "n3"), ("n2", "n3"), ("lone", "n5"), ("n7", "end")]
SEEDS = [(1, "n1"), (1, "n2"), (1, "absent"), (2, "hub"), (3, "absent"), (4, "end"), (5, "n7"), (5, "n7")]


def limit(start, alpha=0.85):
    names = sorted({x for e in EDGES for x in e})
    at = {x: i for i, x in enumerate(names)}
    step = np.zeros((len(names), len(names)))
    for a, b in EDGES:
        step[at[a], at[b]] += 1
    restart = np.zeros(len(names))
    restart[[at[x] for x in start]] = 1 / len(start)
    out = step.sum(axis=1)
    step = np.where(out[:, None] > 0, step / np.maximum(out, 1)[:, None], restart[None])
    return dict(zip(names, (1 - alpha) * restart @ np.linalg.inv(np.eye(len(names)) - alpha * step), strict=True))


@pytest.mark.parametrize("tol,hub_edges", [(0.2, 100_000), (0.01, 7)])
def test_push_stays_within_its_bound(spark, tol, hub_edges):
    edges, seeds = spark.createDataFrame(EDGES, "src string, dst string"), spark.createDataFrame(SEEDS, "query int, node string")
    got = graph.push_walks(edges, seeds, tol=tol, hub_edges=hub_edges).collect()
    starts = {1: ["n1", "n2"], 2: ["hub"], 4: ["end"], 5: ["n7"]}
    assert {r["query"] for r in got} == set(starts)
    for q, start in starts.items():
        own, want = {r.node: r.mass for r in got if r["query"] == q}, limit(start)
        error = next(r.error for r in got if r["query"] == q)
        assert error <= tol and all(own[n] <= want[n] + 1e-12 for n in own)
        assert abs(sum(want.values()) - sum(own.values()) - error) < 1e-9  # the bound is the distance itself


def test_push_agrees_with_the_iterated_walk(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    one = {r.node: r.mass for r in graph.pagerank(edges, spark.createDataFrame([("n1",), ("n2",)], "node string"), iterations=80).collect()}
    many = {r.node: r.mass for r in graph.push_walks(edges, spark.createDataFrame(SEEDS[:2], "query int, node string"), tol=1e-4).collect()}
    assert sum(abs(one[n] - many.get(n, 0.0)) for n in one) < 2e-4


def test_push_without_edges_or_seeds(spark):
    edges, seeds = spark.createDataFrame(EDGES, "src string, dst string"), spark.createDataFrame(SEEDS, "query int, node string")
    assert graph.push_walks(edges.filter("false"), seeds).count() == 0
    assert graph.push_walks(edges, seeds.filter("query = 3")).count() == 0


def test_walks_in_many_cells_agree_and_leave_no_files_of_past_rounds(spark, monkeypatch):
    import glob

    from tracegrain.session import checkpoint_root
    edges, seeds = spark.createDataFrame(EDGES, "src string, dst string"), spark.createDataFrame(SEEDS[:4], "query int, node string")
    folders = lambda: set(glob.glob(f"{checkpoint_root(spark).removeprefix('file:')}/walks-*"))
    plain = lambda rows: {(r.query, r.node): round(r.mass, 12) for r in rows}
    whole, before = plain(graph.push_walks(edges, seeds, tol=0.0, rounds=3).collect()), folders()
    monkeypatch.setattr(graph, "CELL_EDGES", 8, raising=False)
    cells = plain(graph.push_walks(edges, seeds, tol=0.0, rounds=3, hub_edges=7).collect())
    assert cells == whole
    assert len(folders() - before) == 1


def test_edges_are_held_once_and_packed_for_both_ways(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"a{rng.randrange(300)}", f"b{rng.randrange(300)}") for _ in range(6000)] + [("hub", f"b{i}") for i in range(300)] + [("a1", "a1"), ("a1", None)]
    edges, seeds = spark.createDataFrame(rows, "src string, dst string"), spark.createDataFrame([(1, "a1"), (2, "hub"), (2, "b3")], "query int, node string")
    monkeypatch.setattr(graph, "CELL_EDGES", 2000, raising=False)
    layout = graph._Layout(edges, 700, True)
    cells = layout.cells.collect()
    assert len(cells) > layout.side * (layout.side + 1) / 2  # full cells go on as another one
    held = [sum(graph._inflated(c.m)) if c.m else len(graph._inflated(c["keys"])) for c in cells]
    assert sum(held) == len(rows) and max(held) <= 700
    assert sum(len(c["keys"]) + len(c.m) for c in cells) < 6 * len(rows)
    once = graph.push_walks(edges, seeds, tol=0.0, rounds=3, hub_edges=700, both=True)
    twice = graph.push_walks(graph.undirected(edges), seeds, tol=0.0, rounds=3)
    values = lambda df: {(r.query, r.node): round(r.mass, 12) for r in df.collect()}
    assert values(once) == values(twice)


def test_a_merge_leaves_no_files_but_the_history(spark, tmp_path):
    from tracegrain.session import checkpoint_root
    root = checkpoint_root(spark).removeprefix("file:")
    left = lambda: set(files(root)) | {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if "/rdd-" in d}
    rows, gone = assertions(20, 5)
    before = left()
    history.merge(str(tmp_path / "history"), spark.createDataFrame(rows, ASSERT), spark.createDataFrame(gone, GONE))
    assert left() <= before
    assert plain(history.read(spark, str(tmp_path / "history"))) == plain(facts.versions(spark.createDataFrame(rows, ASSERT), spark.createDataFrame(gone, GONE)))
