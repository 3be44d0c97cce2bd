"""Plug-ins, paired comparison, compaction search and hybrid search against plain Python."""

import itertools
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrain import plugins
from tracegrain.operators import compaction, evaluation
from tracegrain.ordered import top_k
from tracegrain.plans import pipelines


def test_embedder_and_reranker(spark):
    def load_model():
        return lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts]

    def load_scores():
        return lambda queries, texts: [float(len(set(q.split()) & set(t.split()))) for q, t in zip(queries, texts, strict=True)]

    rows = spark.createDataFrame([(1, "a cat"), (2, None), (3, "banana")], "id int, name string")
    got = {r.id: (list(r.vector), r.version) for r in plugins.embed_entities(rows, F.col("name"), plugins.embedder(load_model), "v2").collect()}
    assert got == {1: ([5.0, 2.0], "v2"), 2: ([0.0, 0.0], "v2"), 3: ([6.0, 3.0], "v2")}
    pairs = spark.createDataFrame([(q, i, t) for q in ("red fox runs", "blue sky") for i, t in enumerate(("the red fox", "blue fox", "a sky of blue", "runs"))], "q string, i int, t string")
    scored = pairs.withColumn("score", plugins.reranker(load_scores)(F.col("q"), F.col("t")))
    best = {(r.q, r["rank"]): r.i for r in top_k(scored, ["q"], [F.desc("score"), F.col("i")], 2).collect()}
    assert best == {("red fox runs", 1): 0, ("red fox runs", 2): 1, ("blue sky", 1): 2, ("blue sky", 2): 1}


def runs(spark, deltas):
    rows = []
    for baseline, own in deltas.items():
        for i, d in enumerate(own):
            rows.append((baseline, f"{baseline}{i}", 0, 0.5))
            rows.append(("view", f"{baseline}{i}", 0, 0.5 + d))
    return spark.createDataFrame(rows, "backend string, case_id string, run int, score double")


def test_paired_comparison(spark):
    rng = np.random.default_rng(3)
    deltas = {"few": [0.1, -0.05, 0.2, 0.0, 0.15], "better": rng.normal(0.1, 0.1, 200).round(4).tolist(), "same": rng.normal(0.0, 0.1, 200).round(4).tolist()}
    got = {r.baseline: r for r in evaluation.paired_comparison(runs(spark, deltas), "view").collect()}
    few = np.array(deltas["few"])
    flips = [abs((np.array(s) * few).mean()) >= abs(few.mean()) - 1e-12 for s in itertools.product((1, -1), repeat=5)]
    assert got["few"].p_value == pytest.approx(np.mean(flips), abs=1e-6) and got["few"].pairs == 5
    for name, own in deltas.items():
        r, half = got[name], 1.96 * np.std(own) / np.sqrt(len(own))
        assert r.mean_difference == pytest.approx(np.mean(own), abs=1e-4) and r.ci_low <= r.mean_difference <= r.ci_high
        assert r.ci_high - r.ci_low == pytest.approx(2 * half, rel=0.25)
    assert got["better"].significant and not got["same"].significant and got["better"].p_value < 0.001 < got["same"].p_value


def test_compaction_keeps_exemplars_and_finds_them_by_shared_words(spark):
    events = [("s", q, "decision.made", json.dumps({"content": text, "taskId": f"t{q}"}), f"{q:064d}")
              for q, text in enumerate(["red red red", "red red", "blue sky over sea", "green grass", "green grass grows"], 1)]
    events += [("lone", 1, "note", "not json", "f" * 64)]
    log = spark.createDataFrame(events, "session string, seq bigint, type string, payload string, hash string")
    kept = compaction.projection(log, 3).collect()
    by = {}
    for r in kept:
        by.setdefault(r.session, []).append(r)
    assert len(by["s"]) == 3 and len(by["lone"]) == 1 and sorted(r.position for r in by["s"]) == [1, 2, 3]
    for r in kept:
        assert r.citation == f"log://{r.session}/events/{r.seq}#{[e[4] for e in events if (e[0], e[1]) == (r.session, r.seq)][0][:12]}"
        assert r.citation in r.identities
    asked = spark.createDataFrame([(1, "Green grass and sky"), (2, "nothing alike"), (3, "decision")], "query int, text string")
    words = lambda t: {w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 1}
    want = set()
    for q, text in ((1, "Green grass and sky"), (2, "nothing alike"), (3, "decision")):
        hits = [(-round(len(words(text) & words(r.context + " " + " ".join(r.identities))) / len(words(text)), 4), r.session, r.seq) for r in kept]
        want |= {(q, s, n, -score, i) for i, (score, s, n) in enumerate(sorted(h for h in hits if h[0] < 0)[:2], 1)}
    got = {(r["query"], r.session, r.seq, r.score, r["rank"]) for r in compaction.search(compaction.projection(log, 3), asked, 2).collect()}
    assert want and got == want


def test_hybrid_search_with_and_without_a_walk(spark):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(
        ["whales sing in the deep sea", "the deep sea is dark", "cats sleep on warm roofs", "roofs of red clay", "whales and cats"])], "id string, text string")
    asked = spark.createDataFrame([("q1", "whales sing in the deep sea"), ("q2", "warm roofs")], "qid string, text string")
    edges = spark.createDataFrame([("d0", "d3", "near"), ("d3", "d4", "near")], "src string, dst string, relation string")
    plain = pipelines.hybrid_search(asked, docs, "qid", "id", F.col("text"), k=3).collect()
    first = lambda rows, q: [r["item"] for r in rows if r["query"] == q and r["rank"] == 1]
    assert first(plain, "q1") == ["d0"] and first(plain, "q2") == ["d2"]
    walked = pipelines.hybrid_search(asked, docs, "qid", "id", F.col("text"), k=5, edges=edges, walk=0.5).collect()
    assert {r["item"] for r in walked if r["query"] == "q1"} >= {"d0", "d3"}  # reached by an edge only


def test_identities_parse_a_payload_once(spark):
    rows = [("s", 1, "note", "h" * 20, '{"taskId":"t1","title":"g","path":"a.py","start_line":"1","end_line":"2"}'), ("s", 2, "note", "i" * 20, "no json")]
    found = compaction.identity_rows(spark.createDataFrame(rows, "session string, seq bigint, type string, hash string, payload string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 1
    assert {tuple(r) for r in found.collect()} == {("s", 1, "log://s/events/1#" + "h" * 12), ("s", 1, "a.py:1-2"), ("s", 1, "t1"), ("s", 1, "g"), ("s", 2, "log://s/events/2#" + "i" * 12)}
