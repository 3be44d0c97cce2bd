"""Keyword scores in cells against plain Python."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracegrain.operators import retrieval as B


@pytest.mark.parametrize("k", [2, None])
def test_cell_scores_equal_a_plain_sum(spark, monkeypatch, k):
    monkeypatch.setattr(B, "CELL_POSTINGS", 16)
    monkeypatch.setattr(B, "CELL_QUERIES", 2)
    # `all` stands in every document, documents 7 and 8 are alike, 9 is there twice, one has no id
    rows = [(d, "all", 1.0) for d in range(30)] + [(d, f"w{d % 4}", 0.25 * (d % 3 + 1)) for d in range(30) if d not in (7, 8)]
    rows += [(7, "rare", 3.0), (8, "rare", 3.0), (9, "rare", 1.0), (9, "rare", 1.5), (None, "rare", 9.0)]
    asked = [("a", "all", 0.5), ("a", "rare", 2.0), ("b", "w1", 1.0), ("b", "unknown", 4.0), ("c", "all", 1.0), ("d", "unknown", 1.0)]
    postings = spark.createDataFrame(rows, "doc long, term string, w double")
    terms = spark.createDataFrame(asked, "query string, term string, x double").select("query", "term", F.array("x").alias("weights"))
    sums = defaultdict(float)
    for query, term, x in asked:
        for doc, word, w in rows:
            if word == term:
                sums[query, doc] += x * w
    want = set()
    for query in {q for q, _ in sums}:
        best = sorted(((-round(s, 6), doc is not None, doc or 0, doc) for (q, doc), s in sums.items() if q == query))
        want |= {(query, doc, -s) for s, _, _, doc in best[:k]}
    found = B.cell_scores(terms, postings, k, 6)
    if k is not None:
        found = B.top_k(found, ["query"], [F.desc("score"), F.col("doc")], k).drop("rank")
    assert {tuple(r) for r in found.collect()} == want
    assert found.count() == len(want)


def test_a_frequent_term_does_not_gather_its_postings(spark):
    postings = spark.range(200).select(F.col("id").alias("doc"), F.lit(3).alias("dl"), F.lit("all").alias("term"), F.lit(1).cast("long").alias("tf"))
    terms = spark.createDataFrame([(1, "all")], "query int, term string")
    stats = spark.createDataFrame([(200, 3.0)], "n long, avgdl double")
    plan = B.bm25(terms, postings, stats)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and "SortMergeJoin [term" not in plan
    assert [r["doc"] for r in B.bm25(terms, postings, stats, 3).orderBy("rank").collect()] == [0, 1, 2]
