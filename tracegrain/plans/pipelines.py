"""Whole query lifecycles composed from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import long_words
from ..operators import compaction, facts, fusion, graph, replay, retrieval, sequences, setops, vectors
from ..session import cut, stored


def hybrid_search(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, text: Column, k: int = 10, profile: str = "balanced",
                  dim: int = 64, edges: DataFrame | None = None, walk: float = 0.0) -> DataFrame:
    """Batch of text queries over documents: exact, keyword, vector and traversal lanes, fused, then MMR.

    Each lane is one job over the shared tables; every lane is cut to a candidate pool per query before fusion.  With edges and a `walk`
    weight, each query also walks from its fused hits, all queries in the same jobs, and the walk's mass is blended into their scores.
    """
    pool = max(3 * k, 16)
    terms = retrieval.query_terms(queries, query_id, text)
    keyword = retrieval.bm25(terms, retrieval.document_terms(docs, doc_id, text, terms), retrieval.corpus_stats(docs, text), pool)
    asked = vectors.hash_embedding(queries, query_id, text, dim).withColumnRenamed(query_id, "query_id")
    # both sides are read for their counts and for their cells, so each text is embedded once
    held = stored(vectors.hash_embedding(docs, doc_id, text, dim).withColumnRenamed(doc_id, "vec_id"), "embedded")
    near = vectors.exact_search(held, stored(asked, "asked"), pool)
    asked_texts = queries.select(F.col(query_id).alias("query"), F.sha2(text, 256).alias("_d"), text.alias("_asked"))
    same = docs.select(F.col(doc_id).alias("name"), F.sha2(text, 256).alias("_d"), text.alias("_t")).join(asked_texts, "_d").filter("_t = _asked")
    lane = lambda df, name, score: df.select("query", "name", F.lit("document").alias("type"), F.lit(name).alias("lane"), score.cast("double").alias("raw_score"))
    rows = lane(same, "exact", F.lit(1.0)).unionByName(
        lane(keyword.withColumnRenamed("doc", "name"), "keyword", F.col("score"))).unionByName(
        lane(near.withColumnRenamed("query_id", "query").withColumnRenamed("vec_id", "name"), "vector", F.col("score")))
    if edges is not None:
        seeds = rows.select("query", F.col("name").alias("start")).distinct()
        hops = graph.traverse(edges, seeds.select("start").distinct(), depth=2).join(seeds, "start")
        best = hops.groupBy("query", "node").agg(F.min("hops").alias("hops"))
        score = F.greatest(F.lit(0.1), F.lit(0.75) - F.when(F.col("hops") > 1, 0.05 * (F.col("hops") - 1)).otherwise(0.0))
        rows = rows.unionByName(lane(best.withColumnRenamed("node", "name"), "traversal", score))
    rows = rows.withColumns({"query_weight": F.lit(1.0), "valid_from": F.lit(None).cast("bigint"), "salience": F.lit(None).cast("string")})
    fused = stored(fusion.fuse(rows, profile), "fused")
    if edges is not None and walk > 0:
        hits = fused.select("query", F.col("name").alias("node"), "score")
        walked = graph.push_walks(edges, hits.select("query", "node"), tol=0.05, both=True).select("query", "node", "mass")
        blended = fusion.blend_walk(hits, walked, walk).withColumnRenamed("node", "name")
        fused = fused.drop("score").join(blended, ["query", "name"])
    # only the texts of hits are tokenised and moved
    found = docs.select(F.col(doc_id).alias("name"), text.alias("_t")).join(fused.select("name").distinct(), "name", "left_semi")
    words = stored(found.select("name", F.array_distinct(long_words(F.col("_t"))).alias("words")), "words")
    return fusion.mmr(fused.join(words, "name").select("query", F.col("name").alias("item"), "score", "lane", "words"), k)


def checkout(contexts: DataFrame, governance: DataFrame, outcomes: DataFrame, salience: DataFrame, budget: int, as_of_seq: int | None = None, floor: float = 0.15) -> dict[str, DataFrame]:
    """Governed evidence: as-of filter, withheld rows out, outcome learning, one row per key, cognitive order over all of them.

    Contexts carry the columns of `fusion.cognitive_rank` plus session, seq, key, ord, lane_priority, citation and profile.
    Returns ranked evidence and the excluded rows with their reason.
    """
    rows = contexts if as_of_seq is None else facts.as_of_seq(contexts, as_of_seq, "seq")
    withheld = replay.governance_withheld(governance)
    kept = replay.drop_withheld(rows, withheld)
    learned = replay.apply_outcomes(kept, outcomes)
    live = learned.filter("NOT suppress")
    pool = fusion.best_per_key(live, ["query", "key"], [F.col("ord")])
    ranked, faint = fusion.cognitive_rank(pool, salience, floor)
    reason = lambda df, why: df.select("query", "item", F.lit(why).alias("reason"))
    excluded = reason(rows.join(withheld, ["session", "seq"], "left_semi"), "governance").unionByName(
        reason(learned.filter("suppress"), "outcome_suppressed")).unionByName(reason(faint, "attenuated"))
    return {"evidence": fusion.take_ranked(ranked, budget), "excluded": excluded}


def nightly_pass(log: DataFrame, actionable: Column, step: Column, ok: Column, meta: DataFrame, policy: DataFrame,
                 known_candidates: DataFrame | None = None) -> dict[str, DataFrame]:
    """Consolidation pass: propose, mine, gate, plan re-verification, audit; one summary row.

    Stages are independent jobs; a failure ends the pass.
    """
    out: dict[str, DataFrame] = {}

    def stage(name, make):
        out[name] = cut(make())

    def proposals() -> DataFrame:
        windows = sequences.consolidation_windows(log.filter(actionable))
        # cut first: the id repeats its inputs many times, and each would bring the whole proposal expression along
        rows = cut(sequences.consolidation_proposals(windows)).withColumn(
            "candidate_id", compaction.deterministic_id("candidate:", F.col("candidate_type"), F.col("segment_id")))
        return rows if known_candidates is None else setops.unseen(rows, known_candidates, ["candidate_id"])

    stage("proposals", proposals)
    stage("procedures", lambda: sequences.mine_procedures(sequences.session_traces(log, step, ok)))
    stage("gated", lambda: compaction.evolution_gate(
        out["proposals"].select("candidate_id", F.concat(F.lit("consolidation."), "candidate_type").alias("op"), "confidence"), policy))
    stage("reverify", lambda: replay.plan_reverify(meta))
    stage("audit", lambda: compaction.audit(log))
    counts = [df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("rows")) for name, df in out.items()]
    summary = counts[0]
    for part in counts[1:]:
        summary = summary.unionByName(part)
    out["summary"] = summary
    return out
