"""Fusion, scoring policies, ranking, packing and pagination of result rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, jaccard
from ..ordered import running_sum, top_k
from .setops import best_per_key

DAY_US = 86_400_000_000
LANES = ("exact", "vector", "keyword", "traversal")
# lane weights and temporal weight per scoring profile (fixed values)
PROFILES = {
    "balanced": ({"exact": 1.0, "vector": 0.95, "traversal": 0.9, "keyword": 0.8}, 0.12),
    "precision": ({"exact": 1.0, "vector": 0.85, "traversal": 0.75, "keyword": 0.65}, 0.08),
    "recall": ({"exact": 1.0, "vector": 1.0, "traversal": 0.95, "keyword": 0.85}, 0.1),
    "temporal": ({"exact": 1.0, "vector": 0.9, "traversal": 0.9, "keyword": 0.78}, 0.22),
}


# query-word expansions (fixed values)
SYNONYMS = {
    "auth": ("authentication", "authorization"),
    "bachelor": ("undergraduate", "undergrad", "graduated", "graduation"),
    "bachelors": ("undergraduate", "undergrad", "graduated", "graduation"),
    "decision": ("decided", "choice", "rationale"),
    "decisions": ("decided", "choice", "rationale"),
    "degree": ("undergraduate", "undergrad", "graduated", "graduation"),
    "doc": ("document", "documentation"),
    "docs": ("document", "documentation"),
    "bug": ("defect", "failure", "regression"),
    "bugs": ("defect", "failure", "regression"),
    "task": ("todo", "work", "action"),
    "tasks": ("todo", "work", "action"),
}


def _lookup(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def freshness(score: Column, valid_from: Column, at_us: Column, weight: Column | float) -> Column:
    """score x (1 + w (1 / (1 + age / 365 days) - .5)); unchanged without both times."""
    age = F.greatest(at_us - valid_from, F.lit(0)) / DAY_US
    factor = 1.0 + weight * (1.0 / (1.0 + age / 365.0) - 0.5)
    return score * F.coalesce(factor, F.lit(1.0))


def salience_multiplier(value: Column) -> Column:
    """Stored salience in (0, 10]; anything else is neutral."""
    v = value.try_cast("double")
    return F.when(v > 0, F.least(v, F.lit(10.0))).otherwise(F.lit(1.0))


def retention(rows: DataFrame, mode: str, now_us: int, half_life_days: Column | float = 30.0, expired_weight: Column | float = 0.25) -> DataFrame:
    """Score rows (score, expires_us, reinforced_us, valid_from, importance, reinforcements) under a retention mode."""
    if mode == "none":
        return rows
    expired = F.coalesce(F.col("expires_us") <= now_us, F.lit(False))
    if mode == "filter_expired":
        return rows.filter(~expired)
    age = F.greatest(F.lit(0.0), (F.lit(now_us) - F.coalesce("reinforced_us", "valid_from")) / DAY_US)
    half = half_life_days if isinstance(half_life_days, Column) else F.lit(half_life_days)
    importance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("importance", F.lit(1.0))))
    boost = F.least(F.lit(0.25), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("reinforcements", F.lit(0.0)))) * 0.03)
    decay = F.coalesce(F.least(F.lit(1.0), F.pow(F.lit(0.5), age / half) * importance + boost), F.lit(1.0))
    low = expired_weight if isinstance(expired_weight, Column) else F.lit(expired_weight)
    return rows.withColumn("multiplier", F.when(expired, low).otherwise(decay)).withColumn("score", F.col("score") * F.col("multiplier"))


def fuse(lanes: DataFrame, profile: str = "balanced", at_us: int | None = None) -> DataFrame:
    """Best weighted row per (query, name, type); the first lane wins ties.

    Lanes: query, name, type, lane, raw_score, query_weight, valid_from, salience.
    """
    weights, temporal = PROFILES[profile]
    base = F.when(F.col("lane") == "keyword", F.least("raw_score", F.lit(1.0))).otherwise(F.col("raw_score"))
    score = base * _lookup(weights)[F.col("lane")] * F.coalesce("query_weight", F.lit(1.0))
    timed = F.when(F.col("lane").isin("vector", "keyword"), freshness(score, F.col("valid_from"), F.lit(at_us).cast("bigint"), temporal)).otherwise(score)
    rows = lanes.withColumn("score", F.round(timed * salience_multiplier(F.col("salience")), 6))
    rank = F.array_position(F.array(*[F.lit(x) for x in LANES]), F.col("lane"))
    return best_per_key(rows, ["query", "name", "type"], [-F.col("score"), rank])


def reciprocal_rank_fusion(rows: DataFrame, weights: dict[str, float] | None = None, c: int = 60) -> DataFrame:
    """Sum of w / (c + rank) over retrievers (rows: query, item, retriever, rank)."""
    w = F.coalesce(_lookup(weights)[F.col("retriever")], F.lit(1.0)) if weights else F.lit(1.0)
    return rows.groupBy("query", "item").agg(F.round(F.sum(w / (c + F.col("rank"))), 9).alias("score"), F.count(F.lit(1)).alias("retrievers"))


def identifier_boost(score: Column, has_identifier: Column) -> Column:
    return F.when(has_identifier, F.greatest(score, F.lit(1.35))).otherwise(score)


def suppress_distractors(rows: DataFrame, has_identifier: Column) -> DataFrame:
    """If any row of a query holds the query's identifier, keyword and vector rows without it are dropped."""
    marked = rows.withColumn("_has", F.coalesce(has_identifier, F.lit(False)))
    hit = marked.filter("_has").select("query").distinct().withColumn("_any", F.lit(True))
    keep = F.col("_any").isNull() | F.col("_has") | F.col("lane").isin("exact", "traversal")
    return marked.join(hit, "query", "left").filter(keep).drop("_has", "_any")


def traversal_score(seed_exact: Column, relations: Column, entity_type: Column, hops: Column, asks_completion: Column, asks_task: Column,
                    inferred: Column, confidence_sum: Column, methods: Column, sources: Column, evidenced: Column) -> Column:
    """Relation-path score with hop penalty and trust in inferred edges."""
    has = lambda r: F.array_contains(relations, r)
    add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    score = F.when(seed_exact, 1.45).otherwise(0.75)
    score = score + add(asks_completion & has("completed_task"), 0.85) - add(asks_completion & has("proposed_task") & ~has("completed_task"), 0.45)
    score = score + add(asks_task & has("has_task"), 0.25) + add((entity_type == "actor") & has("completed_task"), 0.35)
    score = score + add((entity_type == "task") & has("has_task"), 0.15)
    score = score - F.when(hops > 1, F.least(F.lit(0.25), 0.05 * (hops - 1))).otherwise(F.lit(0.0))
    share = lambda n: F.least(F.lit(1.0), n / inferred)
    trust = (confidence_sum / inferred) * (share(methods) + share(sources) + share(evidenced)) / 3.0
    return F.greatest(F.lit(0.1), score * F.when(inferred > 0, 0.65 + 0.5 * trust).otherwise(F.lit(1.0)))


def lexical_rerank(query_words: Column, words: Column, text: Column) -> Column:
    """Overlap ratio plus .03 per query word found in the text, at most 1."""
    found = F.size(F.filter(query_words, lambda w: F.contains(F.lower(text), w)))
    score = F.size(F.array_intersect(query_words, words)) / F.size(query_words) + 0.03 * found
    return F.when(F.size(query_words) > 0, F.least(score, F.lit(1.0))).otherwise(F.lit(0.0))


def mmr(rows: DataFrame, k: int, relevance: float = 0.7, traversal_bonus: float = 0.1) -> DataFrame:
    """Greedy diversity ranking per query (rows: query, item, score, lane, words).

    A window first cuts every query to max(3k, 16) rows, so the greedy step holds a small fixed pool.
    """
    bonus = F.when(F.col("lane") == "traversal", traversal_bonus).otherwise(0.0)
    pool = top_k(rows, ["query"], [F.desc(F.col("score") + bonus), F.col("item")], max(3 * k, 16), out="_p")

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "_p"], ascending=[False, True])
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*pdf["words"])))}
        holds = np.zeros((len(pdf), max(1, len(vocabulary))))
        for row, words in enumerate(pdf["words"]):
            holds[row, [vocabulary[w] for w in words]] = 1.0
        shared, size = holds @ holds.T, holds.sum(axis=1)
        alike = np.divide(shared, size[:, None] + size - shared, out=np.zeros_like(shared), where=shared > 0)  # Jaccard of every two rows of the pool
        score, lift = pdf["score"].to_numpy(float), np.where(pdf["lane"] == "traversal", traversal_bonus, 0.0)
        chosen, values = [0], [score[0]]
        while len(chosen) < min(k, len(pdf)):
            value = relevance * score - (1 - relevance) * alike[:, chosen].max(axis=1) + lift
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
            values.append(value[chosen[-1]])
        taken = pdf.iloc[chosen[:k]]
        return pd.DataFrame({"query": taken["query"].to_numpy(), "item": taken["item"].to_numpy(), "ranking_score": values[:k], "rank": range(1, len(taken) + 1)})

    types = dict(rows.dtypes)
    return pool.groupBy("query").applyInPandas(rank, f"query {types['query']}, item {types['item']}, ranking_score double, rank long")


def blend_walk(base: DataFrame, mass: DataFrame, weight: float = 0.2) -> DataFrame:
    """(1 - w) base + w walk mass, the mass scaled by its maximum (both: query, node, score / mass)."""
    peak = mass.groupBy("query").agg(F.max("mass").alias("_peak"))
    scaled = mass.join(peak, "query").select("query", "node", F.when(F.col("_peak") > 0, F.col("mass") / F.col("_peak")).otherwise(0.0).alias("_w"))
    both = base.join(scaled, ["query", "node"], "full")
    return both.select("query", "node", (F.coalesce("score", F.lit(0.0)) * (1 - weight) + F.coalesce("_w", F.lit(0.0)) * weight).alias("score"))


CUE_WEIGHT = 0.25


def cognitive_rank(contexts: DataFrame, salience: DataFrame, floor: float) -> tuple[DataFrame, DataFrame]:
    """Ranked contexts and the attenuated ones left out.

    Contexts: query, item, target, overlap, cited, source_lane, typed, outcome, valid_from, score, query_cues, cues, exempt.
    Salience: target, salience.
    """
    rows = contexts.join(salience, "target", "left")
    factor = F.least(F.lit(10.0), F.greatest(F.lit(0.01), F.coalesce("salience", F.lit(1.0))))
    faint = F.coalesce(F.col("salience") < floor, F.lit(False))
    rows = rows.withColumn("primary", F.round(F.col("overlap") * factor + CUE_WEIGHT * jaccard(F.col("query_cues"), F.col("cues")), 6)).withColumn(
        "final", F.round(F.col("score") * factor, 6))
    kept = rows.filter(~faint | F.col("exempt")).withColumn(
        "rank_key", F.struct("primary", "cited", "source_lane", "typed", "outcome", "valid_from", "final"))
    return kept, rows.filter(faint & ~F.col("exempt")).withColumn("label", F.lit("attenuated"))


def take_ranked(rows: DataFrame, k: int, key: str = "rank_key", tie: str = "item") -> DataFrame:
    return top_k(rows, ["query"], [F.desc(key), F.col(tie)], k)


def diverse_sources(rows: DataFrame, k: int) -> DataFrame:
    """Best row of each source group first, then the rest by rank (rows: query, item, source_group, ord)."""
    first = rows.groupBy("query", "source_group").agg(F.min("ord").alias("_first"))
    marked = rows.join(first, ["query", "source_group"]).withColumn("_later", (F.col("ord") > F.col("_first")).cast("int"))
    return top_k(marked, ["query"], [F.col("_later"), F.col("ord")], k).drop("_first", "_later")


def merge_lanes(rows: DataFrame, limit: int, verbatim_slots: int, packet_slots: int) -> DataFrame:
    """Graph rows, then reserved verbatim and packet rows, de-duplicated by content key (rows: query, lane, key, ord)."""
    once = rows.groupBy("query", "lane", "key").agg(F.min("ord").alias("ord"))
    verbatim = top_k(once.filter("lane = 'verbatim'"), ["query"], [F.col("ord"), F.col("key")], min(verbatim_slots, limit), out="_r")
    used = verbatim.groupBy("query").agg(F.count(F.lit(1)).alias("_v"))
    packets = top_k(once.filter("lane = 'packet'"), ["query"], [F.col("ord"), F.col("key")], packet_slots, out="_r")
    packets = packets.join(used, "query", "left").filter(F.col("_r") <= F.lit(limit) - F.coalesce("_v", F.lit(0))).drop("_v")
    reserved = verbatim.unionByName(packets)
    taken = reserved.groupBy("query").agg(F.count(F.lit(1)).alias("_n"))
    graph = once.filter("lane = 'graph'").join(reserved.select("query", "key").distinct(), ["query", "key"], "left_anti")
    graph = top_k(graph, ["query"], [F.col("ord"), F.col("key")], limit, out="_r").join(taken, "query", "left").filter(
        F.col("_r") <= F.lit(limit) - F.coalesce("_n", F.lit(0))).drop("_n")
    return graph.unionByName(reserved).withColumnRenamed("_r", "position")


def recall_set(rows: DataFrame, budget: int) -> DataFrame:
    """De-duplicated candidates by has-citation, lane priority, score (rows: query, key, ord, lane_priority, citation, score)."""
    once = best_per_key(rows, ["query", "key"], [F.col("ord")])
    return top_k(once, ["query"], [F.col("citation").isNull().cast("int"), F.col("lane_priority"), F.desc("score"), F.col("ord")], budget)


def pack(sections: DataFrame, max_tokens: int) -> DataFrame:
    """Mandatory sections, then the longest prefix by weight per token that fits (sections: pack, idx, text, weight, mandatory).

    A running sum over a hot pack goes by slices of the density order.
    """
    rows = sections.withColumn("cost", estimate_tokens(F.col("text")))
    need = rows.groupBy("pack").agg(F.coalesce(F.sum(F.when(F.col("mandatory"), F.col("cost"))), F.lit(0)).alias("_must"))
    density = F.when(F.col("cost") > 0, F.col("weight") / F.col("cost")).otherwise(F.lit(1e308))
    optional = rows.filter(~F.col("mandatory")).withColumn("_d", -density)
    optional = optional.withColumn("_slice", -F.floor(F.least(density, F.lit(1e6)) * 64))
    optional = running_sum(optional, ["pack"], ["_d", "idx"], F.col("cost"), "_cum")
    out = rows.filter("mandatory").withColumn("included", F.lit(True)).unionByName(
        optional.join(need, "pack").withColumn("included", F.col("_cum") <= F.lit(max_tokens) - F.col("_must")).drop("_d", "_slice", "_cum", "_must"))
    return out


def after_key(rows: DataFrame, last: tuple[float, object] | None, size: int, scope: list[str]) -> DataFrame:
    """Keyset page: rows after (score, item) in rank order."""
    if last is not None:
        rows = rows.filter((F.col("score") < last[0]) | ((F.col("score") == last[0]) & (F.col("item") > last[1])))
    return top_k(rows, scope, [F.desc("score"), F.col("item")], size, out="row")


def cursor(scope: Column, score: Column, item: Column) -> Column:
    """Page token bound to its query scope."""
    return F.concat_ws(":", F.substring(F.sha2(scope, 256), 1, 16), score.cast("string"), item.cast("string"))


def evidence_order(rows: DataFrame, k: int) -> DataFrame:
    """By typed-evidence hits, query overlap, lane priority, then arrival (rows: query, item, hits, overlap, lane_priority, ord)."""
    return top_k(rows, ["query"], [F.desc("hits"), F.desc("overlap"), F.desc("lane_priority"), F.col("ord")], k)


def reserve_lane(fused: DataFrame, source_rows: DataFrame, limit: int, slots: int, source_first: bool = False) -> DataFrame:
    """Keep `slots` diverse source rows inside the limit, before or after the primary rows (both: query, item, ord; source also source_group)."""
    reserved = diverse_sources(source_rows, slots).select("query", "item", F.col("rank").alias("_o")).withColumn("_part", F.lit(0 if source_first else 1))
    count = reserved.groupBy("query").agg(F.count(F.lit(1)).alias("_n"))
    primary = fused.join(reserved.select("query", "item"), ["query", "item"], "left_anti")
    primary = top_k(primary, ["query"], [F.col("ord"), F.col("item")], limit, out="_o").join(count, "query", "left").filter(
        F.col("_o") <= F.lit(limit) - F.coalesce("_n", F.lit(0)))
    both = primary.select("query", "item", "_o", F.lit(1 if source_first else 0).alias("_part")).unionByName(reserved)
    return top_k(both, ["query"], [F.col("_part"), F.col("_o")], limit, out="position").select("query", "item", "position")


def expand_terms(terms: DataFrame, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> DataFrame:
    """Query terms with their synonyms at the profile's expansion weight left to the caller (terms: query, term)."""
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    more = F.coalesce(table[F.col("term")], F.array().cast("array<string>"))
    rows = terms.withColumn("_x", F.explode(F.concat(F.array(F.struct(F.col("term").alias("t"), F.lit(False).alias("e"))),
                                                     F.transform(more, lambda s: F.struct(s.alias("t"), F.lit(True).alias("e"))))))
    return rows.groupBy("query", F.col("_x.t").alias("term")).agg(F.min("_x.e").alias("expanded"))
