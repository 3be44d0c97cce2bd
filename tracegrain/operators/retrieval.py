"""Keyword retrieval over text tables: postings, BM25, novelty and associative completion."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, long_words
from ..ordered import running_sum, salted_join, top_k
from ..session import cut, kept, stored
from . import membership, overlap

K1, B = 1.5, 0.75
CELL_POSTINGS = 1 << 19  # postings and queries that meet in one cell
CELL_QUERIES = 2048


def document_terms(docs: DataFrame, doc_id: str, text: Column, vocabulary: DataFrame | None = None) -> DataFrame:
    """Postings (doc, dl, term, tf).  Each document's tokens sit in one task, so tf is combined before the shuffle.

    With a `vocabulary` (term) only those terms are kept; lengths still count every token.
    """
    tokens = docs.select(F.col(doc_id).alias("doc"), long_words(text).alias("_t")).select(
        "doc", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    if vocabulary is not None:
        tokens = tokens.join(vocabulary.select("term").distinct(), "term", "left_semi")
    return tokens.groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text: Column) -> DataFrame:
    """One row: documents and their mean length in tokens."""
    return docs.select(F.size(long_words(text)).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, query_id: str, text: Column, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Distinct query terms without stop words (query, term)."""
    kept = F.array_except(F.array_distinct(long_words(text)), F.array(*[F.lit(s) for s in stop]))
    return queries.select(F.col(query_id).alias("query"), F.explode(kept).alias("term"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _codes(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values and each row's place among them; null is a value."""
    coded = pa.concat_arrays(column.chunks).dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _runs(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their codes, and where each code's run begins."""
    order = np.argsort(codes, kind="stable")
    return order, np.searchsorted(codes[order], np.arange(n + 1))


def cell_scores(asked: DataFrame, postings: DataFrame, k: int | None, digits: int,
                combine: Callable[[list[np.ndarray]], np.ndarray] | None = None) -> DataFrame:
    """Sums over shared terms of a query's weight times the posting's `w`: query, doc, score, the best `k` of a query (all with k = None).

    Asked: query, term, weights (array of doubles, one sum each, all above 0 where the first is); postings: doc, term, w.  `combine` makes a score of the sums.
    Postings are read twice (their number, the cells), so they should be stored.  Both sides are dealt into cells of CELL_QUERIES x CELL_POSTINGS, documents whole; a cell sends k rows a query, so neither a frequent term's postings
    nor the (query, document) pairs ever meet in one task.  Ties go by doc.
    """
    asked = kept(asked, "asked")
    blocks = max(1, math.ceil(asked.select("query").distinct().count() / CELL_QUERIES))
    shards = max(1, math.ceil(postings.count() / CELL_POSTINGS))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("query", "term", "weights", deal("query", blocks).alias("block"), every(shards).alias("shard"))
    right = postings.select("doc", "term", F.col("w").cast("double").alias("w"), deal("doc", shards).alias("shard"), every(blocks).alias("block"))
    types = dict(asked.dtypes) | dict(postings.dtypes)

    def score(queries: pa.Table, held: pa.Table) -> pa.Table:
        if not queries.num_rows or not held.num_rows:
            return pa.table({"query": queries["query"].slice(0, 0), "doc": held["doc"].slice(0, 0), "score": pa.array([], pa.float64())})
        docs, doc = _codes(held["doc"])
        words, word = _codes(held["term"])
        names, name = _codes(queries["query"])
        term = pc.fill_null(pc.index_in(queries["term"], value_set=words), -1).to_numpy()
        weights = np.array(queries["weights"].to_pylist(), dtype=float)
        # rows of one document and term, as repeated ids give them, are one
        place, same = np.unique(word.astype(np.int64) * len(docs) + doc, return_inverse=True)
        doc, weight = place % len(docs), np.bincount(same, held["w"].to_numpy())
        start = np.searchsorted(place, np.arange(len(words) + 1) * len(docs))
        rank = np.empty(len(docs), dtype=np.int64)
        rank[pc.sort_indices(docs, null_placement="at_start").to_numpy()] = np.arange(len(docs))
        rows, first = _runs(name, len(names))
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for q in range(len(names)):
            sums = np.zeros((weights.shape[1], len(docs)))
            for row in rows[first[q]:first[q + 1]]:
                if term[row] >= 0:
                    run = slice(start[term[row]], start[term[row] + 1])
                    for total, w in zip(sums, weights[row], strict=True):
                        total[doc[run]] += w * weight[run]
            hit = np.flatnonzero((sums > 0).any(axis=0))
            value = np.round(combine([s[hit] for s in sums]) if combine else sums[0][hit], digits)
            if k is not None and len(hit) > k:
                near = np.flatnonzero(value >= -np.partition(-value, k - 1)[k - 1])
                near = near[np.lexsort((rank[hit[near]], -value[near]))[:k]]
                hit, value = hit[near], value[near]
            found.append((q, hit, value))
        asking, hits, values = (np.concatenate(part) for part in zip(*((np.full(len(hit), q), hit, value) for q, hit, value in found), strict=True))
        return pa.table({"query": names.take(pa.array(asking)), "doc": docs.take(pa.array(hits)), "score": values})

    schema = f"query {types['query']}, doc {types['doc']}, score double"
    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(score, schema)


def bm25(terms: DataFrame, postings: DataFrame, stats: DataFrame, k: int | None = None) -> DataFrame:
    """BM25 scores (query, doc, score, rank with k).

    idf rides on the small (query, term) table; corpus totals are scalar subqueries.  Postings of the query's terms are written once, since
    document frequencies and cells (`cell_scores`) both read them.
    """
    n, avgdl = stats.select("n").scalar(), stats.select("avgdl").scalar()
    postings = kept(postings, "postings")
    asked = terms.join(document_frequency(postings), "term").select("query", "term", F.array(bm25_idf(n, F.col("df"))).alias("weights"))
    norm = K1 * (1 - B + B * F.col("dl") / avgdl)
    asked = stored(asked, "asked")
    weighed = postings.select("doc", "term", (F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("w")).join(asked.select("term").distinct(), "term", "left_semi")
    scored = cell_scores(asked, weighed, k, 6)
    return scored if k is None else stored(top_k(scored, ["query"], [F.desc("score"), F.col("doc")], k), "keyword-hits")


def shared_terms(terms: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """Documents by the number of the query's terms they hold: query, doc, hits, rank."""
    asked = terms.select("query", "term", F.array(F.lit(1.0)).alias("weights"))
    found = cell_scores(asked, postings.select("doc", "term", F.lit(1.0).alias("w")), k, 0).withColumn("hits", F.col("score").cast("bigint")).drop("score")
    return top_k(found, ["query"], [F.desc("hits"), F.col("doc")], k)


def keyword_search(queries: DataFrame, docs: DataFrame, query_id: str, query_text: Column, doc_id: str, text: Column, k: int) -> DataFrame:
    """BM25 over raw text: one pass for lengths, one for the postings of query terms only."""
    terms = query_terms(queries, query_id, query_text)
    return bm25(terms, document_terms(docs, doc_id, text, terms), corpus_stats(docs, text), k)


def extend_postings(postings: DataFrame, stats: DataFrame, new_docs: DataFrame, doc_id: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """Append documents to an existing index; totals are merged, old postings are not touched."""
    added, fresh = document_terms(new_docs, doc_id, text), corpus_stats(new_docs, text)
    both = stats.unionByName(fresh)
    merged = both.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("avgdl")) / F.sum("n")).alias("avgdl"))
    return postings.unionByName(added), merged


def candidate_terms(terms: DataFrame, postings: DataFrame, max_candidates: int = 1000, min_terms: int = 4) -> DataFrame:
    """Rarest-first terms of each query while their documents stay within `max_candidates`, at least `min_terms`.

    A document counts at its rarest matching term, so the union size after each term is a running count, not a
    union of posting lists.  This narrows candidates only when a caller asks for it; `bm25` never does.
    """
    ranked = terms.join(document_frequency(postings), "term").withColumn("_slice", F.lit(0))
    ranked = running_sum(ranked, ["query"], ["df", "term"], F.lit(1), "rarity")
    first = postings.select("doc", "term").join(ranked.select("query", "term", "rarity"), "term").groupBy("query", "doc").agg(F.min("rarity").alias("rarity"))
    new = first.groupBy("query", "rarity").agg(F.count(F.lit(1)).alias("new_docs"))
    rows = ranked.join(new, ["query", "rarity"], "left").fillna(0, ["new_docs"])
    rows = running_sum(rows, ["query"], ["rarity"], F.col("new_docs"), "candidates").drop("_slice")
    return rows.withColumn("selected", (F.col("rarity") <= min_terms) | (F.col("candidates") <= max_candidates))


def nearest_overlap(new: DataFrame, existing: DataFrame, threshold: float) -> DataFrame:
    """Closest existing text per new text by token Jaccard, where at least `threshold`: (id, overlap, nearest).

    Ids are unique.  Texts are tokenised once; their sets meet in cells (`overlap.closest`), from which one row per new text and cell
    comes back, not the pairs.  Copies are rows of a cell like others, and cells are bounded.
    """
    side = lambda df, new: df.select(F.lit(new).alias("new"), "id", F.array_distinct(long_words(F.col("text"))).alias("words"))
    sets = overlap.hashed_words(stored(side(new, True).unionByName(side(existing, False)).filter(F.size("words") > 0), "word-sets"))
    best = overlap.closest(sets.filter("new").select("id", "words"), sets.filter("not new").select("id", "words"), threshold)
    return best.select("id", F.round("overlap", 6).alias("overlap"), "nearest")


# thresholds of the write-time gate (fixed values)
REDUNDANT, REINFORCING, CORROBORATED = 0.9, 0.6, 0.4


def novelty_gate(new: DataFrame, existing: DataFrame, entity_overlap: Column | None = None) -> DataFrame:
    """Each new text as redundant, reinforcing or novel by its closest existing text."""
    known = entity_overlap if entity_overlap is not None else F.lit(0.0)
    near = nearest_overlap(new.select("id", "text"), existing.select("id", "text"), CORROBORATED)
    rows = new.join(near, "id", "left").fillna(0.0, ["overlap"])
    kind = (F.when(F.col("overlap") >= REDUNDANT, "redundant").when(F.col("overlap") >= REINFORCING, "reinforcing")
            .when((F.col("overlap") >= CORROBORATED) & (known >= 1.0), "reinforcing").otherwise("novel"))
    return rows.withColumn("classification", kind)


# ---------------------------------------------------------------------------------------------------------------------
# associative completion over packets (term sets)

AUTHORITY_WORDS = ("accepted", "current", "root cause", "requires", "quality bar")
BOOST_WORDS = ("accepted", "current", "resolution", "policy")
STALE_WORDS = ("stale", "superseded", "old", "deprecated")


def packet_index(packets: DataFrame, packet_id: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """(doc, term, idf, df, norm) and (term, idf, df) of distinct terms; idf = ln((1 + n) / (1 + df)) + 1."""
    terms = packets.select(F.col(packet_id).alias("doc"), F.explode(F.array_distinct(long_words(text))).alias("term"))
    n = packets.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"), "df")
    weighted = salted_join(terms, idf, ["term"])  # a frequent term's rows would meet in one task
    norms = weighted.groupBy("doc").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    return weighted.join(norms, "doc"), idf


def direct_scores(cue: DataFrame, index: DataFrame) -> DataFrame:
    """Idf mass of shared terms over the packet norm (cue: query, term)."""
    return salted_join(index, cue, ["term"]).groupBy("query", "doc").agg((F.sum("idf") / F.first("norm")).alias("direct"))


def active_scores(active: DataFrame, index: DataFrame, direct: DataFrame) -> DataFrame:
    """.35 direct + associative + sqrt(direct x associative) for the current activation (query, term, weight)."""
    norm = active.groupBy("query").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_an"))
    spread = salted_join(index, active, ["term"]).groupBy("query", "doc").agg((F.sum(F.col("weight") * F.col("idf")) / F.first("norm")).alias("_s"))
    rows = spread.join(norm, "query").join(direct, ["query", "doc"], "left")
    assoc, near = F.col("_s") / F.col("_an"), F.coalesce("direct", F.lit(0.0))
    return rows.select("query", "doc", F.round(0.35 * near + assoc + F.sqrt(near * assoc), 9).alias("score"))


def _reinforce(active: DataFrame, chosen: DataFrame, index: DataFrame, cue: DataFrame, bonus: float) -> DataFrame:
    gain = chosen.join(index, "doc").join(cue.withColumn("_cue", F.lit(True)), ["query", "term"], "left")
    novelty = F.when(F.col("_cue").isNull(), 1.0).otherwise(0.35)
    added = gain.select("query", "term", ((F.col("score") + bonus) * F.col("idf") * F.col("idf") * novelty).alias("weight"))
    return active.unionByName(added).groupBy("query", "term").agg(F.sum("weight").alias("weight"))


def associative_pool(cue: DataFrame, index: DataFrame, idf: DataFrame, top: int = 3, seed_k: int = 1, spread_k: int = 3,
                     rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Ranked pool of packets per query after seeding and `rounds` of activation, and the final activation.

    Each round only carries the top `spread_k` packets per query, so the activation stays small; packets and
    terms meet by equi joins.
    """
    best = lambda rows, k: top_k(rows, ["query"], [F.desc("score"), F.col("doc")], k)
    direct = cut(direct_scores(cue, index))
    active = cue.join(idf.select("term", "idf"), "term", "left").select("query", "term", F.coalesce("idf", F.lit(1.0)).alias("weight"))
    seeds = best(direct.withColumnRenamed("direct", "score"), seed_k).select("query", "doc", "score")
    active = cut(_reinforce(active, seeds, index, cue, 1.0))
    for _ in range(rounds):
        chosen = best(active_scores(active, index, direct), spread_k).select("query", "doc", "score")
        active = cut(_reinforce(active, chosen, index, cue, 0.0))
    return best(active_scores(active, index, direct), max(3 * top, top)), active


def select_evidence(pool: DataFrame, top: int) -> DataFrame:
    """Greedy evidence choice per query over its bounded pool.

    Pool rows: query, doc, score, authority, is_authoritative, terms (array of struct(term, idf, weight)), cue (array).
    """
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        import math
        rows = []
        cue = set(pdf["cue"].iloc[0])
        for r in pdf.itertuples():
            rows.append({"doc": r.doc, "score": r.score, "auth": r.authority, "ok": r.is_authoritative,
                         "idf": {t["term"]: t["idf"] for t in r.terms}, "w": {t["term"]: t["weight"] for t in r.terms}})

        def utility(row, covered):
            return 0.45 * row["score"] + 0.025 * sum(w for t, w in row["w"].items() if t not in covered) + row["auth"]

        def similar(row, chosen):
            def cos(x, y):
                dot = sum(v * y.get(t, 0.0) for t, v in x.items())
                size = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
                return dot / size if size else 0.0
            return max((cos(row["idf"], c["idf"]) for c in chosen), default=0.0)

        order = sorted(rows, key=lambda r: (not r["ok"], -utility(r, cue), r["doc"]))
        picked, covered, plain = [], set(cue), 0
        for row in order:
            if len(picked) >= top:
                break
            u = utility(row, covered)
            if row["ok"]:
                if u < 0.55 or (picked and similar(row, picked) > 0.92):
                    continue
            elif picked and (len(picked) >= 2 or plain >= 1 or u < 1.35 or similar(row, picked) > 0.92):
                continue
            else:
                plain += 1
            picked.append(row)
            covered.update(row["idf"])
        if not picked:
            picked = sorted(rows, key=lambda r: (-r["score"], r["doc"]))[:top]
        return pd.DataFrame({"query": [pdf["query"].iloc[0]] * len(picked), "doc": [r["doc"] for r in picked],
                             "score": [r["score"] for r in picked], "position": range(1, len(picked) + 1)})

    types = dict(pool.dtypes)
    return pool.groupBy("query").applyInPandas(choose, f"query {types['query']}, doc {types['doc']}, score double, position long")


def associative_completion(queries: DataFrame, packets: DataFrame, query_id: str, query_text: Column, packet_id: str, text: Column,
                           kind: Column, top: int = 3) -> DataFrame:
    """Cited packets completing a partial cue: spread, pool, then the greedy choice."""
    cue = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(long_words(query_text))).alias("term"))
    index, idf = (cut(part) for part in packet_index(packets, packet_id, text))
    pool, active = associative_pool(cue, index, idf, top)
    pool = cut(pool)
    lowered = F.lower(text)
    says = lambda words: F.greatest(*[F.contains(lowered, F.lit(w)) for w in words])
    decided = kind.startswith("decision.") | kind.startswith("policy.")
    authority = (F.when(decided, 0.9).otherwise(0.0) + F.when(says(AUTHORITY_WORDS), 0.55).otherwise(0.0)
                 - F.when(says(STALE_WORDS), 1.25).otherwise(0.0) - F.when(kind.startswith("observation."), 0.3).otherwise(0.0))
    facts = packets.select(F.col(packet_id).alias("doc"), authority.alias("authority"), (decided | says(AUTHORITY_WORDS)).alias("is_authoritative"))
    words = pool.select("query", "doc").join(index.select("doc", "term", "idf"), "doc").join(active, ["query", "term"], "left")
    words = words.groupBy("query", "doc").agg(F.collect_list(F.struct("term", "idf", F.coalesce("weight", F.lit(0.0)).alias("weight"))).alias("terms"))
    cues = cue.groupBy("query").agg(F.collect_list("term").alias("cue"))
    return select_evidence(pool.select("query", "doc", "score").join(facts, "doc").join(words, ["query", "doc"]).join(cues, "query"), top)


def baseline_rank(mode: str, cue: DataFrame, index: DataFrame, idf: DataFrame, flags: DataFrame, packets: int | Column, k: int) -> DataFrame:
    """Baselines over the same index: direct, cosine, one_hop or authority (flags: doc, boost, stale)."""
    best = lambda rows, n: top_k(rows.filter("score > 0"), ["query"], [F.desc("score"), F.col("doc")], n)
    index = kept(index.select("doc", "term", "idf", "norm", *(["df"] if mode == "one_hop" else [])), "packet-index")
    shares = index.select("doc", "term", (F.col("idf") / F.col("norm")).alias("w"))  # one posting's part of idf mass over norm
    plain = cue.select("query", "term", F.array(F.lit(1.0)).alias("weights"))
    if mode == "direct":
        return best(cell_scores(plain, shares, k, 9), k)
    weight = cue.join(idf.select("term", "idf"), "term", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    qnorm = weight.groupBy("query").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("qn"))
    if mode == "cosine":
        return best(cell_scores(weight.join(qnorm, "query").select("query", "term", F.array(F.col("idf") / F.col("qn")).alias("weights")), shares, k, 9), k)
    if mode == "authority":
        sums = salted_join(index, cue, ["term"]).groupBy("query", "doc").agg(
            F.sum("idf").alias("mass"), F.sum(F.col("idf") * F.col("idf")).alias("dot"), F.first("norm").alias("norm")).join(qnorm, "query")
        cosine = F.col("dot") / (F.col("norm") * F.col("qn"))
        flagged = sums.join(flags, "doc")
        score = F.col("mass") + cosine + F.when(F.col("boost"), 0.35).otherwise(0.0) - F.when(F.col("stale"), 0.75).otherwise(0.0)
        return best(flagged.select("query", "doc", F.round(score, 9).alias("score")), k)
    rare = F.col("df") <= F.greatest(F.lit(3), F.floor(packets / 2) if isinstance(packets, Column) else F.lit(packets // 2))
    seeds = stored(best(cell_scores(plain, shares, 1, 9), 1).select("query", "doc"), "seeds")
    hop = seeds.join(index.filter(rare), "doc").select("query", "term")
    terms = cue.select("query", "term", F.lit(1.0).alias("_cue")).unionByName(hop.withColumn("_cue", F.lit(0.0))).groupBy("query", "term").agg(F.max("_cue").alias("_cue"))
    terms = stored(terms.join(idf.select("term", F.col("idf").alias("weight")), "term", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))), "active")
    norm = terms.groupBy("query").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_an"))
    active = terms.join(norm, "query").select("query", "term", F.array(F.col("weight") / F.col("_an"), F.col("_cue")).alias("weights"))
    return best(cell_scores(active, shares, k, 9, lambda sums: 0.35 * sums[1] + sums[0] + np.sqrt(sums[0] * sums[1])), k)


# ---------------------------------------------------------------------------------------------------------------------
# feeling of knowing

def feeling_of_knowing(queries: DataFrame, names: DataFrame, cues: DataFrame, salience: DataFrame, known_terms: membership.Filter | None = None) -> DataFrame:
    """Would a lookup likely return something?  .6 known-term ratio + .25 cue ratio + .15 salience share.

    Queries: query, term; names: name; cues: term, hits; salience: name, score.  Known terms are an exact table, or a `known_terms` filter kept
    from earlier, which may know a term too many but never one too few.
    """
    words = names.select("name", F.explode(F.array_distinct(long_words(F.col("name")))).alias("term"))
    if known_terms is None:
        queries = queries.join(words.select("term").distinct().withColumn("_k", F.lit(1)), "term", "left")
    else:
        queries = membership.might_contain(queries, "term", known_terms).withColumn("_k", F.col("maybe").cast("int")).drop("maybe")
    mass = words.join(salience, "name").groupBy("term").agg(F.sum("score").alias("_m"))
    total = salience.agg(F.sum("score").alias("t")).scalar()
    rows = queries.join(cues.filter("hits > 0").select("term", F.lit(1).alias("_c")), "term", "left").join(mass, "term", "left")
    out = rows.groupBy("query").agg(F.avg(F.coalesce("_k", F.lit(0))).alias("known"), F.avg(F.coalesce("_c", F.lit(0))).alias("cued"),
                                    F.coalesce(F.sum("_m"), F.lit(0.0)).alias("_mass"))
    share = F.coalesce(F.least(F.lit(1.0), F.col("_mass") / total), F.lit(0.0))
    out = out.withColumn("score", F.round(0.6 * F.col("known") + 0.25 * F.col("cued") + 0.15 * share, 6))
    return out.withColumn("verdict", F.when(F.col("score") >= LIKELY, "likely").when(F.col("score") >= POSSIBLE, "possible").otherwise("unlikely")).drop("_mass")


LIKELY, POSSIBLE = 0.55, 0.2  # fixed values
