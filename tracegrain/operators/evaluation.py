"""Metrics over retrieval runs and gold labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ordered import running_sum


def _share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of)


def score_cases(cases: DataFrame, results: DataFrame, texts: DataFrame) -> DataFrame:
    """Recall@1/5/10, answer recall, score with forbidden-term penalty, identity and source recall per (backend, case).

    Cases: case_id, expected, forbidden, identity, source (arrays of terms); results: backend, case_id, rank, item;
    texts: item, text.  Each term's best rank is found first, so every metric is a count over terms.
    """
    kinds = ("expected", "forbidden", "identity", "source")
    terms = cases.select("case_id", F.explode(F.concat(*[_typed(k) for k in kinds])).alias("x")).select("case_id", "x.*")
    backends = results.select("backend", "case_id").distinct()
    hits = results.join(texts.select("item", F.lower("text").alias("_t")), "item").join(terms, "case_id").filter(F.contains("_t", F.col("term")))
    best = hits.groupBy("backend", "case_id", "kind", "term").agg(F.min("rank").alias("rank"))
    rows = backends.join(terms, "case_id").join(best, ["backend", "case_id", "kind", "term"], "left")
    of = lambda k: F.count_if(F.col("kind") == k)
    met = lambda k, n=None: F.count_if((F.col("kind") == k) & (F.col("rank").isNotNull() if n is None else F.coalesce(F.col("rank") <= n, F.lit(False))))
    out = rows.groupBy("backend", "case_id").agg(
        *[of(k).alias(f"n_{k}") for k in kinds], *[met(k).alias(f"hit_{k}") for k in kinds],
        met("expected", 5).alias("_a5"), met("expected", 10).alias("_a10"),
        *[F.min(F.when(F.col("kind") == k, F.col("rank"))).alias(f"_first_{k}") for k in ("source", "identity", "expected")])
    first = F.when(F.col("n_source") > 0, F.col("_first_source")).when(F.col("n_identity") > 0, F.col("_first_identity")).otherwise(F.col("_first_expected"))
    has_target = (F.col("n_source") + F.col("n_identity") + F.col("n_expected")) > 0
    recall = lambda k: F.when(has_target, F.when(first <= k, 1.0).otherwise(0.0))
    expected = F.coalesce(_share(F.col("hit_expected"), F.col("n_expected")), F.lit(1.0))
    penalty = F.col("hit_forbidden") / F.greatest(F.col("n_forbidden"), F.lit(1))
    r4 = lambda c: F.round(c, 4)
    return out.select(
        "backend", "case_id", r4(F.greatest(F.lit(0.0), expected - penalty)).alias("score"),
        *[recall(k).alias(f"recall_at_{k}") for k in (1, 5, 10)],
        r4(_share(F.col("_a5"), F.col("n_expected"))).alias("answer_recall_at_5"), r4(_share(F.col("_a10"), F.col("n_expected"))).alias("answer_recall_at_10"),
        r4(_share(F.col("hit_identity"), F.col("n_identity"))).alias("identity_recall"), r4(_share(F.col("hit_source"), F.col("n_source"))).alias("source_recall"),
        F.col("hit_forbidden").alias("forbidden_hits"), (F.col("n_expected") - F.col("hit_expected")).alias("missing_expected"))


def _typed(kind: str) -> Column:
    return F.transform(F.coalesce(F.col(kind), F.array().cast("array<string>")), lambda t: F.struct(F.lit(kind).alias("kind"), F.lower(t).alias("term")))


def miss_category(rows: DataFrame) -> DataFrame:
    """Likely failure layer of each run, first matching reason."""
    c = F.col
    eq = lambda name, v: F.coalesce(c(name) == v, F.lit(False))
    kind = (F.when(c("forbidden_hits") > 0, "stale_or_forbidden_hit")
            .when(eq("answer_recall_at_5", 1.0) & eq("identity_recall", 0.0), "projection_miss").when(eq("recall_at_10", 0.0), "retrieval_miss")
            .when(eq("recall_at_5", 0.0), "ranking_miss").when(eq("recall_at_5", 1.0) & eq("answer_recall_at_5", 0.0), "synthesis_miss")
            .when(c("score") >= 1.0, "hit").when(c("missing_expected") > 0, "answer_miss").otherwise("partial_hit"))
    return rows.withColumn("miss_category", kind)


def miss_taxonomy(rows: DataFrame) -> DataFrame:
    return rows.filter("miss_category <> 'hit'").groupBy("backend", "miss_category").agg(F.count(F.lit(1)).alias("runs"))


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float], bucket: Column | None = None) -> DataFrame:
    """Interpolated percentiles per key from value counts, so a hot key is never sorted in one task.

    `bucket` must be monotone in the value; it splits the running count of a key over tasks.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_slice", (bucket if bucket is not None else F.floor("_v")))
    counts = running_sum(counts, keys, ["_v"], F.col("_n"), "_cum")
    counts = counts.join(counts.groupBy(*keys).agg(F.sum("_n").alias("_total")), keys)
    at = lambda pos: F.min(F.when(F.col("_cum") > pos, F.col("_v")))
    aggs, outs = [], []
    for name, p in points.items():
        rank = (F.col("_total") - 1) * p
        aggs += [at(F.floor(rank)).alias(f"_lo_{name}"), at(F.ceil(rank)).alias(f"_hi_{name}"), F.first(rank - F.floor(rank)).alias(f"_w_{name}")]
        outs.append((F.col(f"_lo_{name}") * (1 - F.col(f"_w_{name}")) + F.col(f"_hi_{name}") * F.col(f"_w_{name}")).alias(name))
    return counts.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def run_summary(runs: DataFrame) -> DataFrame:
    """Means and p50/p95/p99 latency by backend and by (backend, category); a null category is the backend total."""
    both = runs.withColumn("category", F.explode(F.array(F.lit(None).cast("string"), F.col("category"))))
    both = both.withColumn("_cat", F.coalesce("category", F.lit("\x00all")))
    keys = ["backend", "_cat"]
    means = both.groupBy(*keys).agg(
        F.first("category").alias("category"), F.count(F.lit(1)).alias("runs"), F.round(F.avg("score"), 4).alias("mean_score"),
        *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("recall_at_5", "answer_recall_at_5")], F.round(F.avg("bytes"), 4).alias("mean_bytes"))
    spread = exact_percentiles(both, keys, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    return means.join(spread, keys).drop("_cat")


def paired_deltas(runs: DataFrame, target: str) -> DataFrame:
    """(baseline, delta) of scores on the same (case, run)."""
    mine = runs.filter(F.col("backend") == target).select("case_id", "run", F.col("score").alias("_mine"))
    return runs.filter(F.col("backend") != target).join(mine, ["case_id", "run"]).select(
        F.col("backend").alias("baseline"), F.round(F.col("_mine") - F.col("score"), 4).alias("delta"))


def paired_comparison(runs: DataFrame, target: str, samples: int = 2000, seed: int = 1) -> DataFrame:
    """Mean delta, bootstrap interval and sign-flip p-value of the target against each baseline.

    Deltas are counted per value (at most 20,001 values of four decimals); drawing n rows with replacement is a
    multinomial draw over those counts, so resampling never touches rows again.
    """
    histogram = paired_deltas(runs, target).groupBy("baseline", "delta").agg(F.count(F.lit(1)).alias("n"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        pdf = pdf.sort_values("delta")
        x, n = pdf["delta"].to_numpy(float), pdf["n"].to_numpy(np.int64)
        total = int(n.sum())
        mean = float((x * n).sum() / total)
        rng = np.random.default_rng(seed)
        means = np.concatenate([rng.multinomial(total, n / total, size=min(200, samples - i)) @ x / total for i in range(0, samples, 200)])
        low, high = np.quantile(means, [0.025, 0.975])
        if total <= 20:
            d = np.repeat(x, n)
            signs = 1 - 2 * ((np.arange(2 ** total)[:, None] >> np.arange(total)) & 1)
            p = float(np.mean(np.abs(signs @ d / total) >= abs(mean) - 1e-12))
        else:
            draws = 10000
            flips = np.concatenate([(2 * rng.binomial(n, 0.5, size=(min(500, draws - i), len(n))) - n) @ x / total for i in range(0, draws, 500)])
            p = float((np.sum(np.abs(flips) >= abs(mean)) + 1) / (draws + 1))
        return pd.DataFrame([(pdf["baseline"].iloc[0], total, round(mean, 4), round(float(low), 4), round(float(high), 4), round(p, 6), bool(low > 0 and p < 0.05))],
                            columns=["baseline", "pairs", "mean_difference", "ci_low", "ci_high", "p_value", "significant"])

    return histogram.groupBy("baseline").applyInPandas(
        compare, "baseline string, pairs long, mean_difference double, ci_low double, ci_high double, p_value double, significant boolean")


def guardrails(candidate: DataFrame, baseline: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Minimum, maximum and regression checks (candidate, baseline: metric, value; thresholds: check, metric, kind, bound).

    A missing value fails a minimum; `ratio` needs candidate <= baseline x (1 + bound).
    """
    rows = thresholds.join(candidate.select("metric", "value"), "metric", "left").join(
        baseline.select("metric", F.col("value").alias("base")), "metric", "left")
    ok = (F.when(F.col("kind") == "min", F.coalesce(F.col("value") >= F.col("bound"), F.lit(False)))
          .when(F.col("kind") == "max", F.coalesce(F.col("value") <= F.col("bound"), F.lit(True)))
          .otherwise(F.coalesce(F.col("value") <= F.col("base") * (1 + F.col("bound")), F.lit(True))))
    return rows.withColumn("passed", ok)


def calibration(rows: DataFrame) -> DataFrame:
    """Hit rate per verdict and Brier score per family (rows: verdict, family, label, score)."""
    verdicts = rows.groupBy(F.lit("verdict").alias("kind"), F.col("verdict").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 4).alias("positive_rate"), F.lit(None).cast("double").alias("brier"))
    families = rows.groupBy(F.lit("family").alias("kind"), F.col("family").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 4).alias("positive_rate"),
        F.round(F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))), 4).alias("brier"))
    return verdicts.unionByName(families)


def state_recovery(rows: DataFrame) -> DataFrame:
    """Per-case metrics (rows: baseline, case_id, returned, terms, cited, expected_terms, minimal, stale, distractor, should_abstain)."""
    shared = lambda a, b: F.size(F.array_intersect(a, b))
    one = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    empty = F.size("returned") == 0
    return rows.withColumns({
        "state_accuracy": one(F.size(F.array_except("expected_terms", "terms")) == 0),
        "evidence_recall": F.when(F.size("minimal") == 0, 1.0).otherwise(shared("returned", "minimal") / F.size("minimal")),
        "stale_rejection": one(shared("returned", "stale") == 0), "distractor_resistance": one(shared("returned", "distractor") == 0),
        "abstention": one(empty == F.col("should_abstain")),
        "citation_coverage": one((empty & F.col("should_abstain")) | (~empty & (F.col("cited") == F.size("returned"))))})


STATE_METRICS = ("state_accuracy", "evidence_recall", "stale_rejection", "distractor_resistance", "abstention", "citation_coverage")


def state_means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("baseline").agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(m), 4).alias(m) for m in STATE_METRICS])


def claim_scores(predicted: DataFrame, gold: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Precision and recall of predicted against gold rows per group, matched on `keys`."""
    p = predicted.select(group, *keys).distinct().withColumn("_p", F.lit(1))
    g = gold.select(group, *keys).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, [group, *keys], "full").groupBy(group).agg(
        F.count("_p").alias("predicted"), F.count("_g").alias("gold"), F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("matched"))
    ratio = lambda of: F.round(F.when(F.col(of) > 0, F.col("matched") / F.col(of)).otherwise(F.lit(1.0)), 4)
    return both.withColumns({"precision": ratio("predicted"), "recall": ratio("gold")})


def candidate_scores(cases: DataFrame, candidates: DataFrame, authority: str = "non_authoritative") -> DataFrame:
    """Id and type match, exact source set, citation coverage, authority boundary and their mean per gold case.

    Cases: case_id, candidate_id, candidate_type, sources (array); candidates: candidate_id, candidate_type, sources, cited, authority_status.
    """
    c = candidates.select("candidate_id", F.col("candidate_type").alias("_type"), F.col("sources").alias("_src"), F.col("cited").alias("_cited"), "authority_status")
    rows = cases.join(c, "candidate_id", "left")
    b = lambda cond: F.coalesce(cond, F.lit(False))
    same = (F.size(F.array_except("sources", "_src")) == 0) & (F.size(F.array_except("_src", "sources")) == 0)
    out = rows.withColumns({"candidate_match": b(F.col("_type") == F.col("candidate_type")), "source_fidelity": b(F.col("_src").isNotNull() & same),
                            "citation_coverage": b(F.size(F.array_except("sources", "_cited")) == 0), "authority_boundary": b(F.col("authority_status") == authority)})
    metrics = ("candidate_match", "source_fidelity", "citation_coverage", "authority_boundary")
    return out.select("case_id", *metrics, F.round(sum(F.col(m).cast("int") for m in metrics) / len(metrics), 4).alias("score"))


def causal_scores(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Best-matching causal result per gold case (cases: case_id, endpoint, relation; results: case_id, endpoint, relation, cited, authority_status)."""
    r = results.select("case_id", F.col("endpoint").alias("_e"), F.col("relation").alias("_r"), "cited", "authority_status")
    rows = cases.join(r, "case_id", "left")
    hit = F.coalesce(F.col("_e") == F.col("endpoint"), F.lit(False))
    flag = lambda cond: (hit & F.coalesce(cond, F.lit(False))).cast("int")
    marks = F.struct(hit.cast("int").alias("hit"), flag(F.col("_r") == F.col("relation")).alias("relation_match"), flag(F.col("cited")).alias("citation"),
                     flag(F.col("authority_status") == "non_authoritative").alias("authority_boundary"))
    rank = F.struct((marks["hit"] + marks["relation_match"] + marks["citation"] + marks["authority_boundary"]).alias("t"), marks.alias("m"))
    best = rows.groupBy("case_id").agg(F.max(rank).alias("b"))
    return best.select("case_id", "b.m.*", F.round(F.col("b.t") / 4, 4).alias("score"))
