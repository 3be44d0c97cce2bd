"""Replay analytics: state that is a pure function of the log and an explicit `now`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp, long_words
from ..ordered import neighbour, top_k, tree_fold

# reinforcement multipliers, score bounds and half-life (fixed values)
MULTIPLIERS = {"surfaced": 1.05, "confirmed": 1.5, "promoted": 2.0, "invalidated": 0.2}
SALIENCE_MIN, SALIENCE_MAX, HALF_LIFE_DAYS = 0.01, 10.0, 30.0
DAY_US = 86_400_000_000


def _table(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def recency(at_us: Column, now_us: int, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    age = F.greatest(F.lit(0.0), (F.lit(now_us) - at_us) / DAY_US)
    return F.pow(F.lit(0.5), age / half_life_days)


def salience(reinforcements: DataFrame, now_us: int, half_life_days: float = HALF_LIFE_DAYS,
             multipliers: dict[str, float] = MULTIPLIERS) -> DataFrame:
    """Salience per (session, target): kind counts, clamped running product, decay since the last reinforcement.

    The product is clamped after every step, so it depends on order.  x -> min(hi, max(lo, a x)) is closed
    under composition, which lets slices of a long history fold apart and combine in order.
    """
    known = reinforcements.filter(F.col("kind").isin(*multipliers)).withColumn(
        "_m", F.coalesce("weight", _table(multipliers)[F.col("kind")]))
    step = F.struct(F.col("_m").cast("double").alias("a"), F.lit(SALIENCE_MIN).alias("lo"), F.lit(SALIENCE_MAX).alias("hi"))

    def compose(f: Column, g: Column) -> Column:
        bound = lambda x: F.least(g["hi"], F.greatest(g["lo"], x))
        return F.struct((g["a"] * f["a"]).alias("a"), bound(g["a"] * f["lo"]).alias("lo"), bound(g["a"] * f["hi"]).alias("hi"))

    whole = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("lo"), F.lit(1e300).alias("hi"))
    key = ["session", "target"]
    folded = tree_fold(known, key, "seq", step, compose, whole, "_f")
    counts = known.groupBy(*key).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in multipliers], F.max_by("ts_us", "seq").alias("last_us"))
    factor = F.least(F.col("_f.hi"), F.greatest(F.col("_f.lo"), F.col("_f.a") * 1.0))
    out = counts.join(folded, key).withColumn("factor", factor).withColumn("recency", recency(F.col("last_us"), now_us, half_life_days))
    return out.withColumn("score", clamp(F.col("factor") * F.col("recency"), SALIENCE_MIN, SALIENCE_MAX)).drop("_f")


def surprise_weight(kind: Column, prediction_error: Column, multipliers: dict[str, float] = MULTIPLIERS,
                    low: float = SALIENCE_MIN, high: float = SALIENCE_MAX) -> Column:
    base = _table(multipliers)[kind]
    return clamp(base + (base - 1.0) * (2.0 * prediction_error - 1.0), low, high)


def prediction_error(outcome: Column, prior: Column) -> Column:
    """|outcome - prior| with success 1, partial .5, failure 0."""
    return F.abs(_table({"success": 1.0, "partial": 0.5, "failure": 0.0})[outcome] - prior)


# outcomes that count for or against a memory (fixed values)
POSITIVE = ("avoided_failed_path", "blocked_unsafe_action", "changed_answer", "helpful", "prevented_redundant_investigation",
            "resolved_conflict", "supported_handoff", "used")
NEGATIVE = ("caused_regression", "corrected", "excluded", "failed", "irrelevant", "rejected")


def polarity(outcome: Column) -> Column:
    return F.when(outcome.isin(*POSITIVE), "positive").when(outcome.isin(*NEGATIVE), "negative")


def purpose_outcomes(feedback: DataFrame) -> DataFrame:
    """Per (profile, target): positive and negative counts, outcomes, latest seq, score multiplier, suppression.

    Feedback: profile, targets (array), outcome, seq.
    """
    rows = feedback.withColumn("_p", polarity(F.col("outcome"))).filter("_p IS NOT NULL AND profile <> 'general'")
    out = rows.withColumn("target", F.explode("targets")).groupBy("profile", "target").agg(
        F.count_if(F.col("_p") == "positive").alias("positive"), F.count_if(F.col("_p") == "negative").alias("negative"),
        F.array_join(F.array_sort(F.collect_set("outcome")), ",").alias("outcomes"), F.max("seq").alias("latest_seq"))
    boost, penalty = F.least(F.lit(0.20), F.col("positive") * 0.06), F.least(F.lit(0.18), F.col("negative") * 0.06)
    return out.withColumn("multiplier", F.greatest(F.lit(0.1), 1.0 + boost - penalty)).withColumn(
        "suppress", (F.col("negative") >= 2) & (F.col("negative") >= F.col("positive")))


def apply_outcomes(contexts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Contexts (profile, target, score) rescored by what was learned; others keep their score."""
    return (contexts.join(outcomes.select("profile", "target", "multiplier", "suppress"), ["profile", "target"], "left")
            .withColumn("score", F.col("score") * F.coalesce("multiplier", F.lit(1.0)))
            .withColumn("suppress", F.coalesce("suppress", F.lit(False))))


def purpose_lanes(checkouts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per profile: checkouts, evidence pass and fail, suppression by reason, warnings and feedback counts."""
    lanes = checkouts.groupBy("profile").agg(
        F.count(F.lit(1)).alias("checkouts"), F.count_if(F.col("evidence_status") == "pass").alias("evidence_pass"),
        F.count_if(F.col("evidence_status") == "fail").alias("evidence_fail"), F.sum("warnings").alias("warnings"),
        F.max("seq").alias("latest_seq"))
    reasons = checkouts.filter("suppress_reason IS NOT NULL").groupBy("profile", "suppress_reason").agg(F.count(F.lit(1)).alias("n"))
    reasons = reasons.groupBy("profile").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat("suppress_reason", F.lit("="), F.col("n").cast("string")))), ",").alias("suppressed"))
    votes = feedback.withColumn("_p", polarity(F.col("outcome"))).groupBy("profile").agg(
        F.count_if(F.col("_p") == "positive").alias("positive"), F.count_if(F.col("_p") == "negative").alias("negative"))
    return lanes.join(reasons, "profile", "left").join(votes, "profile", "full").fillna(
        0, ["checkouts", "evidence_pass", "evidence_fail", "warnings", "positive", "negative"])


def packet_reinforcements(reinforced: DataFrame) -> DataFrame:
    """Count and highest importance per cited source hash."""
    return reinforced.filter("source_event_hash IS NOT NULL AND source_event_hash <> ''").groupBy("source_event_hash").agg(
        F.count(F.lit(1)).alias("reinforcements"), F.greatest(F.lit(0.0), F.max("importance")).alias("importance"))


_GOOD, _BAD = ("used", "helpful", "passed", "success"), ("failed", "failure", "irrelevant", "regressed")


def skill_analytics(versions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per skill version: successes, failures, mean score, promotion flag and rollback reason.

    Versions: skill_id, version, seq, status; outcomes: skill_id, version, success_score, feedback.
    """
    key = ["skill_id", "version"]
    state = versions.groupBy(*key).agg(F.max_by("status", "seq").alias("status"))
    word, score = F.lower(F.trim("feedback")), F.col("success_score")
    tally = outcomes.groupBy(*key).agg(
        F.count_if(word.isin(*_GOOD) | F.coalesce(score >= 0.8, F.lit(False))).alias("successes"),
        F.count_if(word.isin(*_BAD) | F.coalesce(score < 0.5, F.lit(False))).alias("failures"),
        F.round(F.avg("success_score"), 4).alias("mean_score"))
    both = state.join(tally, key, "full").fillna(0, ["successes", "failures"]).fillna("unknown", ["status"])
    promote = (F.col("status").isin("validated", "revised", "outcome_recorded") & (F.col("successes") > 0) & (F.col("failures") == 0)
               & (F.col("mean_score").isNull() | (F.col("mean_score") >= 0.8)))
    rollback = (F.when(F.col("status").isin("contradicted", "deprecated"), F.col("status"))
                .when(F.col("failures") > F.col("successes"), "failed_outcomes").when(F.col("mean_score") < 0.5, "low_success_score"))
    return both.withColumns({"promote": promote, "rollback_reason": rollback})


# ---------------------------------------------------------------------------------------------------------------------
# metacognition: events carry kind in (unknown, assessment, cluster, reverify) and flat columns

def metacognition_summary(events: DataFrame) -> DataFrame:
    n = lambda cond: F.count_if(F.expr(cond))
    return events.groupBy("session").agg(
        n("kind = 'unknown'").alias("unknowns"), n("kind = 'unknown' AND status = 'open'").alias("open_unknowns"),
        n("kind = 'assessment'").alias("assessments"), n("kind = 'cluster'").alias("clusters"),
        n("kind = 'cluster' AND status = 'unresolved'").alias("unresolved_clusters"),
        n("kind = 'reverify'").alias("reverify_requests"), n("kind = 'reverify' AND status = 'open'").alias("reverify_needed"))


def reverification_needs(events: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Open gaps with the reason each needs another look."""
    reason = (
        F.when((F.col("kind") == "unknown") & (F.col("status") == "open"), "known_unknown_open")
        .when((F.col("kind") == "reverify") & (F.col("status") == "open"), "reverify_request_open")
        .when((F.col("kind") == "cluster") & (F.col("status") == "unresolved"), "conflict_unresolved")
        .when((F.col("kind") == "assessment") & ((F.col("confidence") < min_confidence) | (F.col("conflicts") > 0)), "confidence_requires_reverify"))
    return events.withColumn("reason", reason).filter("reason IS NOT NULL")


def known_unknowns(events: DataFrame, status: str | None = "open") -> DataFrame:
    rows = events.filter("kind = 'unknown'")
    return rows if status is None else rows.filter(F.col("status") == status)


def conflict_clusters(events: DataFrame, unresolved_only: bool = True) -> DataFrame:
    rows = events.filter("kind = 'cluster'")
    return rows.filter("status = 'unresolved'") if unresolved_only else rows


def confidence_trajectory(events: DataFrame, slice_col: str = "_slice") -> DataFrame:
    """Assessments of each claim in order, with the change since the one before."""
    rows = events.filter("kind = 'assessment'")
    out = neighbour(rows, ["session", "claim_key"], ["seq"], F.col("confidence"), "previous", slice_col)
    return out.withColumn("change", F.round(F.col("confidence") - F.col("previous"), 6))


def plan_reverify(events: DataFrame) -> DataFrame:
    """One request per open gap unless one is open for that claim; clusters before unknowns, earliest first."""
    gaps = events.filter("(kind = 'cluster' AND status = 'unresolved') OR (kind = 'unknown' AND status = 'open')")
    busy = events.filter("kind = 'reverify' AND status = 'open'").select("session", "claim_key").distinct()
    order = F.struct(F.when(F.col("kind") == "cluster", 0).otherwise(1).alias("o"), "seq")
    chosen = gaps.join(busy, ["session", "claim_key"], "left_anti").groupBy("session", "claim_key").agg(
        F.min_by(F.struct("kind", "seq", "hash"), order).alias("g"))
    return chosen.select("session", "claim_key", F.when(F.col("g.kind") == "cluster", "high").otherwise("normal").alias("priority"),
                         F.col("g.seq").alias("source_seq"), F.col("g.hash").alias("source_hash"))


def claim_confidence(claims: DataFrame, evidence: DataFrame, conflict: Column, limit: int | None = None) -> DataFrame:
    """support / (support + conflict) over evidence sharing a word with the claim, best `limit` rows by rank.

    Claims: claim_id, text; evidence: evidence_id, rank, text.  Words meet by equi join; a word all rows share is
    cut down by (claim, evidence) de-duplication in the map-side combine.
    """
    left = claims.select("claim_id", F.explode(F.array_distinct(long_words(F.col("text")))).alias("w"))
    right = evidence.withColumn("_against", conflict).select("evidence_id", "rank", "_against", F.explode(F.array_distinct(long_words(F.col("text")))).alias("w"))
    if limit is not None:  # a claim's best rows are among the best rows of its words, so hot words are cut before the join
        right = top_k(right, ["w"], [F.col("rank"), F.col("evidence_id")], limit, out="_r").drop("_r")
    hits = left.join(right, "w").groupBy("claim_id", "evidence_id").agg(F.first("rank").alias("rank"), F.first("_against").alias("against"))
    if limit is not None:
        hits = top_k(hits, ["claim_id"], [F.col("rank"), F.col("evidence_id")], limit, out="_r")
    out = hits.groupBy("claim_id").agg(F.count_if(~F.col("against")).alias("support"), F.count_if("against").alias("conflict"))
    total = F.col("support") + F.col("conflict")
    return claims.select("claim_id").join(out, "claim_id", "left").fillna(0, ["support", "conflict"]).withColumn(
        "confidence", F.when(total > 0, F.round(F.col("support") / total, 4)).otherwise(F.lit(0.0)))


# ---------------------------------------------------------------------------------------------------------------------

def handoff_summary(log: DataFrame) -> DataFrame:
    """Per session: events, goals, open tasks and the last actor and time.  Log rows carry `task_id`."""
    tasks = log.filter(F.col("type").startswith("task.") & F.col("task_id").isNotNull())
    done = tasks.filter(F.col("type").startswith("task.completed")).select("session", "task_id").distinct()
    still = tasks.join(done, ["session", "task_id"], "left_anti").groupBy("session").agg(F.count(F.lit(1)).alias("open_tasks"))
    base = log.groupBy("session").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("type").startswith("goal.")).alias("goals"),
        F.max_by("actor", "seq").alias("last_actor"), F.max_by("ts_us", "seq").alias("last_ts_us"))
    return base.join(still, "session", "left").fillna(0, ["open_tasks"])


def consolidation_candidates(events: DataFrame) -> DataFrame:
    """Candidates with effective review status: the latest review not rolled back, else the created default.

    Events: session, seq, kind (created / reviewed / rolled_back), candidate_id, candidate_type, status, target_seq, stale.
    """
    key = ["session", "candidate_id"]
    created = events.filter("kind = 'created'").groupBy(*key).agg(
        F.min_by(F.struct("seq", "candidate_type", "stale"), "seq").alias("c"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    created = created.select(*key, F.col("c.seq").alias("created_seq"), "c.candidate_type", "c.stale", "duplicates")
    undone = events.filter("kind = 'rolled_back'").select("session", F.col("target_seq").alias("seq")).distinct().withColumn("_undone", F.lit(True))
    reviews = (events.filter("kind = 'reviewed'").join(created.select(*key, "created_seq"), key).filter("seq > created_seq")
               .join(undone, ["session", "seq"], "left"))
    live = F.when(F.col("_undone").isNull(), F.col("status"))
    effect = reviews.groupBy(*key).agg(
        F.max_by(live, F.when(live.isNotNull(), F.col("seq"))).alias("_status"), F.count(F.lit(1)).alias("reviews"),
        F.count_if(F.col("_undone")).alias("rolled_back_reviews"))
    return created.join(effect, key, "left").fillna(0, ["reviews", "rolled_back_reviews"]).withColumn(
        "status", F.coalesce("_status", F.lit("pending"))).drop("_status")


def consolidation_status(candidates: DataFrame) -> DataFrame:
    """Counts by status, by type and in total per session, in one pass over grouping sets."""
    from pyspark.sql.functions import col
    return candidates.groupingSets(
        [[col("session"), col("status")], [col("session"), col("candidate_type")], [col("session")]],
        "session", "status", "candidate_type").agg(
        F.count(F.lit(1)).alias("candidates"), F.sum("duplicates").alias("duplicates"), F.sum("reviews").alias("reviews"),
        F.sum("rolled_back_reviews").alias("rolled_back_reviews"), F.count_if((F.col("stale") == 1) | (F.col("status") == "stale")).alias("stale"))


def capture_coverage(log: DataFrame, required: list[str], now_us: int, max_stale_minutes: int = 30) -> DataFrame:
    """Per session and required type: events, last time and whether the lane is missing or stale."""
    wanted = log.select("session").distinct().withColumn("type", F.explode(F.array(*[F.lit(t) for t in required])))
    seen = log.filter(F.col("type").isin(*required)).groupBy("session", "type").agg(F.count(F.lit(1)).alias("events"), F.max("ts_us").alias("last_us"))
    state = (F.when(F.col("last_us").isNull(), "missing")
             .when(F.lit(now_us) - F.col("last_us") > max_stale_minutes * 60_000_000, "stale").otherwise("active"))
    return wanted.join(seen, ["session", "type"], "left").fillna(0, ["events"]).withColumn("state", state)


def session_overview(log: DataFrame, category: Column) -> DataFrame:
    """Counts per session and category with subtotals."""
    return log.withColumn("category", category).rollup("session", "category").agg(
        F.count(F.lit(1)).alias("events"), F.max("ts_us").alias("latest_us"))


def governance_withheld(events: DataFrame) -> DataFrame:
    """(session, seq) of rows withheld by review status or cancelled by a rollback that cites them.

    Events: session, seq, kind (rule / correction / rollback / other), review_status, target_seq.
    """
    rules = events.filter("kind = 'rule' AND lower(trim(review_status)) IN ('pending', 'rejected', 'deferred')").select("session", "seq")
    targets = events.filter("kind = 'rollback'").select("session", F.col("target_seq").alias("seq")).distinct()
    reversed_ = events.filter("kind IN ('rule', 'correction')").select("session", "seq").join(targets, ["session", "seq"], "left_semi")
    return rules.unionByName(reversed_).distinct()


def drop_withheld(contexts: DataFrame, withheld: DataFrame) -> DataFrame:
    return contexts.join(withheld, ["session", "seq"], "left_anti")


def interference(facts: DataFrame, new: DataFrame, salience_rows: DataFrame, floor: float) -> DataFrame:
    """New scalar properties that differ from the active fact's, for memories at or above the salience floor.

    Facts and new: session, entity_type, name, props map; salience: session, name, score.
    """
    key = ["session", "entity_type", "name"]
    old = facts.select(*key, F.explode("props").alias("prop", "old_value"))
    fresh = new.select(*key, "seq", F.explode("props").alias("prop", "new_value"))
    return (fresh.join(old, [*key, "prop"]).filter("new_value <> old_value")
            .join(salience_rows.filter(F.col("score") >= floor), ["session", "name"]))
