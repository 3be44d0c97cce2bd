"""Multi-worker coordination: findings, reviews, conflicts, briefs and packets.

Findings: mission, worker, finding_id, seq, claim_key, claim_value, source_ref, source_sha, stale, has_evidence,
test_backed, status.  Reviews and promotions: mission, finding_id, seq, status.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

_ID = ["mission", "finding_id"]
KNOWN_STATUS = ("accepted", "rejected", "deferred", "conflicted")
# words that contradict each other, and words that carry no subject (fixed values)
OPPOSITES = (("enabled", "disabled"), ("enable", "disable"), ("present", "missing"), ("passing", "failing"), ("passed", "failed"),
             ("available", "unavailable"), ("supported", "unsupported"), ("required", "optional"), ("true", "false"))
SUBJECT_STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with")


def effective_findings(findings: DataFrame, reviews: DataFrame, promotions: DataFrame) -> DataFrame:
    """Findings with effective status: promotion over latest review over the reported status."""
    latest = reviews.groupBy(*_ID).agg(F.max_by("status", "seq").alias("_review"))
    promoted = promotions.select(*_ID).distinct().withColumn("promoted", F.lit(True))
    status = F.coalesce("_review", "status", F.lit("pending"))
    return (
        findings.join(latest, _ID, "left").join(promoted, _ID, "left")
        .withColumn("promoted", F.coalesce("promoted", F.lit(False)))
        .withColumn("status", F.when(F.col("promoted"), "accepted").when(status.isin(*KNOWN_STATUS), status).otherwise("pending"))
        .drop("_review"))


def claim_conflicts(findings: DataFrame) -> DataFrame:
    """Claim keys of a mission that carry more than one value."""
    return (
        findings.filter("claim_key IS NOT NULL AND claim_value IS NOT NULL").groupBy("mission", "claim_key")
        .agg(F.count_distinct("claim_value").alias("values"), F.count(F.lit(1)).alias("findings"), F.min("seq").alias("first_seq"))
        .filter("values > 1"))


def claim_conflict_members(findings: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """The findings of each exact-claim conflict, one row each rather than a list per conflict."""
    keys = (conflicts if conflicts is not None else claim_conflicts(findings)).select("mission", "claim_key")
    return findings.filter("claim_value IS NOT NULL").join(keys, ["mission", "claim_key"], "left_semi")


def source_conflicts(findings: DataFrame) -> DataFrame:
    """Sources cited with more than one content hash inside a mission."""
    return (
        findings.filter("source_ref IS NOT NULL AND source_sha IS NOT NULL").groupBy("mission", "source_ref")
        .agg(F.count_distinct("source_sha").alias("snapshots"), F.count(F.lit(1)).alias("findings")).filter("snapshots > 1"))


def duplicate_findings(findings: DataFrame) -> DataFrame:
    """Second and later reports of the same (claim_key, claim_value) in a mission.

    The first report is a map-side combined minimum, so a claim repeated by everyone needs no ordered group.
    """
    key = ["mission", "claim_key", "claim_value"]
    known = findings.filter("claim_key IS NOT NULL AND claim_value IS NOT NULL")
    first = known.groupBy(*key).agg(F.min(F.struct("seq", "finding_id")).alias("_first"))
    return (known.join(first, key).filter(F.struct("seq", "finding_id") > F.col("_first")).drop("_first"))


def worker_ledger(findings: DataFrame, reviews: DataFrame, promotions: DataFrame) -> DataFrame:
    """Per mission and worker: totals by status, promotions, conflicts, gaps, duplicates and rates."""
    rows = effective_findings(findings, reviews, promotions)
    contested = claim_conflicts(findings).select("mission", "claim_key", F.lit(True).alias("_contested"))
    repeats = duplicate_findings(findings).select(*_ID).withColumn("_dup", F.lit(True))
    rows = rows.join(contested, ["mission", "claim_key"], "left").join(repeats, _ID, "left")
    has = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = rows.groupBy("mission", "worker").agg(
        F.count(F.lit(1)).alias("total"), *[has(F.col("status") == s).alias(s) for s in ("accepted", "rejected", "deferred", "pending")],
        has(F.col("promoted")).alias("promoted"), has((F.col("status") == "conflicted") | F.col("_contested")).alias("conflicted"),
        has(F.col("has_evidence") == 0).alias("missing_evidence"), has(F.col("_dup")).alias("duplicates"),
        has(F.col("test_backed") == 1).alias("test_backed"), has(F.col("stale") == 1).alias("stale"))
    rate = lambda c: F.round(F.col(c) / F.col("total"), 6)
    return out.withColumns({"acceptance_rate": rate("accepted"), "missing_evidence_rate": rate("missing_evidence"),
                            "duplicate_rate": rate("duplicates"), "test_backed_rate": rate("test_backed"), "stale_rate": rate("stale")})


def contradiction_pairs(findings: DataFrame, summary: Column) -> DataFrame:
    """Findings of one mission that share at least two subject words and use opposite words.

    Copies of a finding are folded into one signature with a count first, then signatures meet on
    (mission, two shared words, opposite pair) with the two words on different sides, so every joined row is
    a result; it is kept only at its first two shared words, which leaves each pair exactly once.
    """
    opposing = [w for pair in OPPOSITES for w in pair]
    spoken = F.array_distinct(words(summary))
    context = F.array_distinct(words(F.concat_ws(" ", summary, "claim_key", "claim_value")))
    subject = F.array_sort(F.array_except(context, F.array(*[F.lit(w) for w in (*opposing, *SUBJECT_STOP)])))
    sides = F.filter(F.array(*[
        F.struct(F.lit(i).alias("pair"), F.lit(pos).alias("word"), F.lit(side).alias("side"))
        for i, (a, b) in enumerate(OPPOSITES) for side, pos in (("positive", a), ("negative", b))]),
        lambda s: F.array_contains(spoken, s["word"]))
    sig = (findings.select("mission", "finding_id", subject.alias("subject"), F.array_sort(sides).alias("sides"))
           .filter(F.size("sides") > 0).groupBy("mission", "subject", "sides")
           .agg(F.count(F.lit(1)).alias("n"), F.min("finding_id").alias("example")))
    two = F.flatten(F.transform("subject", lambda a: F.transform(
        F.filter("subject", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = sig.withColumn("_s", F.explode("sides")).withColumn("_t", F.explode(two)).select(
        "mission", "subject", "sides", "n", "example", F.col("_s.pair").alias("pair"), F.col("_s.side").alias("side"), "_t")
    left = rows.filter("side = 'positive'").drop("side")
    right = rows.filter("side = 'negative'").select(
        "mission", "pair", "_t", F.col("subject").alias("subject2"), F.col("sides").alias("sides2"), F.col("n").alias("n2"),
        F.col("example").alias("example2"))
    shared = F.array_sort(F.array_intersect("subject", "subject2"))
    first = F.struct(F.get(shared, F.lit(0)).alias("a"), F.get(shared, F.lit(1)).alias("b"))
    names = F.array(*[F.lit(f"{b}/{a}") for a, b in OPPOSITES])
    return left.join(right, ["mission", "pair", "_t"]).filter(F.col("_t") == first).select(
        "mission", names[F.col("pair")].alias("reason"), F.array_join(shared, " ").alias("shared"),
        F.col("example").alias("left_example"), F.col("example2").alias("right_example"),
        F.col("n").alias("left_findings"), F.col("n2").alias("right_findings"), (F.col("n") * F.col("n2")).alias("pairs"))


Detector = Callable[[DataFrame], DataFrame]


def all_conflicts(findings: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Exact-claim and source conflicts, plus a caller's own detector (mission, conflict_key, findings)."""
    out = claim_conflicts(findings).select("mission", F.lit("exact_claim").alias("conflict_type"), F.col("claim_key").alias("conflict_key"), "findings")
    out = out.unionByName(source_conflicts(findings).select(
        "mission", F.lit("source_state").alias("conflict_type"), F.col("source_ref").alias("conflict_key"), "findings"))
    if detector is not None:
        out = out.unionByName(detector(findings).select("mission", F.lit("semantic").alias("conflict_type"), "conflict_key", "findings"))
    return out


def mission_brief(findings: DataFrame, reviews: DataFrame, promotions: DataFrame) -> DataFrame:
    """One row per mission: workers, findings by effective status, conflicts and stale findings."""
    rows = effective_findings(findings, reviews, promotions)
    base = rows.groupBy("mission").agg(
        F.count_distinct("worker").alias("workers"), F.count(F.lit(1)).alias("findings"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "rejected", "deferred", "pending")],
        F.count_if(F.col("stale") == 1).alias("stale"))
    conflicts = all_conflicts(findings).groupBy("mission").agg(
        F.count_if(F.col("conflict_type") == "exact_claim").alias("claim_conflicts"),
        F.count_if(F.col("conflict_type") == "source_state").alias("source_conflicts"))
    return base.join(conflicts, "mission", "left").fillna(0, ["claim_conflicts", "source_conflicts"])


def resolve_state(findings: DataFrame, reviews: DataFrame, promotions: DataFrame) -> DataFrame:
    """Each finding with `authoritative` or the reason it is not: only promoted, accepted, fresh findings count."""
    rows = effective_findings(findings, reviews, promotions)
    contested = claim_conflicts(findings).select("mission", "claim_key", F.lit(True).alias("_contested"))
    reviewed = reviews.groupBy(*_ID).agg(F.max_by("status", "seq").alias("review_status"))
    rows = rows.join(contested, ["mission", "claim_key"], "left").join(reviewed, _ID, "left")
    reason = (F.when(F.col("stale") == 1, "stale").when(F.col("status").isin("rejected", "deferred"), F.col("status"))
              .when(F.col("promoted") & (F.col("status") == "accepted"), F.lit(None))
              .when(F.coalesce("_contested", F.lit(False)), "conflicted").when(F.col("status") == "accepted", "not_promoted").otherwise("pending"))
    return rows.withColumn("exclude_reason", reason).withColumn("authoritative", F.col("exclude_reason").isNull()).drop("_contested")


def approval_packet(findings: DataFrame, reviews: DataFrame, promotions: DataFrame) -> DataFrame:
    """Findings waiting for approval: pending, contested or stale, and not accepted."""
    rows = effective_findings(findings, reviews, promotions)
    contested = claim_conflicts(findings).select("mission", "claim_key", F.lit(True).alias("_contested"))
    rows = rows.join(contested, ["mission", "claim_key"], "left").withColumn("contested", F.coalesce("_contested", F.lit(False)))
    actions = F.array_compact(F.array(
        F.when(F.col("status") == "pending", "review"), F.when(F.col("contested"), "resolve_conflict"),
        F.when(F.col("stale") == 1, "refresh_evidence"), F.when(F.col("has_evidence") == 0, "add_evidence")))
    return (rows.filter((F.col("status") != "accepted") & ((F.col("status") == "pending") | F.col("contested") | (F.col("stale") == 1)))
            .select("mission", "finding_id", "worker", "status", F.when(F.col("contested"), F.col("claim_key")).alias("conflict_key"),
                    F.array_join(actions, ",").alias("next_actions")))


def audit_report(parent: DataFrame, worker: DataFrame) -> DataFrame:
    """Parent and worker events as one ordered, cited stream (order by mission, ts_us, session, seq)."""
    cite = F.format_string("log://%s/events/%d#%s", F.col("session"), F.col("seq"), F.substring("hash", 1, 12))
    shape = lambda df, role: df.select("mission", "ts_us", "session", "seq", F.lit(role).alias("role"), "type", cite.alias("citation"))
    return shape(parent, "coordinator").unionByName(shape(worker, "worker"))


def proof_trace(proofs: DataFrame, artifacts: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Proof to artifact to handoff, by mission and ids; missing links stay null."""
    return (proofs.join(artifacts, ["mission", "artifact_id"], "left").join(handoffs, ["mission", "handoff_id"], "left")
            .withColumn("complete", F.col("artifact_seq").isNotNull() & F.col("handoff_seq").isNotNull()))
