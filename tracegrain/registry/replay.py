"""Replay analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay as R
from ..ordered import slice_of
from .base import query

_NOW = 1706745600000000  # 2024-02-01
_SAL = f"""WITH r AS (SELECT *, CASE kind WHEN 'surfaced' THEN 1.05 WHEN 'confirmed' THEN 1.5 WHEN 'promoted' THEN 2.0 ELSE 0.2 END::DOUBLE AS m FROM @reinforcements),
 f AS (SELECT session, target, count(*) FILTER (WHERE kind = 'surfaced') AS surfaced, count(*) FILTER (WHERE kind = 'confirmed') AS confirmed, count(*) FILTER (WHERE kind = 'promoted') AS promoted,
   count(*) FILTER (WHERE kind = 'invalidated') AS invalidated, arg_max(ts_us, seq) AS last_us,
   list_reduce(list_prepend(1.0::DOUBLE, list(m ORDER BY seq)), lambda a, x: least(10.0, greatest(0.01, a * x))) AS factor FROM r GROUP BY session, target),
 s AS (SELECT *, least(10.0, greatest(0.01, factor * pow(0.5, greatest(0, {_NOW} - last_us) / 86400000000.0 / 30.0))) AS score FROM f)"""


@query("salience_ledger", _SAL + " SELECT session, target, surfaced, confirmed, promoted, invalidated, last_us, round(factor, 6) AS factor, round(score, 6) AS score FROM s")
def salience_ledger(src):
    out = R.salience(src.reinforcements, _NOW)
    return out.select("session", "target", "surfaced", "confirmed", "promoted", "invalidated", "last_us",
                      F.round("factor", 6).alias("factor"), F.round("score", 6).alias("score"))


@query("top_salient_memories", _SAL + """ SELECT session, target, score, rank FROM (SELECT session, target, round(score, 6) AS score,
 row_number() OVER (PARTITION BY session ORDER BY round(score, 6) DESC, target) AS rank FROM s) WHERE rank <= 10""")
def top_salient_memories(src):
    from ..ordered import top_k
    scored = R.salience(src.reinforcements, _NOW).select("session", "target", F.round("score", 6).alias("score"))
    return top_k(scored, ["session"], [F.desc("score"), F.col("target")], 10)


@query("surprise_weight", """WITH p AS (SELECT session, seq, kind, abs(CASE target % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END - (target % 11) / 10.0) AS pe FROM @reinforcements),
 b AS (SELECT *, CASE kind WHEN 'surfaced' THEN 1.05 WHEN 'confirmed' THEN 1.5 WHEN 'promoted' THEN 2.0 ELSE 0.2 END::DOUBLE AS base FROM p)
 SELECT session, seq, round(pe, 6)::DOUBLE AS prediction_error, round(least(10.0, greatest(0.01, base + (base - 1.0) * (2.0 * pe - 1.0))), 6)::DOUBLE AS weight FROM b""")
def surprise_weight(src):
    outcome = F.element_at(F.array(F.lit("success"), F.lit("partial"), F.lit("failure")), (F.col("target") % 3 + 1).cast("int"))
    rows = src.reinforcements.withColumn("pe", R.prediction_error(outcome, (F.col("target") % 11) / 10.0))
    return rows.select("session", "seq", F.round("pe", 6).alias("prediction_error"), F.round(R.surprise_weight(F.col("kind"), F.col("pe")), 6).alias("weight"))


_OUTCOMES = """WITH t AS (SELECT profile, seq, outcome, unnest([target_a, target_b]) AS target, CASE WHEN outcome IN ('helpful', 'used') THEN 1 WHEN outcome IN ('failed', 'rejected') THEN 0 END AS pos FROM @feedback),
 o AS (SELECT profile, target, count(*) FILTER (WHERE pos = 1) AS positive, count(*) FILTER (WHERE pos = 0) AS negative, array_to_string(list_sort(list(DISTINCT outcome)), ',') AS outcomes, max(seq) AS latest_seq
  FROM t WHERE pos IS NOT NULL GROUP BY ALL),
 m AS (SELECT *, greatest(0.1, 1.0 + least(0.2, positive * 0.06) - least(0.18, negative * 0.06))::DOUBLE AS multiplier, negative >= 2 AND negative >= positive AS suppress FROM o)"""


def _outcomes(src):
    return R.purpose_outcomes(src.feedback.withColumn("targets", F.array("target_a", "target_b")))


@query("purpose_outcome_aggregate", _OUTCOMES + " SELECT profile, target, positive, negative, outcomes, latest_seq, round(multiplier, 6) AS multiplier, suppress FROM m")
def purpose_outcome_aggregate(src):
    return _outcomes(src).withColumn("multiplier", F.round("multiplier", 6))


@query("purpose_outcome_learning", _OUTCOMES + """ SELECT l.event_id, round((cents / 100.0)::DOUBLE * coalesce(multiplier, 1.0), 6) AS score, coalesce(suppress, FALSE) AS suppress FROM @log l
 LEFT JOIN m ON m.profile = 'pf' || (l.k % 6) AND m.target = 'g' || (l.cents % 15)""")
def purpose_outcome_learning(src):
    contexts = src.log.select("event_id", F.expr("'pf' || (k % 6)").alias("profile"), F.expr("'g' || (cents % 15)").alias("target"), (F.col("cents") / 100.0).alias("score"))
    return R.apply_outcomes(contexts, _outcomes(src)).select("event_id", F.round("score", 6).alias("score"), "suppress")


@query("purpose_lanes", """WITH c AS (SELECT profile, count(*) AS checkouts, count(*) FILTER (WHERE evidence_status = 'pass') AS evidence_pass, count(*) FILTER (WHERE evidence_status = 'fail') AS evidence_fail,
   sum(warnings)::BIGINT AS warnings, max(seq) AS latest_seq FROM @checkouts GROUP BY profile),
 r AS (SELECT profile, string_agg(suppress_reason || '=' || n, ',' ORDER BY suppress_reason || '=' || n) AS suppressed FROM (SELECT profile, suppress_reason, count(*) AS n FROM @checkouts WHERE suppress_reason IS NOT NULL GROUP BY ALL) GROUP BY profile),
 v AS (SELECT profile, count(*) FILTER (WHERE outcome IN ('helpful', 'used')) AS positive, count(*) FILTER (WHERE outcome IN ('failed', 'rejected')) AS negative FROM @feedback GROUP BY profile)
 SELECT coalesce(c.profile, v.profile) AS profile, coalesce(checkouts, 0) AS checkouts, coalesce(evidence_pass, 0) AS evidence_pass, coalesce(evidence_fail, 0) AS evidence_fail, coalesce(warnings, 0) AS warnings,
  latest_seq, suppressed, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative FROM c LEFT JOIN r ON r.profile = c.profile FULL JOIN v ON v.profile = c.profile""")
def purpose_lanes(src):
    return R.purpose_lanes(src.checkouts, src.feedback)


@query("packet_reinforcements", """SELECT hash AS source_event_hash, count(*) AS reinforcements, greatest(0, max((k % 10) / 10.0))::DOUBLE AS importance FROM @log WHERE type = 'click' GROUP BY hash""")
def packet_reinforcements(src):
    rows = src.log.filter("type = 'click'").select(F.col("hash").alias("source_event_hash"), ((F.col("k") % 10) / 10.0).alias("importance"))
    return R.packet_reinforcements(rows)


@query("skill_analytics", """WITH v AS (SELECT skill_id, version, arg_max(status, seq) AS status FROM @skill_versions GROUP BY ALL),
 o AS (SELECT skill_id, version, count(*) FILTER (WHERE feedback IN ('used', 'passed') OR success_score >= 0.8) AS successes,
  count(*) FILTER (WHERE feedback = 'failed' OR success_score < 0.5) AS failures, round(avg(success_score::DOUBLE), 4) AS mean_score FROM @skill_outcomes GROUP BY ALL),
 j AS (SELECT coalesce(v.skill_id, o.skill_id) AS skill_id, coalesce(v.version, o.version) AS version, coalesce(status, 'unknown') AS status, coalesce(successes, 0) AS successes,
  coalesce(failures, 0) AS failures, mean_score FROM v FULL JOIN o ON o.skill_id = v.skill_id AND o.version = v.version)
 SELECT *, status IN ('validated', 'revised', 'outcome_recorded') AND successes > 0 AND failures = 0 AND (mean_score IS NULL OR mean_score >= 0.8) AS promote,
  CASE WHEN status IN ('contradicted', 'deprecated') THEN status WHEN failures > successes THEN 'failed_outcomes' WHEN mean_score < 0.5 THEN 'low_success_score' END AS rollback_reason FROM j""")
def skill_analytics(src):
    return R.skill_analytics(src.skill_versions, src.skill_outcomes.withColumn("success_score", F.col("success_score").cast("double")))


@query("metacognition_summary", """SELECT session, count(*) FILTER (WHERE kind = 'unknown') AS unknowns, count(*) FILTER (WHERE kind = 'unknown' AND status = 'open') AS open_unknowns,
 count(*) FILTER (WHERE kind = 'assessment') AS assessments, count(*) FILTER (WHERE kind = 'cluster') AS clusters, count(*) FILTER (WHERE kind = 'cluster' AND status = 'unresolved') AS unresolved_clusters,
 count(*) FILTER (WHERE kind = 'reverify') AS reverify_requests, count(*) FILTER (WHERE kind = 'reverify' AND status = 'open') AS reverify_needed FROM @meta_events GROUP BY session""")
def metacognition_summary(src):
    return R.metacognition_summary(src.meta_events)


@query("reverification_needs", """SELECT session, seq, CASE WHEN kind = 'unknown' THEN 'known_unknown_open' WHEN kind = 'reverify' THEN 'reverify_request_open' WHEN kind = 'cluster' THEN 'conflict_unresolved'
 ELSE 'confidence_requires_reverify' END AS reason FROM @meta_events WHERE (kind IN ('unknown', 'reverify') AND status = 'open') OR (kind = 'cluster' AND status = 'unresolved')
 OR (kind = 'assessment' AND (confidence < 0.6 OR conflicts > 0))""")
def reverification_needs(src):
    return R.reverification_needs(src.meta_events).select("session", "seq", "reason")


@query("known_unknowns", "SELECT session, seq, claim_key, status FROM @meta_events WHERE kind = 'unknown' AND status = 'open'")
def known_unknowns(src):
    return R.known_unknowns(src.meta_events).select("session", "seq", "claim_key", "status")


@query("conflict_clusters", "SELECT session, seq, claim_key FROM @meta_events WHERE kind = 'cluster' AND status = 'unresolved'")
def conflict_clusters(src):
    return R.conflict_clusters(src.meta_events).select("session", "seq", "claim_key")


@query("confidence_trajectory", """SELECT session, claim_key, seq, confidence::DOUBLE AS confidence, round(confidence - lag(confidence) OVER (PARTITION BY session, claim_key ORDER BY seq), 6)::DOUBLE AS change
 FROM @meta_events WHERE kind = 'assessment'""")
def confidence_trajectory(src):
    rows = src.meta_events.withColumn("confidence", F.col("confidence").cast("double")).withColumn("_slice", slice_of("seq"))
    return R.confidence_trajectory(rows).select("session", "claim_key", "seq", "confidence", "change")


@query("reverify_plan", """WITH busy AS (SELECT DISTINCT session, claim_key FROM @meta_events WHERE kind = 'reverify' AND status = 'open'),
 g AS (SELECT *, CASE kind WHEN 'cluster' THEN 0 ELSE 1 END AS o FROM @meta_events WHERE ((kind = 'cluster' AND status = 'unresolved') OR (kind = 'unknown' AND status = 'open'))
  AND (session, claim_key) NOT IN (SELECT (session, claim_key) FROM busy)),
 r AS (SELECT *, row_number() OVER (PARTITION BY session, claim_key ORDER BY o, seq) AS rn FROM g)
 SELECT session, claim_key, CASE o WHEN 0 THEN 'high' ELSE 'normal' END AS priority, seq AS source_seq, hash AS source_hash FROM r WHERE rn = 1""")
def reverify_plan(src):
    return R.plan_reverify(src.meta_events)


@query("claim_confidence", """WITH c AS (SELECT item_id AS claim_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: len(w) > 1))) AS w FROM benchmark),
 e AS (SELECT conv_id * 1000 + turn AS evidence_id, role = 'assistant' AS against, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: len(w) > 1))) AS w FROM conversations),
 h AS (SELECT DISTINCT claim_id, evidence_id, against FROM c JOIN e USING (w)),
 r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY evidence_id) AS rn FROM h),
 t AS (SELECT claim_id, count(*) FILTER (WHERE NOT against) AS support, count(*) FILTER (WHERE against) AS conflict FROM r WHERE rn <= 50 GROUP BY claim_id)
 SELECT b.item_id AS claim_id, coalesce(support, 0) AS support, coalesce(conflict, 0) AS conflict, CASE WHEN support + conflict > 0 THEN round(support / (support + conflict), 4) ELSE 0.0 END AS confidence
 FROM benchmark b LEFT JOIN t ON t.claim_id = b.item_id""")
def claim_confidence(src):
    evidence = src.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("evidence_id"), "text", "role").withColumn("rank", F.lit(0))
    return R.claim_confidence(src.benchmark.select(F.col("item_id").alias("claim_id"), "text"), evidence, F.col("role") == "assistant", limit=50)


_HAND = """SELECT session, seq, ts_us, actor, CASE WHEN type = 'signup' THEN 'goal.created' WHEN type IN ('view', 'click') THEN 'task.proposed' WHEN type = 'purchase' THEN 'task.completed' ELSE type END AS type,
 CASE WHEN k % 9 = 0 THEN NULL ELSE 't' || (k % 25) END AS task_id FROM @log"""


@query("handoff_summary", f"""WITH h AS ({_HAND}), t AS (SELECT * FROM h WHERE type LIKE 'task.%' AND task_id IS NOT NULL), d AS (SELECT DISTINCT session, task_id FROM t WHERE type = 'task.completed')
 SELECT h.session, count(*) AS events, count(*) FILTER (WHERE type LIKE 'goal.%') AS goals, arg_max(actor, seq) AS last_actor, arg_max(ts_us, seq) AS last_ts_us,
  (SELECT count(*) FROM t WHERE t.session = h.session AND (t.session, t.task_id) NOT IN (SELECT (session, task_id) FROM d)) AS open_tasks FROM h GROUP BY h.session""")
def handoff_summary(src):
    return R.handoff_summary(src.sql(_HAND))


@query("event_type_counts", "SELECT session, type, count(*) AS events FROM @log GROUP BY session, type")
def event_type_counts(src):
    return src.log.groupBy("session", "type").agg(F.count(F.lit(1)).alias("events"))


_CAND = """WITH c0 AS (SELECT session, candidate_id, min(seq) AS created_seq, arg_min(candidate_type, seq) AS candidate_type, arg_min(stale, seq) AS stale, count(*) - 1 AS duplicates FROM @consolidation_events WHERE kind = 'created' GROUP BY ALL),
 un AS (SELECT DISTINCT session, target_seq FROM @consolidation_events WHERE kind = 'rolled_back'),
 rv AS (SELECT e.session, e.candidate_id, e.seq, e.status, un.target_seq IS NOT NULL AS undone FROM @consolidation_events e JOIN c0 ON c0.session = e.session AND c0.candidate_id = e.candidate_id AND e.seq > c0.created_seq
  LEFT JOIN un ON un.session = e.session AND un.target_seq = e.seq WHERE e.kind = 'reviewed'),
 ra AS (SELECT session, candidate_id, arg_max(status, seq) FILTER (WHERE NOT undone) AS st, count(*) AS reviews, count(*) FILTER (WHERE undone) AS rolled FROM rv GROUP BY ALL),
 cand AS (SELECT c0.*, coalesce(ra.st, 'pending') AS status, coalesce(reviews, 0) AS reviews, coalesce(rolled, 0) AS rolled_back_reviews FROM c0 LEFT JOIN ra ON ra.session = c0.session AND ra.candidate_id = c0.candidate_id)"""


@query("consolidation_candidates", _CAND + " SELECT session, candidate_id, created_seq, candidate_type, stale, duplicates, status, reviews, rolled_back_reviews FROM cand")
def consolidation_candidates(src):
    return R.consolidation_candidates(src.consolidation_events)


@query("consolidation_status", _CAND + """ SELECT session, status, candidate_type, count(*) AS candidates, sum(duplicates)::BIGINT AS duplicates, sum(reviews)::BIGINT AS reviews, sum(rolled_back_reviews)::BIGINT AS rolled_back_reviews,
 count(*) FILTER (WHERE stale = 1 OR status = 'stale') AS stale FROM cand GROUP BY GROUPING SETS ((session, status), (session, candidate_type), (session))""")
def consolidation_status(src):
    return R.consolidation_status(R.consolidation_candidates(src.consolidation_events))


@query("capture_coverage", """WITH s AS (SELECT DISTINCT session FROM @log), w AS (SELECT session, unnest(['view', 'click', 'purchase', 'compaction']) AS type FROM s),
 e AS (SELECT session, type, count(*) AS n, max(ts_us) AS last_us FROM @log GROUP BY ALL)
 SELECT w.session, w.type, coalesce(n, 0) AS events, last_us, CASE WHEN last_us IS NULL THEN 'missing' WHEN 1706572800000000 - last_us > 1800000000 THEN 'stale' ELSE 'active' END AS state
 FROM w LEFT JOIN e ON e.session = w.session AND e.type = w.type""")
def capture_coverage(src):
    return R.capture_coverage(src.log, ["view", "click", "purchase", "compaction"], 1706572800000000)


@query("session_overview", """SELECT session, CASE WHEN type = 'signup' THEN 'bootstrap' ELSE 'lifecycle' END AS category, count(*) AS events, max(ts_us) AS latest_us FROM @log
 GROUP BY ROLLUP (session, CASE WHEN type = 'signup' THEN 'bootstrap' ELSE 'lifecycle' END)""")
def session_overview(src):
    return R.session_overview(src.log, F.when(F.col("type") == "signup", "bootstrap").otherwise("lifecycle"))


_GOV = """SELECT session, seq, CASE type WHEN 'signup' THEN 'rule' WHEN 'click' THEN 'correction' WHEN 'error' THEN 'rollback' ELSE 'other' END AS kind,
 CASE cents % 3 WHEN 0 THEN 'pending' WHEN 1 THEN ' Rejected ' ELSE 'active' END AS review_status, seq - 1 AS target_seq FROM @log"""


@query("governance_filter", f"""WITH g AS ({_GOV}), w AS (SELECT session, seq FROM g WHERE kind = 'rule' AND lower(trim(review_status)) IN ('pending', 'rejected', 'deferred')
 UNION SELECT g.session, g.seq FROM g JOIN g r ON r.session = g.session AND r.target_seq = g.seq AND r.kind = 'rollback' WHERE g.kind IN ('rule', 'correction'))
 SELECT l.session, l.seq, l.type FROM @log l WHERE (l.session, l.seq) NOT IN (SELECT (session, seq) FROM w)""")
def governance_filter(src):
    return R.drop_withheld(src.log, R.governance_withheld(src.sql(_GOV))).select("session", "seq", "type")


@query("interference_detection", _SAL + """, fact AS (SELECT session, 'm' || (k % 20) AS name, arg_max('c' || (cents % 4), seq) AS color, arg_max('s' || (cents % 3), seq) AS size FROM @log WHERE type = 'signup' GROUP BY ALL),
 new AS (SELECT session, seq, 'm' || (k % 20) AS name, 'c' || (cents % 4) AS color, 's' || (cents % 3) AS size FROM @log WHERE type = 'view'),
 sal AS (SELECT session, 'm' || target AS name, score FROM s WHERE score >= 0.5)
 SELECT n.session, n.seq, n.name, 'color' AS prop, f.color AS old_value, n.color AS new_value FROM new n JOIN fact f ON f.session = n.session AND f.name = n.name JOIN sal ON sal.session = n.session AND sal.name = n.name WHERE f.color <> n.color
 UNION ALL SELECT n.session, n.seq, n.name, 'size', f.size, n.size FROM new n JOIN fact f ON f.session = n.session AND f.name = n.name JOIN sal ON sal.session = n.session AND sal.name = n.name WHERE f.size <> n.size""")
def interference_detection(src):
    rows = src.log.select("session", "seq", "type", F.lit("memory").alias("entity_type"), F.expr("'m' || (k % 20)").alias("name"),
                          F.create_map(F.lit("color"), F.expr("'c' || (cents % 4)"), F.lit("size"), F.expr("'s' || (cents % 3)")).alias("props"))
    pack = F.struct(F.col("props")["color"].alias("color"), F.col("props")["size"].alias("size"))
    facts = rows.filter("type = 'signup'").groupBy("session", "entity_type", "name").agg(F.max_by(pack, "seq").alias("p")).select(
        "session", "entity_type", "name", F.create_map(F.lit("color"), F.col("p.color"), F.lit("size"), F.col("p.size")).alias("props"))
    scores = R.salience(src.reinforcements, _NOW).select("session", F.concat(F.lit("m"), F.col("target").cast("string")).alias("name"), "score")
    return R.interference(facts, rows.filter("type = 'view'"), scores, 0.5).select("session", "seq", "name", "prop", "old_value", "new_value")
