"""Coordination and fleet queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coordination as C
from ..operators import fleet as FL
from .base import query

_EFF = """eff AS (SELECT f.*, p.finding_id IS NOT NULL AS promoted, r.st AS review_status, CASE WHEN p.finding_id IS NOT NULL THEN 'accepted'
   WHEN coalesce(r.st, f.status) IN ('accepted', 'rejected', 'deferred', 'conflicted') THEN coalesce(r.st, f.status) ELSE 'pending' END AS eff_status
  FROM @findings f LEFT JOIN (SELECT mission, finding_id, arg_max(status, seq) AS st FROM @reviews GROUP BY ALL) r ON r.mission = f.mission AND r.finding_id = f.finding_id
  LEFT JOIN (SELECT DISTINCT mission, finding_id FROM @promotions) p ON p.mission = f.mission AND p.finding_id = f.finding_id),
 cc AS (SELECT mission, claim_key, count(DISTINCT claim_value) AS vals, count(*) AS findings, min(seq) AS first_seq FROM @findings GROUP BY ALL HAVING count(DISTINCT claim_value) > 1),
 dup AS (SELECT mission, finding_id FROM (SELECT *, row_number() OVER (PARTITION BY mission, claim_key, claim_value ORDER BY seq, finding_id) AS rn FROM @findings) WHERE rn > 1)"""


@query("exact_claim_conflicts", f"WITH {_EFF} SELECT mission, claim_key, vals AS values, findings, first_seq FROM cc")
def exact_claim_conflicts(src):
    return C.claim_conflicts(src.findings)


@query("claim_conflict_members", f"WITH {_EFF} SELECT f.mission, f.claim_key, f.finding_id, f.claim_value FROM @findings f WHERE (mission, claim_key) IN (SELECT (mission, claim_key) FROM cc)")
def claim_conflict_members(src):
    return C.claim_conflict_members(src.findings).select("mission", "claim_key", "finding_id", "claim_value")


@query("source_state_conflicts", """SELECT mission, source_ref, count(DISTINCT source_sha) AS snapshots, count(*) AS findings FROM @findings GROUP BY ALL HAVING count(DISTINCT source_sha) > 1""")
def source_state_conflicts(src):
    return C.source_conflicts(src.findings)


@query("duplicate_findings", f"WITH {_EFF} SELECT mission, finding_id FROM dup")
def duplicate_findings(src):
    return C.duplicate_findings(src.findings).select("mission", "finding_id")


@query("worker_performance_ledger", f"""WITH {_EFF}, j AS (SELECT e.*, cc.claim_key IS NOT NULL AS contested, dup.finding_id IS NOT NULL AS isdup FROM eff e
  LEFT JOIN cc ON cc.mission = e.mission AND cc.claim_key = e.claim_key LEFT JOIN dup ON dup.mission = e.mission AND dup.finding_id = e.finding_id)
 SELECT mission, worker, count(*) AS total, count(*) FILTER (WHERE eff_status = 'accepted') AS accepted, count(*) FILTER (WHERE eff_status = 'rejected') AS rejected,
  count(*) FILTER (WHERE eff_status = 'deferred') AS deferred, count(*) FILTER (WHERE eff_status = 'pending') AS pending, count(*) FILTER (WHERE promoted) AS promoted,
  count(*) FILTER (WHERE contested OR eff_status = 'conflicted') AS conflicted, count(*) FILTER (WHERE has_evidence = 0) AS missing_evidence, count(*) FILTER (WHERE isdup) AS duplicates,
  count(*) FILTER (WHERE test_backed = 1) AS test_backed, count(*) FILTER (WHERE stale = 1) AS stale, round(count(*) FILTER (WHERE eff_status = 'accepted') / count(*), 6) AS acceptance_rate,
  round(count(*) FILTER (WHERE has_evidence = 0) / count(*), 6) AS missing_evidence_rate, round(count(*) FILTER (WHERE isdup) / count(*), 6) AS duplicate_rate,
  round(count(*) FILTER (WHERE test_backed = 1) / count(*), 6) AS test_backed_rate, round(count(*) FILTER (WHERE stale = 1) / count(*), 6) AS stale_rate FROM j GROUP BY mission, worker""")
def worker_performance_ledger(src):
    return C.worker_ledger(src.findings, src.reviews, src.promotions)


@query("semantic_contradiction_pairs", """WITH s AS (SELECT mission, finding_id, summary, claim_key, claim_value, split_part(summary, ' build ', 2) AS verdict,
   list_sort(list_distinct(list_filter(regexp_extract_all(lower(summary || ' ' || claim_key || ' ' || claim_value), '[a-z0-9]+'), lambda x: x NOT IN ('passed', 'failed', 'enabled')))) AS subj FROM @statements),
 g AS (SELECT mission, subj, verdict, count(*) AS n, min(finding_id) AS example FROM s GROUP BY ALL)
 SELECT a.mission, 'failed/passed' AS reason, array_to_string(list_sort(list_intersect(a.subj, b.subj)), ' ') AS shared, a.example AS left_example, b.example AS right_example,
  a.n AS left_findings, b.n AS right_findings, a.n * b.n AS pairs FROM g a JOIN g b ON a.mission = b.mission AND a.verdict = 'passed' AND b.verdict = 'failed'
 WHERE len(list_intersect(a.subj, b.subj)) >= 2""")
def semantic_contradiction_pairs(src):
    return C.contradiction_pairs(src.statements, F.col("summary"))


@query("conflicts_with_detector", f"""WITH {_EFF}, sc AS (SELECT mission, source_ref, count(*) AS findings FROM @findings GROUP BY ALL HAVING count(DISTINCT source_sha) > 1)
 SELECT mission, 'exact_claim' AS conflict_type, claim_key AS conflict_key, findings FROM cc UNION ALL SELECT mission, 'source_state', source_ref, findings FROM sc
 UNION ALL SELECT mission, 'semantic', worker, count(*) FROM @findings WHERE stale = 1 GROUP BY mission, worker HAVING count(*) > 1""")
def conflicts_with_detector(src):
    stale_workers = lambda rows: (rows.filter("stale = 1").groupBy("mission", F.col("worker").alias("conflict_key"))
                                  .agg(F.count(F.lit(1)).alias("findings")).filter("findings > 1"))
    return C.all_conflicts(src.findings, stale_workers)


@query("mission_brief", f"""WITH {_EFF}, sc AS (SELECT mission FROM @findings GROUP BY mission, source_ref HAVING count(DISTINCT source_sha) > 1)
 SELECT e.mission, count(DISTINCT worker) AS workers, count(*) AS findings, count(*) FILTER (WHERE eff_status = 'accepted') AS accepted, count(*) FILTER (WHERE eff_status = 'rejected') AS rejected,
  count(*) FILTER (WHERE eff_status = 'deferred') AS deferred, count(*) FILTER (WHERE eff_status = 'pending') AS pending, count(*) FILTER (WHERE stale = 1) AS stale,
  (SELECT count(*) FROM cc WHERE cc.mission = e.mission) AS claim_conflicts, (SELECT count(*) FROM sc WHERE sc.mission = e.mission) AS source_conflicts FROM eff e GROUP BY e.mission""")
def mission_brief(src):
    return C.mission_brief(src.findings, src.reviews, src.promotions)


@query("accepted_state", f"""WITH {_EFF}, j AS (SELECT e.*, cc.claim_key IS NOT NULL AS contested FROM eff e LEFT JOIN cc ON cc.mission = e.mission AND cc.claim_key = e.claim_key)
 SELECT mission, finding_id, eff_status AS status, CASE WHEN stale = 1 THEN 'stale' WHEN eff_status IN ('rejected', 'deferred') THEN eff_status WHEN promoted THEN NULL
  WHEN contested THEN 'conflicted' WHEN eff_status = 'accepted' THEN 'not_promoted' ELSE 'pending' END AS exclude_reason,
  promoted AND stale = 0 AND eff_status = 'accepted' AS authoritative FROM j""")
def accepted_state(src):
    return C.resolve_state(src.findings, src.reviews, src.promotions).select("mission", "finding_id", "status", "exclude_reason", "authoritative")


@query("approval_packet", f"""WITH {_EFF}, j AS (SELECT e.*, cc.claim_key IS NOT NULL AS contested FROM eff e LEFT JOIN cc ON cc.mission = e.mission AND cc.claim_key = e.claim_key)
 SELECT mission, finding_id, worker, eff_status AS status, CASE WHEN contested THEN claim_key END AS conflict_key,
  array_to_string(list_filter([CASE WHEN eff_status = 'pending' THEN 'review' END, CASE WHEN contested THEN 'resolve_conflict' END, CASE WHEN stale = 1 THEN 'refresh_evidence' END,
   CASE WHEN has_evidence = 0 THEN 'add_evidence' END], lambda x: x IS NOT NULL), ',') AS next_actions FROM j
 WHERE eff_status <> 'accepted' AND (eff_status = 'pending' OR contested OR stale = 1)""")
def approval_packet(src):
    return C.approval_packet(src.findings, src.reviews, src.promotions)


@query("audit_report", """SELECT 'm' || (event_id % 40) AS mission, ts_us, session, seq, CASE WHEN type = 'signup' THEN 'coordinator' ELSE 'worker' END AS role, type,
  'log://' || session || '/events/' || seq || '#' || substr(hash, 1, 12) AS citation FROM @log""")
def audit_report(src):
    log = src.log.withColumn("mission", F.concat(F.lit("m"), (F.col("event_id") % 40).cast("string")))
    return C.audit_report(log.filter("type = 'signup'"), log.filter("type <> 'signup'"))


_PROOFS = "SELECT 'm' || (event_id % 40) AS mission, event_id AS proof_seq, 'art' || (k % 30) AS artifact_id, 'ho' || (cents % 30) AS handoff_id FROM @log WHERE type = 'purchase'"
_ARTS = "SELECT 'm' || (event_id % 40) AS mission, 'art' || (k % 30) AS artifact_id, min(event_id) AS artifact_seq FROM @log WHERE type = 'click' GROUP BY 'm' || (event_id % 40), 'art' || (k % 30)"
_HANDS = "SELECT 'm' || (event_id % 40) AS mission, 'ho' || (k % 30) AS handoff_id, min(event_id) AS handoff_seq FROM @log WHERE type = 'view' GROUP BY 'm' || (event_id % 40), 'ho' || (k % 30)"


@query("proof_trace", f"""SELECT p.mission, p.proof_seq, p.artifact_id, p.handoff_id, a.artifact_seq, h.handoff_seq, a.artifact_seq IS NOT NULL AND h.handoff_seq IS NOT NULL AS complete
 FROM ({_PROOFS}) p LEFT JOIN ({_ARTS}) a ON a.mission = p.mission AND a.artifact_id = p.artifact_id LEFT JOIN ({_HANDS}) h ON h.mission = p.mission AND h.handoff_id = p.handoff_id""")
def proof_trace(src):
    return C.proof_trace(src.sql(_PROOFS), src.sql(_ARTS), src.sql(_HANDS)).select(
        "mission", "proof_seq", "artifact_id", "handoff_id", "artifact_seq", "handoff_seq", "complete")


_FLEET = """firsts AS (SELECT fleet, pid, min(seq) AS first_seq, arg_min(memory_kind, seq) AS memory_kind, arg_min(conflict_key, seq) AS conflict_key, arg_min(conflict_value, seq) AS conflict_value,
   arg_min(initial, seq) AS initial FROM @fleet_events WHERE kind = 'promoted' GROUP BY ALL),
 own AS (SELECT e.*, row_number() OVER (PARTITION BY e.fleet, e.pid ORDER BY e.seq DESC) AS rn FROM @fleet_events e JOIN firsts f ON f.fleet = e.fleet AND f.pid = e.pid AND e.seq > f.first_seq
   WHERE kind IN ('superseded', 'rolled_back') OR (kind = 'reviewed' AND decision IN ('accepted', 'rejected', 'deferred'))),
 st AS (SELECT f.*, o.kind, o.other, CASE WHEN o.kind IS NULL THEN CASE WHEN f.initial = 'active' THEN 'active' ELSE 'pending' END
   WHEN o.kind = 'reviewed' THEN CASE decision WHEN 'accepted' THEN 'active' ELSE decision END
   WHEN o.kind = 'rolled_back' THEN 'rolled_back'
   WHEN EXISTS (SELECT 1 FROM @fleet_events r JOIN firsts w ON w.fleet = r.fleet AND w.pid = r.pid AND r.seq > w.first_seq WHERE r.kind = 'rolled_back' AND r.fleet = o.fleet AND r.pid = o.other AND r.seq > o.seq) THEN 'active'
   ELSE 'superseded' END AS status FROM firsts f LEFT JOIN own o ON o.fleet = f.fleet AND o.pid = f.pid AND o.rn = 1)"""


@query("fleet_state", f"WITH {_FLEET} SELECT fleet, pid, memory_kind, conflict_key, conflict_value, first_seq, status, CASE WHEN kind = 'superseded' THEN other END AS superseded_by FROM st")
def fleet_state(src):
    return FL.fleet_state(src.fleet_events)


@query("fleet_active_skills", f"WITH {_FLEET} SELECT fleet, pid FROM st WHERE status = 'active' AND memory_kind = 'skill'")
def fleet_active_skills(src):
    return FL.active_skills(FL.fleet_state(src.fleet_events)).select("fleet", "pid")


@query("fleet_brief", f"""WITH {_FLEET} SELECT fleet, count(*) AS memories, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'pending') AS pending,
 count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'deferred') AS deferred, count(*) FILTER (WHERE status = 'superseded') AS superseded,
 count(*) FILTER (WHERE status = 'rolled_back') AS rolled_back, count(*) FILTER (WHERE status = 'active' AND memory_kind = 'skill') AS active_skills FROM st GROUP BY fleet""")
def fleet_brief(src):
    return FL.fleet_brief(FL.fleet_state(src.fleet_events))


@query("fleet_contested_actives", f"""WITH {_FLEET}, live AS (SELECT * FROM st WHERE status = 'active')
 SELECT a.fleet, a.pid, a.conflict_key, a.conflict_value, count(DISTINCT b.conflict_value) + 1 AS values, count(*) AS opponents FROM live a
 JOIN live b ON a.fleet = b.fleet AND a.conflict_key = b.conflict_key AND a.conflict_value <> b.conflict_value GROUP BY ALL""")
def fleet_contested_actives(src):
    return FL.contested_actives(FL.fleet_state(src.fleet_events))


_PROPOSALS = """SELECT session, seq, CASE k % 4 WHEN 0 THEN 'untrusted' WHEN 1 THEN 'member' WHEN 2 THEN 'trusted' ELSE 'steward' END AS trust_tier,
 CASE cents % 3 WHEN 0 THEN 'session' WHEN 1 THEN 'fleet' ELSE 'global' END AS scope FROM @log"""


@query("fleet_visibility", f"""SELECT session, seq, trust_tier, scope FROM ({_PROPOSALS}) WHERE trust_tier IN ('trusted', 'steward') OR scope = 'session' OR (trust_tier = 'member' AND scope = 'fleet')""")
def fleet_visibility(src):
    return FL.visible_scopes(src.sql(_PROPOSALS))
