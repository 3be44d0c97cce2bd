"""Extraction rules as data: which entities and edges each event type yields.

A text template is a list of alternatives divided by `|`, each a concatenation divided by `+`:
`key` reads the payload, `a.b` a nested key, `@`/`@field` the current list element, `$seq` the envelope,
`'text` is a literal, `#key` a list length, `~key` a number clamped to 0..1 and `^key` a positive integer.
The first alternative without a missing part wins.  All values below are fixed values of the data model.
"""

from __future__ import annotations

from dataclasses import dataclass, field

Template = str


@dataclass(frozen=True)
class Entity:
    name: Template
    type: Template
    summary: tuple[Template, ...] = ()
    props: dict[str, Template] = field(default_factory=dict)
    each: str | None = None


@dataclass(frozen=True)
class Edge:
    source: Template
    target: Template
    relation: Template
    each: str | None = None
    inferred: bool = False
    confidence: Template = "'1.0"
    method: Template | None = None
    valid_from: Template | None = None
    valid_to: Template | None = None
    evidence: dict[str, Template] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    event_type: str
    items: tuple[Entity | Edge, ...]
    require: tuple[str, ...] = ()


def _keep(*keys: str) -> dict[str, Template]:
    return {key: key for key in keys}


RETENTION = {
    **_keep("authority", "authority_scope", "coordination_status", "finding_status", "promoted", "stale", "status",
            "superseded_by", "expires_at", "last_reinforced_at"),
    "importance": "~importance",
    "reinforcement_count": "^reinforcement_count",
}
PURPOSE = {
    "purpose_profile": "purpose.profile|purpose", "purpose_role": "purpose.role", "purpose_task": "purpose.task",
    "purpose_risk": "purpose.risk", "purpose_expected_action": "purpose.expected_action",
    "purpose_evidence_policy": "purpose.evidence_policy", "purpose_retention_policy": "purpose.retention_policy",
    **_keep("authority", "authority_scope", "coordination_status", "finding_id", "mission_id", "outcome", "worker_id",
            "stale"),
}
TRANSFORM = _keep("transform_version", "transform_id")
ACTOR = Entity("$actor", "'actor")
TASK = {"task_id": "task_id", "taskId": "taskId"}

SESSION = "session_id|$thread|'default"
MISSION = "mission_id|parent_session_id|$thread|'default"
WORKER = "worker_id|worker_session_id|'worker"


def _name(*parts: Template) -> Template:
    """Concatenate templates that may themselves have alternatives (cross product, in order)."""
    out = [""]
    for part in parts:
        out = [f"{left}+{right}" if left else right for left in out for right in part.split("|")]
    return "|".join(out)


FINDING = "finding_id|" + _name(WORKER, "':finding:", "$seq")
SOURCE_REFS = {"source_event_count": "#source_events", "source_events": "source_events"}


def _actor_fact(event_type: str, name: Template, kind: str, relation: str, summary: tuple[str, ...],
                props: dict[str, Template], require: tuple[str, ...] = ()) -> Rule:
    return Rule(event_type, (Entity(name, f"'{kind}", summary, props), ACTOR, Edge("$actor", name, f"'{relation}")), require)


def _skill_items(status: str) -> tuple[Entity, Entity, Edge]:
    version = _name("'skill:", "skill_id", "':v", "version|'1")
    return (
        Entity("'skill:+skill_id", "'skill", ("name|skill_id",), {"skill_id": "skill_id"}),
        Entity(version, "'skill_version", ("summary",), {
            "skill_id": "skill_id", "version": "version|'1", "status": f"'{status}",
            **_keep("procedure", "applicability", "citations", "failure_modes", "rollback", "contradiction_reason",
                    "evidence")}),
        Edge("'skill:+skill_id", version, "'has_version"),
    )


def _skill_version(status: str) -> Rule:
    items = _skill_items(status)
    return Rule(f"skill.{status}", (*items, ACTOR, Edge("$actor", items[1].name, f"'{status}_skill")), ("skill_id",))


def _skill_child(event_type: str, status: str, word: str, kind: str, relation: str, summary, props) -> Rule:
    items = _skill_items(status)
    child = _name(items[1].name, f"':{word}:", "$seq")
    return Rule(event_type, (*items, Entity(child, f"'{kind}", summary, {"skill_id": "skill_id", "version": "version|'1", **props}),
                             Edge(items[1].name, child, f"'{relation}")), ("skill_id",))


def _session_fact(event_type: str, name: Template, kind: str, relation: str, summary, props, seen: str | None = None) -> Rule:
    items: list[Entity | Edge] = [Entity(SESSION, "'session"), Entity(name, f"'{kind}", summary, props),
                                  Edge(SESSION, name, f"'{relation}")]
    if seen:
        items += [Entity("task_id|taskId", "'task"), Edge("task_id|taskId", name, f"'{seen}")]
    return Rule(event_type, tuple(items))


WORKFLOW = (
    _actor_fact("goal.created", "title|'untitled", "goal", "created_goal", ("description",), RETENTION),
    Rule("task.proposed", (
        Entity("taskId|'task_+$seq", "'task", ("summary|title",), {**TASK, **RETENTION}), ACTOR,
        Edge("$actor", "taskId|'task_+$seq", "'proposed_task"),
        Entity("goalTitle", "'goal"), Edge("goalTitle", "taskId|'task_+$seq", "'has_task"))),
    Rule("task.claimed", (ACTOR, Edge("$actor", "taskId|'unknown", "'claimed_task"))),
    _actor_fact("task.completed", "taskId|task|'unknown", "task", "completed_task", ("summary",), {**TASK, **RETENTION}),
    _actor_fact("decision.made", "decision|'decision:+$seq", "decision", "made_decision",
                ("summary", "rationale", "alternatives_considered"), RETENTION),
    _actor_fact("context.policy", "project+':+source|project+':context|source|'context", "context_policy",
                "set_context_policy", ("status", "instructions"),
                {"source": "source|'context", "project": "project", **RETENTION}),
    *(_skill_version(s) for s in ("proposed", "validated", "revised", "deprecated", "contradicted")),
    _skill_child("skill.applied", "applied", "application", "skill_application", "applied_to_task", ("task", "summary"),
                 {"task": "task", "task_id": "task_id|taskId", "context": "context"}),
    _skill_child("skill.outcome_recorded", "outcome_recorded", "outcome", "skill_outcome", "recorded_outcome",
                 ("task", "feedback"), {**_keep("task", "feedback", "evidence"), "success_score": "~success_score"}),
    Rule("hook.checkpoint", (
        Entity(_name("$thread|session_id|'default", "':checkpoint:", "$seq"), "'hook_checkpoint", ("summary",),
               {"session_id": "$thread|session_id|'default", "source": "source|'hook", "reason": "reason|'checkpoint",
                "turn_count": "^turn_count|'0", "workspace": "workspace"}),
        Entity("$thread|session_id|'default", "'session"),
        Edge("$thread|session_id|'default", _name("$thread|session_id|'default", "':checkpoint:", "$seq"), "'recorded_checkpoint"),
        Entity("task_id|taskId", "'task"),
        Edge("task_id|taskId", _name("$thread|session_id|'default", "':checkpoint:", "$seq"), "'has_checkpoint"))),
    _actor_fact("issue.diagnosed", "issue|'issue:+$seq", "issue", "diagnosed_issue", ("root_cause", "evidence", "fix"),
                {"status": "'diagnosed"}),
    _actor_fact("verification.recorded", "command|'verification:+$seq", "verification", "recorded_verification",
                ("outcome|'unknown", "summary", "evidence"), {"outcome": "outcome|'unknown"}),
    _actor_fact("handoff.created", "title|'handoff:+$seq", "handoff", "created_handoff", ("summary", "next_steps", "risks"),
                {"status": "'created"}),
    Rule("user.preference_changed", (
        Entity("userId|$actor", "'user"),
        Entity(_name("userId|$actor", "':", "key|'preference"), "'preference", ("key+'=+value|'preference=+value|key|'preference",)),
        Edge("userId|$actor", _name("userId|$actor", "':", "key|'preference"), "'has_+key|'has_preference"))),
)


def _evidence_feedback(word: str, stamp: str) -> Rule:
    name = "fact_id|source_group|citation|'synthesis_evidence:+$seq"
    return Rule(f"memory.evidence.{word}", (
        Entity(name, "'synthesis_evidence", ("reason|query",),
               {**RETENTION, **_keep("outcome", "source_group", "citation"), stamp: "$timestamp"}), ACTOR,
        Edge("$actor", name, f"'{word}_synthesis_evidence"),
        Entity("source_group", "'source_group"), Edge(name, "source_group", "'cites_source_group")))


def _synthesis_outcome(word: str) -> Rule:
    name = ("'candidate_feedback:candidate:+answer_candidate.answer_key"
            "|'candidate_feedback:candidate:+$candidate_digest")
    return Rule(f"memory.synthesis.{word}", (
        Entity(name, "'synthesis_answer_candidate", ("answer_candidate.answer|reason",),
               {"outcome": f"outcome|'{word}", "last_outcome_at": "$timestamp", "rank": "answer_candidate.rank",
                "type": "answer_candidate.type", "answer_key": "answer_candidate.answer_key",
                "confidence": "~answer_candidate.confidence"}), ACTOR,
        Edge("$actor", name, f"'recorded_synthesis_+outcome|'recorded_synthesis_{word}"),
        Entity("@", "'source_group", each="support_source_ids"),
        Edge(name, "@", "'candidate_supported_by_source_group", each="support_source_ids")))


def _activity(event_type: str, activity: str) -> Rule:
    return Rule(event_type, (
        Entity(_name("$thread", "':memory:", f"activity|'{activity}", "':", "$seq"), "'memory_activity",
               (f"activity|'{activity}", "'memory activity from", "source|$actor"),
               {"activity": f"activity|'{activity}", "source": "source|$actor", "session_id": "$thread", "query": "query"}),))


_CORRECTION = {"reason": "reason", "authority_status": "authority_status|'non_authoritative", "target_seq": "^target.seq",
               "target_hash": "target.hash", "target_ref": "^target.seq+':+target.hash"}
_ARTIFACT = "artifact_id|'synthesis_artifact:+$seq"
_CANDIDATE = _name(_ARTIFACT, "':candidate:", "@answer_key|@digest")
_LEDGER = _name(_ARTIFACT, "':ledger:", "@fact_id|@source_group|@citation_digest")
_TYPED = "entity_type|'memory"
_NAMED = "entity_name|'memory:+$seq"
_FEEDBACK = {**PURPOSE, "feedback": "feedback|'unknown", "citation": "citation", "last_feedback_at": "$timestamp"}

MEMORY = (
    Rule("memory.reinforced", (
        Entity(_NAMED, _TYPED, ("summary",), {**RETENTION, **PURPOSE, "last_reinforced_at": "$timestamp",
                                              "reinforcement_count": "^reinforcement_count|'1"}), ACTOR,
        Edge("$actor", _NAMED, "'reinforced_memory"))),
    _evidence_feedback("reinforced", "last_reinforced_at"),
    _evidence_feedback("excluded", "last_excluded_at"),
    Rule("memory.synthesis.artifact.created", (
        Entity(_ARTIFACT, "'synthesis_artifact", ("query",),
               {"schema_version": "schema_version", "session_id": "session_id|$thread",
                "answer_candidate_count": "#answer_candidates|'0", "ledger_row_count": "#ledger_rows|'0",
                "support_source_group_count": "#support_packet.source_groups|'0"}), ACTOR,
        Edge("$actor", _ARTIFACT, "'created_synthesis_artifact"),
        Entity(_CANDIDATE, "'synthesis_answer_candidate", ("@answer",),
               {"artifact_id": _ARTIFACT, "rank": "@rank", "type": "@type", "answer_key": "@answer_key",
                "confidence": "~@confidence"}, each="answer_candidates"),
        Edge(_ARTIFACT, _CANDIDATE, "'artifact_has_answer_candidate", each="answer_candidates"),
        Entity("@support", "'source_group", each="answer_candidates/support_source_ids"),
        Edge(_CANDIDATE, "@support", "'candidate_supported_by_source_group", each="answer_candidates/support_source_ids"),
        Entity(_LEDGER, "'synthesis_ledger_row", ("@kind", "@value", "@label"),
               {"artifact_id": _ARTIFACT, "confidence": "~@confidence",
                **{k: f"@{k}" for k in ("fact_id", "source_group", "citation", "include_reason", "exclude_reason")}},
               each="ledger_rows"),
        Edge(_ARTIFACT, _LEDGER, "'artifact_has_ledger_row", each="ledger_rows"))),
    *(_synthesis_outcome(w) for w in ("used", "rejected", "corrected")),
    Rule("memory.feedback", (
        Entity(_name(_TYPED, "':", _NAMED, "':feedback:", "$seq"), "'memory_feedback",
               ("reason|" + _name("feedback|'unknown", "' feedback for ", _NAMED),), _FEEDBACK),
        Entity(_NAMED, _TYPED, (), _FEEDBACK), ACTOR,
        Edge("$actor", _name(_TYPED, "':", _NAMED, "':feedback:", "$seq"), "'recorded_memory_feedback"),
        Edge(_name(_TYPED, "':", _NAMED, "':feedback:", "$seq"), _NAMED, "'feedback_about_memory"))),
    _activity("memory.bootstrap.shown", "bootstrap_shown"),
    _activity("memory.checkout.completed", "checkout_completed"),
    _activity("memory.feedback.recorded", "feedback_recorded"),
    Rule("memory.reinforcement", ()),
    Rule("memory.reminder.suggested", (
        Entity("$thread+':memory-reminder:+$seq", "'memory_reminder",
               ("'Memory reminder suggested after", "trigger+':|'unknown:", "'call", "recommended_tool|'memory_checkout"),
               {"trigger": "trigger|'unknown", "recommended_tool": "recommended_tool|'memory_checkout",
                "session_id": "$thread", "query": "query"}),)),
    Rule("memory.corrected", (
        Entity("correction_id|'correction:+$seq", "'memory_correction", ("content",),
               {"correction_id": "correction_id|'correction:+$seq", **_CORRECTION}),)),
    Rule("memory.rolled_back", (
        Entity("reverts.review_candidate_id", "'consolidation_candidate", (),
               {"review_status": "reverts.to_status", "authority_status": "'non_authoritative"}),
        Entity("rollback_id|'rollback:+$seq", "'memory_rollback", ("reason",),
               {"rollback_id": "rollback_id|'rollback:+$seq", "reverts_event_type": "reverts.event_type", **_CORRECTION}))),
)


def _mission_fact(event_type: str, name: Template, kind: str, relation: str, summary, props) -> Rule:
    return Rule(event_type, (Entity(MISSION, "'mission"), Entity(name, f"'{kind}", summary, {"mission_id": MISSION, **props}),
                             Edge(MISSION, name, f"'{relation}")))


def _fleet(event_type: str, kind: str, summary: Template, props: dict[str, Template]) -> Rule:
    return Rule(event_type, (
        Entity("'fleet:+fleet_id", "'fleet", (), {"fleet_id": "fleet_id"}),
        Entity("promotion_id", "'fleet_promotion", (summary,),
               {**_keep("promotion_id", "fleet_id", "origin_actor", "origin_session", "gate_event", "source_events"),
                "kind": f"'{kind}", "review_status": "review_status|'pending", "visibility_scope": "visibility_scope|'fleet",
                "authority_status": "authority_status|'non_authoritative", "confidence": "~confidence",
                "keystone": "keystone|'false", **props}),
        Edge("'fleet:+fleet_id", "promotion_id", f"'fleet_promoted_{kind}")), ("promotion_id", "fleet_id"))


def _fleet_status(event_type: str, name: Template, status: Template) -> Rule:
    return Rule(event_type, (Entity(name, "'fleet_promotion", (),
                                    {"review_status": status, "authority_status": "'non_authoritative"}),))


_PROOF = "artifact_id|" + _name(MISSION, "':proof_packet:", "$seq")
_PROOF_ROW = _name(_PROOF, "':row:", "@status|'non_authoritative", "':", "@fact_id|@source_group")
_ASSIGNMENT = "assignment_id|" + _name(MISSION, "':", WORKER, "':assignment:", "$seq")

COORDINATION = (
    Rule("coordination.mission.created", (
        Entity(MISSION, "'mission", ("objective",), {"status": "status|'active"}), ACTOR,
        Edge("$actor", MISSION, "'started_mission"))),
    _mission_fact("coordination.worker.created", WORKER, "worker", "mission_has_worker", (), {"status": "status|'active"}),
    Rule("coordination.assignment.created", (
        Entity(WORKER, "'worker"),
        Entity(_ASSIGNMENT, "'assignment", ("assignment",),
               {"status": "status|'assigned", "mission_id": MISSION, "worker_id": WORKER}),
        Edge(WORKER, _ASSIGNMENT, "'worker_has_assignment"))),
    Rule("coordination.finding.reported", (
        Entity(WORKER, "'worker"),
        Entity(FINDING, "'finding", ("summary",),
               {"status": "status|'pending", "mission_id": MISSION, "worker_id": WORKER, "evidence_count": "#evidence|'0",
                "confidence": "~confidence", "claim_key": "claim_key", "claim_value": "claim_value"}),
        Edge(WORKER, FINDING, "'worker_reported_finding"))),
    Rule("coordination.finding.reviewed", (
        Entity(FINDING, "'finding"),
        Entity(_name(MISSION, "':", FINDING, "':review:", "$seq"), "'finding_review", ("status|'reviewed", "rationale"),
               {"status": "status|'reviewed", "mission_id": MISSION, "worker_id": WORKER}),
        Edge("$actor", FINDING, "'coordinator_reviewed_finding"))),
    Rule("coordination.finding.promoted", (
        Entity(MISSION, "'mission"),
        Entity(_name(MISSION, "':", FINDING, "':promotion:", "$seq"), "'promotion", ("summary",),
               {"status": "status|'accepted", "mission_id": MISSION, "finding_id": FINDING,
                **_keep("worker_id", "source_event_seq", "source_event_hash", "claim_key", "claim_value")}),
        Edge(FINDING, _name(MISSION, "':", FINDING, "':promotion:", "$seq"), "'finding_promoted_to_parent"))),
    Rule("coordination.conflict.detected", (
        Entity(MISSION, "'mission"),
        Entity("conflict_id|" + _name(MISSION, "':conflict:", "$seq"), "'conflict", ("summary",),
               {"mission_id": MISSION, "conflict_type": "conflict_type|'exact_claim", "finding_count": "#finding_ids|'0",
                **_keep("claim_key", "reason", "source_reference")}),
        Edge(MISSION, "conflict_id|" + _name(MISSION, "':conflict:", "$seq"), "'mission_has_conflict"),
        Entity("@", "'finding", each="finding_ids"),
        Edge("@", "conflict_id|" + _name(MISSION, "':conflict:", "$seq"), "'finding_conflicts_with", each="finding_ids"))),
    _mission_fact("coordination.decision.recorded", "decision_id|" + _name(MISSION, "':decision:", "$seq"), "decision",
                  "mission_has_decision", ("decision", "rationale"), {}),
    _mission_fact("coordination.handoff.created", "handoff_id|" + _name(MISSION, "':handoff:", "$seq"), "handoff",
                  "mission_has_handoff", ("summary", "next_steps", "risks"), {"status": "'created"}),
    Rule("coordination.proof_packet.created", (
        Entity(MISSION, "'mission"),
        Entity(_PROOF, "'coordination_proof_packet", ("query", "decision_scope"),
               {"mission_id": MISSION, **_keep("schema_version", "artifact_id", "decision_scope", "authority_scope"),
                "accepted_finding_count": "#accepted_finding_ids|'0", "diagnostic_pending_count": "#diagnostic_pending_ids|'0",
                "conflict_count": "#conflict_ids|'0", "non_authoritative_row_count": "#non_authoritative_rows|'0",
                "excluded_row_reason_count": "#excluded_row_reasons|'0", "handoff_id": "handoff_event_ref.handoff_id"}),
        Edge(MISSION, _PROOF, "'mission_has_proof_packet"),
        Entity("artifact_id", "'synthesis_artifact"), Edge(_PROOF, "artifact_id", "'proof_links_synthesis_artifact"),
        Entity("@", "'finding", each="accepted_finding_ids"),
        Edge(_PROOF, "@", "'proof_uses_accepted_finding", each="accepted_finding_ids"),
        Entity(_PROOF_ROW, "'coordination_non_authoritative_row", ("@status", "@include_reason", "@exclude_reason"),
               {"mission_id": MISSION, "proof_packet_id": _PROOF,
                **{k: f"@{k}" for k in ("source_group", "fact_id", "status", "include_reason", "exclude_reason")}},
               each="non_authoritative_rows"),
        Edge(_PROOF, _PROOF_ROW, "'proof_excludes_non_authoritative_row", each="non_authoritative_rows"),
        Entity("@", "'conflict", each="conflict_ids"), Edge(_PROOF, "@", "'proof_diagnoses_conflict", each="conflict_ids"),
        Entity("handoff_event_ref.handoff_id", "'handoff"),
        Edge(_PROOF, "handoff_event_ref.handoff_id", "'proof_binds_handoff"))),
    _fleet("fleet.skill.promoted", "skill", "'skill +skill_id+'@+skill_version|summary", _keep("skill_id", "skill_version")),
    _fleet("fleet.rule.propagated", "rule", "rule", _keep("rule_id", "rule", "trigger")),
    _fleet("fleet.outcome.propagated", "outcome", "summary", _keep("outcome", "claim_key")),
    _fleet_status("fleet.promotion.reviewed", "promotion_id", "$review_state"),
    _fleet_status("fleet.memory.superseded", "superseded_promotion_id", "'superseded"),
    _fleet_status("fleet.promotion.rolled_back", "promotion_id", "'rolled_back"),
)


def _inferred(event_type: str, relation: Template, method: Template, require: tuple[str, ...], **edge) -> Rule:
    return Rule(event_type, (
        Entity("source.name", "source.entity_type", ("source.summary",)),
        Entity("target.name", "target.entity_type", ("target.summary",)),
        Edge("source.name", "target.name", relation, inferred=True, confidence="~confidence", method=method, **edge)),
        ("source.name", "source.entity_type", "target.name", "target.entity_type", "confidence", *require))


_EVIDENCE = {k: f"evidence.{k}" for k in ("source_event_seq", "source_event_hash", "reason")}
_INSTRUCTIONS = _name("root|'workspace", "':instructions:", "signature|$seq")


def _noticed(event_type: str, name: Template, kind: str, relation: str, summary: tuple[str, ...], props, require) -> Rule:
    props = {"event_type": "$type", **props, "authority_status": "authority_status"}
    return _actor_fact(event_type, name, kind, relation, summary, props, (*require, "authority_status=non_authoritative"))


COGNITION = (
    Rule("session.genesis", (
        Entity(SESSION, "'session"),
        Entity("root|'workspace", "'workspace", ("workspace_type|'generic_workspace", "'workspace profile", "instructions_profile|'generic"),
               {"root": "root|'workspace", "workspace_type": "workspace_type|'generic_workspace",
                "confidence": "confidence|'0.0", "signals": "signals", "session_id": SESSION,
                "instructions_profile": "instructions_profile|'generic"}),
        Edge(SESSION, "root|'workspace", "'initialized_workspace"))),
    _session_fact("session.profile.corrected", _name(SESSION, "':", "from|'unknown", "'->", "to|'unknown"),
                  "workspace_profile_correction", "corrected_workspace_profile", ("reason",),
                  {"session_id": SESSION, "root": "root", "from": "from|'unknown", "to": "to|'unknown", "reason": "reason"}),
    *(_session_fact(f"workspace.instructions.{w}", _INSTRUCTIONS, "workspace_instructions", "uses_workspace_instructions",
                    ("summary",), {"session_id": SESSION, "root": "root|'workspace", "signature": "signature|$seq",
                                   "file_count": "#files|'0", "files": "files"}) for w in ("discovered", "updated")),
    _session_fact("tool.call.completed", _name(SESSION, "':", "tool_name|'tool", "':", "call_id|$seq"), "tool_call",
                  "completed_tool_call", ("status|'unknown", "result_summary"),
                  {"tool_name": "tool_name|'tool", "status": "status|'unknown", "session_id": SESSION, "call_id": "call_id"},
                  "observed_tool_call"),
    _session_fact("command.completed", _name(SESSION, "':", "command|'command", "':", "$seq"), "command_run",
                  "completed_command", ("outcome|'unknown", "command|'command"),
                  {"command": "command|'command", "exit_code": "exit_code", "outcome": "outcome|'unknown", "session_id": SESSION},
                  "observed_command"),
    _session_fact("file.edit.applied", _name(SESSION, "':", "path|'file", "':", "$seq"), "file_edit", "applied_file_edit",
                  ("operation|'modified", "summary"),
                  {"path": "path|'file", "operation": "operation|'modified", "session_id": SESSION, "line_count": "line_count"},
                  "observed_file_edit"),
    _session_fact("compaction.completed", _name(SESSION, "':compaction:", "$seq"), "compaction_run", "completed_compaction",
                  ("status|'unknown", "mode|'unknown", "log_path|'log"),
                  {"session_id": SESSION, "mode": "mode|'unknown", "status": "status|'unknown", "log_path": "log_path|'log",
                   **_keep("event_count", "output_path", "projection_path", "snapshot_path", "strategy")}),
    Rule("subagent.completed", (
        Entity("parent_session_id|'default", "'session"),
        Entity(_name("parent_session_id|'default", "':", "subagent_session_id|$thread|'subagent", "':", "$seq"), "'subagent_run",
               ("status|'unknown", "summary"),
               {"parent_session_id": "parent_session_id|'default", "status": "status|'unknown",
                "subagent_session_id": "subagent_session_id|$thread|'subagent"}),
        Edge("parent_session_id|'default",
             _name("parent_session_id|'default", "':", "subagent_session_id|$thread|'subagent", "':", "$seq"),
             "'completed_subagent"))),
    _session_fact("session.ended", _name(SESSION, "':session-ended:", "$seq"), "session_end", "ended_session",
                  ("status|'unknown", "reason|'ended"),
                  {"session_id": SESSION, "reason": "reason|'ended", "status": "status|'unknown"}),
    Rule("transcript.turn", (
        Entity(_name("source|'transcript", "':turn-", "^turn_index|$seq"), "'transcript_turn",
               (_name("role|$actor", "': ", "content|'"),),
               {"transcript_source": "source|'transcript", "transcript_role": "role|$actor",
                "transcript_turn_index": "^turn_index|$seq", "redacted_paths": "redacted_paths"}),
        Entity(_name("'neutral:transcript:", "source|'transcript", "':", "^turn_index|$seq"), "'neutral_substrate", ("content",),
               {"actor": "$actor", "timestamp": "$timestamp", "source_event_ref": "$ref",
                **_keep("permission_scope", "uncertainty", "candidate_claim")}),
        Edge(_name("'neutral:transcript:", "source|'transcript", "':", "^turn_index|$seq"),
             _name("source|'transcript", "':turn-", "^turn_index|$seq"), "'neutral_substrate_cites_source"))),
    _session_fact("llm.packet.projected", _name("session_id|$thread", "':llm-packet:", "^source_event_seq|$seq"),
                  "llm_packet_projection", "projected_llm_packet", ("summary",),
                  {"session_id": "session_id|$thread", "source_event_seq": "^source_event_seq|$seq",
                   "source_event_hash": "source_event_hash", "provider_path": "provider_path|'unknown-provider-path",
                   "status_code": "^status_code|'0", "model": "model", "prompt_tokens": "usage_counts.prompt",
                   "completion_tokens": "usage_counts.completion", "total_tokens": "usage_counts.total"}),
    _inferred("inference.edge.generated", "relation_type", "inference_method", ("relation_type", "inference_method"),
              evidence=_EVIDENCE),
    _inferred("inference.edge.retracted", "relation_type", "inference_method",
              ("relation_type", "inference_method", "valid_from", "valid_to"),
              valid_from="valid_from", valid_to="valid_to", evidence=_EVIDENCE),
    _inferred("causal.edge.generated", "graph_relation_type", "causal_method",
              ("graph_relation_type", "relation_type", "causal_method"),
              evidence={**_EVIDENCE, "causal_relation_type": "relation_type", "review_status": "review_status|'proposed",
                        "authority_status": "authority_status|'non_authoritative"}),
    Rule("consolidation.candidate.created", (
        Entity("candidate_id", "'consolidation_candidate", ("summary",),
               {**_keep("candidate_type", "title", "confidence", "method", "review_status", "authority_status", "purpose"),
                **SOURCE_REFS}),),
         ("candidate_id", "candidate_type", "title", "summary", "confidence", "method", "review_status=pending",
          "authority_status=non_authoritative", "source_events")),
    Rule("consolidation.candidate.reviewed", (
        Entity(_name("'consolidation_review:", "candidate_id", "':", "$seq"), "'consolidation_review", ("rationale",),
               _keep("candidate_id", "status", "authority_status", "rationale")),
        Entity("candidate_id", "'consolidation_candidate", (), {"review_status": "status", "authority_status": "authority_status"}),
        Edge(_name("'consolidation_review:", "candidate_id", "':", "$seq"), "candidate_id", "'reviewed_consolidation_candidate")),
         ("candidate_id", "status", "rationale", "authority_status=non_authoritative")),
    _noticed("metacognition.unknown.recorded", "unknown_id", "known_unknown", "recorded_known_unknown", ("question",),
             {**_keep("question", "reason", "claim_key", "gap_type", "status", "reverify_query"), **SOURCE_REFS},
             ("unknown_id", "question", "reason", "claim_key", "gap_type", "status=open", "source_events")),
    _noticed("metacognition.confidence.assessed", "assessment_id", "confidence_assessment", "assessed_confidence", ("claim",),
             {**_keep("claim", "claim_key", "confidence", "method", "evidence"), "support_count": "^support_count|'0",
              "conflict_count": "^conflict_count|'0", "requires_reverify": "requires_reverify|'false",
              "evidence_count": "#evidence|'0"}, ("assessment_id", "claim", "claim_key", "confidence", "method")),
    _noticed("metacognition.conflict.clustered", "cluster_id", "conflict_cluster", "clustered_conflicting_evidence", ("claim",),
             {**_keep("claim_key", "claim", "confidence", "reason", "resolution_status", "supporting_source_events",
                      "conflicting_source_events"),
              "supporting_source_event_count": "#supporting_source_events",
              "conflicting_source_event_count": "#conflicting_source_events"},
             ("cluster_id", "claim_key", "claim", "confidence", "reason", "resolution_status=unresolved",
              "supporting_source_events", "conflicting_source_events")),
    _noticed("metacognition.reverify.requested", "reverify_id", "reverify_request", "requested_reverification", ("query",),
             {**_keep("query", "reason", "claim_key", "priority", "status"), **SOURCE_REFS},
             ("reverify_id", "query", "reason", "claim_key", "priority", "status=open", "source_events")),
    _actor_fact("reasoning.primitive.called", _name("'reasoning:", "primitive", "':", "$seq"), "reasoning_primitive_observation",
                "called_reasoning_primitive", ("query",),
                {"event_type": "$type", "primitive": "primitive", "phase": "phase", "status": "status|'succeeded",
                 "result_count": "^result_count|'0", "evidence_count": "^evidence_count|'0", "citations": "citations",
                 "authority_status": "'non_authoritative"}, ("primitive", "phase")),
    _actor_fact("belief.update.proposed", "'belief:proposal:+$seq", "belief_update_proposal", "proposed_belief_update", ("claim",),
                {"event_type": "$type", **_keep("claim", "rationale", "phase", "confidence", "review_status", "authority_status"),
                 **SOURCE_REFS},
                ("claim", "rationale", "phase", "confidence", "source_events", "authority_status=non_authoritative",
                 "review_status=pending")),
)


def _refresh(word: str) -> Rule:
    return Rule(f"source.{word}", (
        Entity("path|'source", "'source", ("source_kind|'unknown", "'source", "path|'source", f"'{word}"),
               {"source_path": "path|'source", "source_kind": "source_kind|'unknown", "source_sha256": "sha256",
                "previous_sha256": "previous_sha256", "bytes": "^bytes|'0", "refresh_status": f"'{word}",
                "refresh_reason": "refresh_reason", **TRANSFORM}),))


def _projection(word: str) -> Rule:
    name = _name("'projection:", "source_kind|'unknown", "':", "path|'source")
    where = {"source_path": "path|'source", "source_kind": "source_kind|'unknown"}
    return Rule(f"projection.{word}", (
        Entity("path|'source", "'source", (), where),
        Entity(name, "'projection", ("projection|'memory", f"'projection {word} for", "path|'source"),
               {**where, "projection": "projection|'memory", "projection_status": f"'{word}",
                **_keep("source_event", "reason"), "source_sha256": "source_sha256|sha256", **TRANSFORM}),
        Edge("path|'source", name, f"'projection_{word}")))


_PATH, _LANG, _LINE = "path|'code-file", "language|'unknown", "^start_line|'1"
_END = "^end_line|^start_line|'1"
_DOC = _name("path|'document", "':", _LINE, "'-", _END)
_WHERE = {"source_path": _PATH, "language": _LANG}
_QNAME = "qualified_name|name|'symbol"
_CALLEE = "callee_qualified_name|callee|'callee"
_TEST = _name("test_path|'test-code-file", "'::", "test_qualified_name|test_name|'test")
_TARGET = _name("target_path|'target-code-file", "'::", "target_qualified_name|target_name|'target")
_SHA = {"source_sha256": "source_sha256", **TRANSFORM}

INDEXING = (
    Rule("document.indexed", (
        Entity(_DOC, "'document", ("content|'",),
               {"source_path": "path|'document", "source_start_line": _LINE, "source_end_line": _END, "source_sha256": "sha256",
                "retrieval_salience": "retrieval_salience|memory_salience|salience", **TRANSFORM}),
        Entity(_name("'neutral:", _DOC), "'neutral_substrate", ("content",),
               {"actor": "$actor", "timestamp": "$timestamp", "source_event_ref": "$ref",
                **_keep("permission_scope", "uncertainty", "candidate_claim")}),
        Edge(_name("'neutral:", _DOC), _DOC, "'neutral_substrate_cites_source"))),
    Rule("code.file.indexed", (
        ACTOR, Entity(_PATH, "'code_file", (_LANG, "'source file with", "^lines|'0", "'lines"),
                      {**_WHERE, "source_sha256": "sha256", "bytes": "^bytes|'0", "lines": "^lines|'0", **TRANSFORM}),
        Edge("$actor", _PATH, "'indexed_code_file"))),
    *(_refresh(w) for w in ("discovered", "changed", "unchanged", "deleted")),
    *(_projection(w) for w in ("updated", "retired")),
    Rule("code.symbol.indexed", (
        Entity(_PATH, "'code_file", (), _WHERE),
        Entity(_name(_PATH, "'::", _QNAME), "'code_symbol",
               (_LANG, "kind|'symbol", _QNAME, "'defined in", _name(_PATH, "':", _LINE, "'-", _END)),
               {**_WHERE, "symbol_name": "name|'symbol", "qualified_name": _QNAME, "symbol_kind": "kind|'symbol",
                "source_start_line": _LINE, "source_end_line": _END, **_SHA}),
        Edge(_PATH, _name(_PATH, "'::", _QNAME), "'defines_symbol"))),
    Rule("code.import.indexed", (
        Entity(_PATH, "'code_file", (), _WHERE),
        Entity(_name("'import:", "module|'unknown", "':", "name|module|'unknown"), "'code_import",
               (_LANG, "kind|'import", "name|module|'unknown", "'from", "module|'unknown", "'in", _name(_PATH, "':", _LINE)),
               {**_WHERE, "module": "module|'unknown", "import_name": "name|module|'unknown", "import_kind": "kind|'import",
                "source_start_line": _LINE, **_SHA}),
        Edge(_PATH, _name("'import:", "module|'unknown", "':", "name|module|'unknown"), "'imports"))),
    Rule("code.dependency.indexed", (
        Entity("source_path|'source-code-file", "'code_file", (), {"source_path": "source_path|'source-code-file", "language": _LANG}),
        Entity("target_path|'target-code-file", "'code_file", (), {"source_path": "target_path|'target-code-file", "language": _LANG}),
        Entity(_name("source_path|'source-code-file", "'->", "target_path|'target-code-file", "':", _LINE), "'code_dependency",
               ("source_path|'source-code-file", "'imports", "import_name|module|'unknown", "'from", "module|'unknown", "'via",
                _name("target_path|'target-code-file", "':", _LINE)),
               {"source_path": "source_path|'source-code-file", "target_path": "target_path|'target-code-file", "language": _LANG,
                "module": "module|'unknown", "import_name": "import_name|module|'unknown", "source_start_line": _LINE,
                "resolution": "resolution|'unknown", **_SHA}),
        Edge("source_path|'source-code-file", "target_path|'target-code-file", "'depends_on_file"))),
    Rule("code.call.indexed", (
        Entity(_name(_PATH, "'::", "caller|'caller"), "'code_symbol", (), {**_WHERE, "qualified_name": "caller|'caller"}),
        Entity(_name(_PATH, "'::", "caller|'caller", "'->", _CALLEE, "':", _LINE), "'code_call",
               ("caller|'caller", "'calls", _CALLEE, "'in", _name(_PATH, "':", _LINE)),
               {**_WHERE, "caller": "caller|'caller", "callee": "callee|'callee", "callee_qualified_name": _CALLEE,
                **_keep("target_path", "target_qualified_name"), "source_start_line": _LINE,
                "resolution": "resolution|'unresolved", **_SHA}),
        Entity("target_path+'::+target_qualified_name", "'code_symbol", (),
               {"source_path": "target_path", "language": _LANG, "qualified_name": "target_qualified_name"}),
        Edge(_name(_PATH, "'::", "caller|'caller"), "target_path+'::+target_qualified_name", "'calls_symbol"))),
    Rule("code.coverage.indexed", (
        Entity(_TEST, "'code_symbol", (),
               {"source_path": "test_path|'test-code-file", "language": _LANG, "symbol_name": "test_name|'test",
                "qualified_name": "test_qualified_name|test_name|'test", "symbol_kind": "'test"}),
        Entity(_TARGET, "'code_symbol", (),
               {"source_path": "target_path|'target-code-file", "language": _LANG, "symbol_name": "target_name|'target",
                "qualified_name": "target_qualified_name|target_name|'target"}),
        Entity(_name(_TEST, "'=>", _TARGET, "':", _LINE), "'code_coverage",
               ("test_qualified_name|test_name|'test", "'tests", "target_qualified_name|target_name|'target", "'at",
                _name("test_path|'test-code-file", "':", _LINE)),
               {"test_path": "test_path|'test-code-file", "test_name": "test_name|'test", "target_name": "target_name|'target",
                "target_path": "target_path|'target-code-file", "language": _LANG, "source_start_line": _LINE,
                "test_qualified_name": "test_qualified_name|test_name|'test",
                "target_qualified_name": "target_qualified_name|target_name|'target", "resolution": "resolution|'unknown"}),
        Edge(_TEST, _TARGET, "'tests_symbol"))),
)

BUILT_IN: tuple[Rule, ...] = (*WORKFLOW, *MEMORY, *COORDINATION, *COGNITION, *INDEXING)
