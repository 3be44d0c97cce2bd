"""Fact projection queries over the memory log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as K
from ..operators import history as H
from ..session import shared_folder, stored
from ..sources import logs as L
from .base import query

_ST = "CASE WHEN k % 2 = 0 THEN 'ok' ELSE 'open' END"
_FB = "CASE WHEN k % 2 = 0 THEN 'useful' ELSE 'wrong' END"
_OC = "CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'succeeded' END"
_CF = "CASE WHEN k % 2 = 0 THEN '0.5' ELSE '0.75' END"
_REF = "'log://' || session || '/events/' || seq || '#' || hash"
_PURP = f"'finding_id=f' || (k % 40) || ';mission_id=mission' || (k % 3) || ';outcome=' || {_OC}"
_DOC = "'src/f' || (k % 12) || '.py:' || (k + 1) || '-' || (k + 5)"
_CALLER = "'src/f' || (k % 12) || '.py::fn' || (k % 6)"
_CALLEE = "'src/f' || (k % 4) || '.py::fn' || (k % 11)"
_FBN = "'memory:m' || (k % 20) || ':feedback:' || seq"
_PROMO = "'mission' || (k % 3) || ':f' || (k % 40) || ':promotion:' || seq"
_CONF = "'mission' || (k % 3) || ':conflict:' || seq"
_TOOL = "session || ':tool' || (k % 8) || ':c' || event_id"
_EDIT = "session || ':src/f' || (k % 12) || '.py:' || seq"
_CMD = "session || ':run ' || (k % 9) || ':' || seq"
_FBP = f"'feedback=' || {_FB} || ';' || 'finding_id=f' || (k % 40) || ';last_feedback_at=' || ts_us || ';mission_id=mission' || (k % 3) || ';outcome=' || {_OC} || ';worker_id=w' || (k % 8)"
_SCALARS = (f"'call_id=c' || event_id || ' callee=fn' || (k % 11) || ' caller=fn' || (k % 6) || ' causal_method=cited claim_key=ck' || (k % 10)"
            f" || ' claim_value=' || (k % 4) || ' command=run ' || (k % 9) || ' confidence=' || {_CF} || ' content=text ' || (k % 30)"
            f" || ' decision=d' || (k % 15) || ' end_line=' || (k + 5) || ' entity_name=m' || (k % 20) || ' entity_type=memory exit_code=' || (k % 2)"
            f" || ' feedback=' || {_FB} || ' finding_id=f' || (k % 40) || ' f' || (k % 40) || ' f' || ((k + 1) % 40) || ' goalTitle=goal ' || (k % 7)"
            f" || ' graph_relation_type=causal_enabled inference_method=cited_v1 key=p' || (k % 5) || ' mission_id=mission' || (k % 3)"
            f" || ' operation=modified outcome=' || {_OC} || ' path=src/f' || (k % 12) || '.py rationale=because ' || (k % 4) || ' reason=r' || (k % 3)"
            f" || ' relation_type=enabled start_line=' || (k + 1) || ' status=' || {_ST} || ' summary=s' || (k % 6) || ' target_path=src/f' || (k % 4)"
            f" || '.py target_qualified_name=fn' || (k % 11) || ' taskId=t' || (k % 25) || ' title=goal ' || (k % 10) || ' tool_name=tool' || (k % 8)"
            f" || ' value=' || (k % 3) || ' worker_id=w' || (k % 8)")

# (event type, idx, name, entity type, summary, properties)
_ENTITY_ROWS = [
    ("goal.created", 0, "'goal ' || (k % 10)", "goal", "NULL", f"'status=' || {_ST}"), ("goal.created", 1, "actor", "actor", "NULL", "''"),
    ("task.proposed", 0, "'t' || (k % 25)", "task", "'s' || (k % 6)", f"'status=' || {_ST} || ';taskId=t' || (k % 25)"),
    ("task.proposed", 1, "actor", "actor", "NULL", "''"), ("task.proposed", 3, "'goal ' || (k % 7)", "goal", "NULL", "''"),
    ("user.preference_changed", 0, "actor", "user", "NULL", "''"),
    ("user.preference_changed", 1, "actor || ':p' || (k % 5)", "preference", "'p' || (k % 5) || '=' || (k % 3)", "''"),
    ("tool.call.completed", 0, "session", "session", "NULL", "''"),
    ("tool.call.completed", 1, _TOOL, "tool_call", _ST, f"'call_id=c' || event_id || ';session_id=' || session || ';status=' || {_ST} || ';tool_name=tool' || (k % 8)"),
    ("tool.call.completed", 3, "'t' || (k % 25)", "task", "NULL", "''"),
    ("document.indexed", 0, _DOC, "document", "'text ' || (k % 30)", "'source_end_line=' || (k + 5) || ';source_path=src/f' || (k % 12) || '.py;source_start_line=' || (k + 1)"),
    ("document.indexed", 1, f"'neutral:' || {_DOC}", "neutral_substrate", "'text ' || (k % 30)", f"'actor=' || actor || ';source_event_ref=' || {_REF} || ';timestamp=' || ts_us"),
    ("file.edit.applied", 0, "session", "session", "NULL", "''"),
    ("file.edit.applied", 1, _EDIT, "file_edit", "'modified s' || (k % 6)", "'operation=modified;path=src/f' || (k % 12) || '.py;session_id=' || session"),
    ("file.edit.applied", 3, "'t' || (k % 25)", "task", "NULL", "''"),
    ("code.call.indexed", 0, _CALLER, "code_symbol", "NULL", "'language=unknown;qualified_name=fn' || (k % 6) || ';source_path=src/f' || (k % 12) || '.py'"),
    ("code.call.indexed", 1, f"{_CALLER} || '->fn' || (k % 11) || ':' || (k + 1)", "code_call", "'fn' || (k % 6) || ' calls fn' || (k % 11) || ' in src/f' || (k % 12) || '.py:' || (k + 1)",
     "'callee=fn' || (k % 11) || ';callee_qualified_name=fn' || (k % 11) || ';caller=fn' || (k % 6) || ';language=unknown;resolution=unresolved;source_path=src/f' || (k % 12) || '.py;source_start_line=' || (k + 1) || ';target_path=src/f' || (k % 4) || '.py;target_qualified_name=fn' || (k % 11)"),
    ("code.call.indexed", 2, _CALLEE, "code_symbol", "NULL", "'language=unknown;qualified_name=fn' || (k % 11) || ';source_path=src/f' || (k % 4) || '.py'"),
    ("task.claimed", 0, "actor", "actor", "NULL", "''"),
    ("memory.reinforced", 0, "'m' || (k % 20)", "memory", "'s' || (k % 6)", f"'finding_id=f' || (k % 40) || ';last_reinforced_at=' || ts_us || ';mission_id=mission' || (k % 3) || ';outcome=' || {_OC} || ';reinforcement_count=1;status=' || {_ST} || ';worker_id=w' || (k % 8)"),
    ("memory.reinforced", 1, "actor", "actor", "NULL", "''"),
    ("memory.feedback", 0, _FBN, "memory_feedback", "'r' || (k % 3)", _FBP), ("memory.feedback", 1, "'m' || (k % 20)", "memory", "NULL", _FBP),
    ("memory.feedback", 2, "actor", "actor", "NULL", "''"),
    ("causal.edge.generated", 0, "'t' || (k % 25)", "task", "NULL", "''"), ("causal.edge.generated", 1, "'d' || (k % 15)", "decision", "NULL", "''"),
    ("coordination.finding.reported", 0, "'w' || (k % 8)", "worker", "NULL", "''"),
    ("coordination.finding.reported", 1, "'f' || (k % 40)", "finding", "'s' || (k % 6)", f"'claim_key=ck' || (k % 10) || ';claim_value=' || (k % 4) || ';confidence=' || {_CF} || ';evidence_count=0;mission_id=mission' || (k % 3) || ';status=' || {_ST} || ';worker_id=w' || (k % 8)"),
    ("task.completed", 0, "'t' || (k % 25)", "task", "'s' || (k % 6)", f"'status=' || {_ST} || ';taskId=t' || (k % 25)"), ("task.completed", 1, "actor", "actor", "NULL", "''"),
    ("decision.made", 0, "'d' || (k % 15)", "decision", "'s' || (k % 6) || ' because ' || (k % 4)", f"'status=' || {_ST}"), ("decision.made", 1, "actor", "actor", "NULL", "''"),
    ("coordination.finding.promoted", 0, "'mission' || (k % 3)", "mission", "NULL", "''"),
    ("coordination.finding.promoted", 1, _PROMO, "promotion", "'s' || (k % 6)", f"'claim_key=ck' || (k % 10) || ';claim_value=' || (k % 4) || ';finding_id=f' || (k % 40) || ';mission_id=mission' || (k % 3) || ';status=' || {_ST} || ';worker_id=w' || (k % 8)"),
    ("inference.edge.generated", 0, "'t' || (k % 25)", "task", "NULL", "''"), ("inference.edge.generated", 1, "'d' || (k % 15)", "decision", "NULL", "''"),
    ("command.completed", 0, "session", "session", "NULL", "''"),
    ("command.completed", 1, _CMD, "command_run", f"{_OC} || ' run ' || (k % 9)", f"'command=run ' || (k % 9) || ';exit_code=' || (k % 2) || ';outcome=' || {_OC} || ';session_id=' || session"),
    ("command.completed", 3, "'t' || (k % 25)", "task", "NULL", "''"),
    ("coordination.conflict.detected", 0, "'mission' || (k % 3)", "mission", "NULL", "''"),
    ("coordination.conflict.detected", 1, _CONF, "conflict", "'s' || (k % 6)", "'claim_key=ck' || (k % 10) || ';conflict_type=exact_claim;finding_count=2;mission_id=mission' || (k % 3) || ';reason=r' || (k % 3)"),
    ("coordination.conflict.detected", 3, "'f' || (k % 40)", "finding", "NULL", "''"), ("coordination.conflict.detected", 3, "'f' || ((k + 1) % 40)", "finding", "NULL", "''"),
    ("memory.rolled_back", 1, "'rollback:' || seq", "memory_rollback", "'r' || (k % 3)", "'authority_status=non_authoritative;reason=r' || (k % 3) || ';rollback_id=rollback:' || seq"),
    ("probe.failed", 0, "'event:probe.failed:' || seq", "event", f"actor || ' emitted probe.failed ' || {_SCALARS}", f"'status=' || {_ST}"),
]
_ENTITIES = "\nUNION ALL ".join(
    f"SELECT session, seq, {i} AS idx, ts_us, hash AS source_hash, {n} AS name, '{t}' AS entity_type, {s} AS summary, {p} AS props_text FROM @mlog WHERE type = '{e}'"
    for e, i, n, t, s, p in _ENTITY_ROWS)

# (event type, source, target, relation, inferred, method)
_EDGE_ROWS = [
    ("goal.created", "actor", "'goal ' || (k % 10)", "'created_goal'", None), ("task.proposed", "actor", "'t' || (k % 25)", "'proposed_task'", None),
    ("task.proposed", "'goal ' || (k % 7)", "'t' || (k % 25)", "'has_task'", None),
    ("user.preference_changed", "actor", "actor || ':p' || (k % 5)", "'has_p' || (k % 5)", None),
    ("tool.call.completed", "session", _TOOL, "'completed_tool_call'", None), ("tool.call.completed", "'t' || (k % 25)", _TOOL, "'observed_tool_call'", None),
    ("document.indexed", f"'neutral:' || {_DOC}", _DOC, "'neutral_substrate_cites_source'", None),
    ("file.edit.applied", "session", _EDIT, "'applied_file_edit'", None), ("file.edit.applied", "'t' || (k % 25)", _EDIT, "'observed_file_edit'", None),
    ("code.call.indexed", _CALLER, _CALLEE, "'calls_symbol'", None), ("task.claimed", "actor", "'t' || (k % 25)", "'claimed_task'", None),
    ("memory.reinforced", "actor", "'m' || (k % 20)", "'reinforced_memory'", None),
    ("memory.feedback", "actor", _FBN, "'recorded_memory_feedback'", None), ("memory.feedback", _FBN, "'m' || (k % 20)", "'feedback_about_memory'", None),
    ("causal.edge.generated", "'t' || (k % 25)", "'d' || (k % 15)", "'causal_enabled'", "cited"),
    ("coordination.finding.reported", "'w' || (k % 8)", "'f' || (k % 40)", "'worker_reported_finding'", None),
    ("task.completed", "actor", "'t' || (k % 25)", "'completed_task'", None), ("decision.made", "actor", "'d' || (k % 15)", "'made_decision'", None),
    ("coordination.finding.promoted", "'f' || (k % 40)", _PROMO, "'finding_promoted_to_parent'", None),
    ("inference.edge.generated", "'t' || (k % 25)", "'d' || (k % 15)", "'enabled'", "cited_v1"),
    ("command.completed", "session", _CMD, "'completed_command'", None), ("command.completed", "'t' || (k % 25)", _CMD, "'observed_command'", None),
    ("coordination.conflict.detected", "'mission' || (k % 3)", _CONF, "'mission_has_conflict'", None),
    ("coordination.conflict.detected", "'f' || (k % 40)", _CONF, "'finding_conflicts_with'", None),
    ("coordination.conflict.detected", "'f' || ((k + 1) % 40)", _CONF, "'finding_conflicts_with'", None),
]
_EDGES = "\nUNION ALL ".join(
    f"SELECT session, seq, ts_us AS valid_from, hash AS source_hash, {s} AS source, {t} AS target, {r} AS relation, {'TRUE' if m else 'FALSE'} AS inferred, "
    f"CAST({_CF if m else '1.0'} AS DOUBLE) AS confidence, {repr(m) if m else 'NULL'} AS method FROM @mlog WHERE type = '{e}'"
    for e, s, t, r, m in _EDGE_ROWS)

_VERSIONS = f"""ents AS ({_ENTITIES}),
 one AS (SELECT session, entity_type, name, seq, arg_max(struct_pack(ts := ts_us, h := source_hash, s := summary, p := props_text), idx) AS a FROM ents GROUP BY ALL),
 cmp AS (SELECT *, row_number() OVER w AS rn, lag(a.s) OVER w AS ls, lag(a.p) OVER w AS lp FROM one WINDOW w AS (PARTITION BY session, entity_type, name ORDER BY seq)),
 pts AS (SELECT * FROM cmp WHERE rn = 1 OR ls IS DISTINCT FROM a.s OR lp IS DISTINCT FROM a.p),
 vers AS (SELECT session, entity_type, name, a.s AS summary, a.p AS props_text, a.ts AS valid_from,
   lead(a.ts) OVER (PARTITION BY session, entity_type, name ORDER BY seq) AS valid_to, seq AS source_seq, a.h AS source_hash FROM pts)"""
_UPSERTED = f"""eds AS ({_EDGES}),
 kinds AS (SELECT session, seq, name, arg_max(entity_type, idx) AS kind FROM ents GROUP BY ALL),
 typed AS (SELECT e.*, a.kind AS source_type, b.kind AS target_type FROM eds e JOIN kinds a ON a.session = e.session AND a.seq = e.seq AND a.name = e.source
   JOIN kinds b ON b.session = e.session AND b.seq = e.seq AND b.name = e.target),
 ups AS (SELECT session, source_type, source, relation, target_type, target, max(valid_from) AS valid_from, arg_max(confidence, seq) AS confidence,
   arg_max(inferred, seq) AS inferred, arg_max(method, seq) AS method, max(seq) AS source_seq FROM typed GROUP BY ALL)"""
_T = 1705276800000000  # 2024-01-15


def _entities(src):
    return K.entities(src.mlog)


def _history(src):
    return K.versions(_entities(src))


def _edge_table(src):
    ents, eds = K.entities_and_edges(src.mlog)
    return K.upsert_edges(K.typed_edges(eds, ents))


def _graph(src):
    """Entity history and edge table from one extraction."""
    ents, eds = K.entities_and_edges(src.mlog)
    return K.versions(ents), K.upsert_edges(K.typed_edges(eds, ents))


@query("typed_extraction_entities", f"SELECT session, seq, name, entity_type, summary, props_text FROM ({_ENTITIES})")
def typed_extraction_entities(src):
    return _entities(src).select("session", "seq", "name", "entity_type", "summary", K.props_text(F.col("props")).alias("props_text"))


@query("typed_extraction_edges", f"SELECT session, seq, source, target, relation, inferred, confidence, method FROM ({_EDGES})")
def typed_extraction_edges(src):
    return K.edges(src.mlog).select("session", "seq", "source", "target", "relation", "inferred", "confidence", "method")


@query("generic_extraction", """SELECT session, seq, 'event:' || type || ':' || seq AS name, actor || ' emitted ' || type || ' k=' || k AS summary FROM @log""")
def generic_extraction(src):
    return K.entities(src.log).select("session", "seq", "name", "summary")


@query("entity_versions", f"WITH {_VERSIONS} SELECT session, entity_type, name, summary, props_text, valid_from, valid_to, source_seq, source_hash FROM vers")
def entity_versions(src):
    return _history(src)


def _batches(rows):
    """Three batches, the later ones full of late rows."""
    return [rows.filter(F.col("seq") % 3 == i) for i in (1, 0, 2)]


@query("entity_versions_incremental", f"WITH {_VERSIONS} SELECT session, entity_type, name, summary, props_text, valid_from, valid_to, source_seq, source_hash FROM vers")
def entity_versions_incremental(src):
    path, ents = shared_folder(src.spark, "history"), stored(_entities(src), "assertions")
    for batch in _batches(ents):
        H.merge(path, batch)
    return H.read(src.spark, path)


@query("edge_upsert_incremental", f"WITH {_VERSIONS}, {_UPSERTED} SELECT session, source_type, source, relation, target_type, target, valid_from, confidence, inferred, method, source_seq FROM ups")
def edge_upsert_incremental(src):
    ents, eds = K.entities_and_edges(src.mlog)
    path, typed = shared_folder(src.spark, "edge-history"), stored(K.typed_edges(eds, ents), "typed-edges")
    for batch in _batches(typed):
        H.merge_edges(path, batch)
    return H.read_edges(src.spark, path).select("session", "source_type", "source", "relation", "target_type", "target", "valid_from", "confidence",
                                                "inferred", "method", "source_seq")


@query("entities_as_of", f"""WITH {_VERSIONS} SELECT session, entity_type, name, summary, source_seq FROM vers
 WHERE valid_from <= {_T} AND (valid_to IS NULL OR {_T} < valid_to)""")
def entities_as_of(src):
    return K.as_of(_history(src), _T).select("session", "entity_type", "name", "summary", "source_seq")


@query("facts_as_of_seq", f"""WITH {_VERSIONS} SELECT session, entity_type, count(*) AS facts, max(source_seq) AS last_seq FROM vers
 WHERE source_seq IS NULL OR source_seq <= 30 GROUP BY session, entity_type""")
def facts_as_of_seq(src):
    return K.as_of_seq(_history(src), 30).groupBy("session", "entity_type").agg(
        F.count(F.lit(1)).alias("facts"), F.max("source_seq").alias("last_seq"))


@query("entity_invalidation", f"""WITH ents AS ({_ENTITIES}),
 one AS (SELECT session, entity_type, name, seq, arg_max(struct_pack(ts := ts_us, s := summary, p := props_text), idx) AS a FROM ents WHERE entity_type = 'memory' GROUP BY ALL),
 allrows AS (SELECT session, name, seq, FALSE AS gone, a.ts AS ts, a.s AS s, a.p AS p FROM one
   UNION ALL SELECT DISTINCT session, 'm' || (k % 20), seq, TRUE, ts_us, NULL, NULL FROM @log WHERE type = 'error'),
 cmp AS (SELECT *, row_number() OVER w AS rn, lag(s) OVER w AS ls, lag(p) OVER w AS lp, lag(gone) OVER w AS lg FROM allrows WINDOW w AS (PARTITION BY session, name ORDER BY seq, gone)),
 pts AS (SELECT * FROM cmp WHERE gone OR rn = 1 OR lg OR ls IS DISTINCT FROM s OR lp IS DISTINCT FROM p),
 vers AS (SELECT *, lead(ts) OVER (PARTITION BY session, name ORDER BY seq, gone) AS valid_to FROM pts)
 SELECT session, name, summary, valid_from, valid_to FROM (SELECT session, name, s AS summary, ts AS valid_from, valid_to, gone FROM vers) WHERE NOT gone""")
def entity_invalidation(src):
    dropped = src.log.filter("type = 'error'").select(
        "session", F.lit("memory").alias("entity_type"), F.concat(F.lit("m"), (F.col("k") % 20).cast("string")).alias("name"), "seq", "ts_us")
    memory = _entities(src).filter("entity_type = 'memory'")
    return K.versions(memory, dropped).select("session", "name", "summary", "valid_from", "valid_to")


@query("entity_invalidate_open", f"""WITH {_VERSIONS} SELECT session, name, count(*) AS windows, count(*) FILTER (WHERE vt IS NULL) AS open, max(vt) AS last_end FROM (
  SELECT session, name, CASE WHEN valid_to IS NULL AND name = 't3' THEN {_T} ELSE valid_to END AS vt FROM vers WHERE entity_type = 'task') GROUP BY session, name""")
def entity_invalidate_open(src):
    history = _history(src).filter("entity_type = 'task'")
    targets = history.filter("name = 't3'").select("session", "entity_type", "name", F.lit(_T).alias("invalid_at")).distinct()
    return K.invalidate(history, targets).groupBy("session", "name").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(F.col("valid_to").isNull()).alias("open"), F.max("valid_to").alias("last_end"))


@query("source_retirement", f"""WITH {_VERSIONS}, {_UPSERTED},
 v2 AS (SELECT *, regexp_extract(props_text, 'source_path=([^;]+)', 1) AS path FROM vers),
 hit AS (SELECT *, valid_to IS NULL AND path IN ('src/f1.py', 'src/f2.py') AS h FROM v2),
 gone AS (SELECT DISTINCT session, entity_type, name FROM hit WHERE h),
 e2 AS (SELECT u.session, CASE WHEN (u.session, u.source_type, u.source) IN (SELECT (session, entity_type, name) FROM gone) OR (u.session, u.target_type, u.target) IN (SELECT (session, entity_type, name) FROM gone) THEN 1 ELSE 0 END AS c FROM ups u)
 SELECT a.session, a.closed_entities, coalesce(b.closed_edges, 0) AS closed_edges FROM (SELECT session, count(*) FILTER (WHERE h) AS closed_entities FROM hit GROUP BY session) a
 LEFT JOIN (SELECT session, sum(c)::BIGINT AS closed_edges FROM e2 GROUP BY session) b ON a.session = b.session""")
def source_retirement(src):
    history, table = _graph(src)
    sessions = history.select("session").distinct()
    retired = sessions.withColumn("path", F.explode(F.array(F.lit("src/f1.py"), F.lit("src/f2.py")))).withColumn("invalid_at", F.lit(_T * 2))
    path = F.nullif(F.regexp_extract("props_text", "source_path=([^;]+)", 1), F.lit(""))
    nodes, edges = K.retire_source(history, table, retired, path)
    closed = lambda rows, name: rows.groupBy("session").agg(F.count_if(F.col("valid_to") == _T * 2).alias(name))
    return closed(nodes, "closed_entities").join(closed(edges, "closed_edges"), "session", "left").fillna(0, ["closed_edges"])


@query("edge_upsert", f"WITH {_VERSIONS}, {_UPSERTED} SELECT session, source_type, source, relation, target_type, target, valid_from, confidence, inferred, method, source_seq FROM ups")
def edge_upsert(src):
    return _edge_table(src).select("session", "source_type", "source", "relation", "target_type", "target", "valid_from", "confidence",
                                   "inferred", "method", "source_seq")


@query("edges_as_of", f"""WITH {_VERSIONS}, {_UPSERTED}, live AS (SELECT * FROM vers WHERE valid_from <= {_T} AND (valid_to IS NULL OR {_T} < valid_to))
 SELECT u.session, u.source, u.relation, u.target, a.summary AS source_summary, b.summary AS target_summary, a.source_seq AS source_seq, b.source_seq AS target_seq FROM ups u
 JOIN live a ON a.session = u.session AND a.entity_type = u.source_type AND a.name = u.source
 JOIN live b ON b.session = u.session AND b.entity_type = u.target_type AND b.name = u.target WHERE u.valid_from <= {_T}""")
def edges_as_of(src):
    history, table = _graph(src)
    return K.edges_as_of(table, history, _T).select(
        "session", "source", "relation", "target", "source_summary", "target_summary", "source_seq", "target_seq")


# three event types that cite their evidence explicitly
_CITING = """SELECT session, seq, ts_us, hash, k, cents, CASE type WHEN 'purchase' THEN 'task.completed' WHEN 'error' THEN 'inference.edge.contradicted'
 WHEN 'click' THEN 'outcome.explained' ELSE 'note' END AS type, '{"taskId":"t' || (k % 25) || '","decision":"' || CASE WHEN k % 4 = 0 THEN '' ELSE 'd' || (k % 15) END
 || '","decision_event_seq":' || seq || ',"decision_event_hash":"' || hash || '","source":{"name":"t' || (k % 25) || '","entity_type":"task"},'
 || '"target":{"name":"d' || (k % 15) || '","entity_type":"decision"},"relation_type":"' || CASE WHEN k % 3 = 0 THEN 'likely_implemented_decision' ELSE 'caused' END
 || '","valid_from":"' || (ts_us - 1000) || '","original_event_seq":' || (seq - 1) || ',"original_event_hash":"' || hash || '","reason":"r' || (k % 3)
 || '","cause":{"name":"c' || (k % 9) || '","entity_type":"issue"},"effect":{"name":"e' || (k % 8) || '","entity_type":"outcome"},"confidence":'
 || CASE WHEN cents % 5 = 0 THEN '1.5' ELSE '0.5' END || ',"evidence":{"source_event_seq":' || seq || ',"source_event_hash":"' || hash || '"}}' AS payload FROM @log"""


@query("inferred_edge_events", """SELECT session, seq, 'inference.edge.generated' AS event_type, 't' || (k % 25) AS source, 'd' || (k % 15) AS target,
   'likely_implemented_decision' AS relation, CAST(0.86 AS DOUBLE) AS confidence, NULL AS valid_to, seq AS cited_seq FROM @log WHERE type = 'purchase' AND k % 4 <> 0
 UNION ALL SELECT session, seq, 'inference.edge.retracted', 't' || (k % 25), 'd' || (k % 15), CASE WHEN k % 3 = 0 THEN 'likely_implemented_decision' ELSE 'caused' END, CAST(0 AS DOUBLE), ts_us, seq - 1
   FROM @log WHERE type = 'error' AND seq > 1
 UNION ALL SELECT session, seq, 'causal.edge.generated', 'c' || (k % 9), 'e' || (k % 8), 'caused', 0.5, NULL, seq FROM @log WHERE type = 'click' AND k % 3 <> 0 AND cents % 5 <> 0""")
def inferred_edge_events(src):
    return K.inferred_edge_events(src.sql(_CITING)).select(
        "session", "seq", "event_type", "source", "target", "relation", "confidence", "valid_to", "cited_seq")


@query("inferred_edge_audit", """WITH e AS (SELECT 'task_completed_decision_citation_v1' AS method, 0.86 AS c, 'likely_implemented_decision' AS r FROM @log WHERE type = 'purchase' AND k % 4 <> 0
 UNION ALL SELECT 'explicit_outcome_explanation_v1', 0.5, 'caused' FROM @log WHERE type = 'click' AND k % 3 <> 0 AND cents % 5 <> 0)
 SELECT method, count(*) AS edges, round(avg(c), 6) AS mean_confidence, min(c)::DOUBLE AS min_confidence, string_agg(DISTINCT r, ',') AS relations, 1.0::DOUBLE AS evidence_coverage FROM e GROUP BY method""")
def inferred_edge_audit(src):
    rows = K.inferred_edge_events(src.sql(_CITING)).filter("event_type <> 'inference.edge.retracted'").withColumn("inferred", F.lit(True))
    return K.inferred_edge_audit(rows).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("projection_status", """WITH l AS (SELECT *, lag(hash) OVER (PARTITION BY session ORDER BY seq) AS prev_hash FROM @log),
 p AS (SELECT * FROM l WHERE event_id % 17 <> 0 AND ts_us < 1706000000000000),
 a AS (SELECT session, count(*) AS log_events, max(seq) AS log_seq, arg_max(hash, seq) AS log_hash FROM l GROUP BY session),
 b AS (SELECT session, count(*) AS n, max(seq) AS s, arg_max(hash, seq) AS h FROM p GROUP BY session),
 m AS (SELECT p.session, count(*) AS c FROM p LEFT JOIN p q ON q.session = p.session AND q.hash = p.prev_hash WHERE p.prev_hash IS NOT NULL AND q.hash IS NULL GROUP BY p.session)
 SELECT a.session, log_events, coalesce(n, 0) AS projected_events, log_seq - coalesce(s, 0) AS lag, log_hash IS NOT DISTINCT FROM h AS current,
   greatest(coalesce(n, 0) - 1, 0) AS expected_links, coalesce(c, 0) AS missing_links FROM a LEFT JOIN b ON a.session = b.session LEFT JOIN m ON m.session = a.session""")
def projection_status(src):
    from ..ordered import neighbour, slice_of
    log = neighbour(src.log.withColumn("_slice", slice_of("seq")), ["session"], ["seq"], F.col("hash"), "prev_hash").drop("_slice")
    return K.projection_status(log, log.filter("event_id % 17 <> 0 AND ts_us < 1706000000000000"))


@query("memory_export", f"""WITH {_VERSIONS}, {_UPSERTED}
 SELECT session, grain, kind, count(*) AS entries, max(seq) AS last_seq FROM (
  SELECT session, 'event' AS grain, type AS kind, seq FROM @mlog WHERE seq > 5
  UNION ALL SELECT session, 'entity', 'entity:' || entity_type, source_seq FROM vers WHERE source_seq > 5
  UNION ALL SELECT session, 'edge', 'edge:' || relation, source_seq FROM ups WHERE source_seq > 5) GROUP BY session, grain, kind""")
def memory_export(src):
    history, table = _graph(src)
    entries = L.export_view(src.mlog, history, table, since_seq=5)
    return entries.groupBy("session", "grain", "kind").agg(F.count(F.lit(1)).alias("entries"), F.max("seq").alias("last_seq"))
