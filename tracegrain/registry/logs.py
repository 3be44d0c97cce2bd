"""Log scans, ingestion, seal and verification over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import logs as L
from .base import query


@query("log_scan", "SELECT session, seq, ts_us, type, actor, hash FROM @log")
def log_scan(src):
    return src.log.select("session", "seq", "ts_us", "type", "actor", "hash")


@query("log_tail", """SELECT session, seq, type, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS rank FROM @log) WHERE rank <= 5""")
def log_tail(src):
    return L.tail(src.log, 5).select("session", "seq", "type", "rank")


@query("log_after_cursor", """WITH cursors AS (SELECT session, max(seq) AS cursor FROM @log WHERE event_id % 3 <> 0 AND ts_us < 1705276800000000 GROUP BY session),
 fresh AS (SELECT l.session, l.seq FROM @log l LEFT JOIN cursors c ON l.session = c.session WHERE l.seq > coalesce(c.cursor, 0))
 SELECT coalesce(f.session, c.session) AS session, coalesce(f.n, 0) AS new_rows, coalesce(f.m, c.cursor) AS cursor
 FROM (SELECT session, count(*) AS n, max(seq) AS m FROM fresh GROUP BY session) f FULL JOIN cursors c ON f.session = c.session""")
def log_after_cursor(src):
    log = src.log
    cursors = (log.filter("event_id % 3 <> 0 AND ts_us < 1705276800000000")
               .groupBy("session").agg(F.max("seq").alias("cursor")))
    rows, moved = L.after_cursor(log, cursors)
    counts = rows.groupBy("session").agg(F.count(F.lit(1)).alias("new_rows"))
    return moved.join(counts, "session", "left").select("session", F.coalesce("new_rows", F.lit(0)).alias("new_rows"), "cursor")


@query("log_replay_window", "SELECT session, seq, type, hash FROM @log WHERE seq BETWEEN 10 AND 40")
def log_replay_window(src):
    return L.replay(src.log, 10, 40).select("session", "seq", "type", "hash")


_DIGEST = "sha256(session || '|' || seq || '|' || ts_us || '|' || type || '|' || payload)"
_CHAIN = f"""WITH RECURSIVE rows0 AS (SELECT session, seq, {_DIGEST} AS digest FROM @log),
 chain AS (SELECT session, seq, CAST(NULL AS VARCHAR) AS prev_hash, sha256('|' || digest) AS hash FROM rows0 WHERE seq = 1
   UNION ALL SELECT r.session, r.seq, c.hash, sha256(c.hash || '|' || r.digest) FROM chain c JOIN rows0 r ON r.session = c.session AND r.seq = c.seq + 1)"""


def _sealed(src):
    return L.seal(src.log.withColumn("digest", L.row_digest()).drop("hash"))


@query("log_seal", _CHAIN + " SELECT session, seq, prev_hash, hash FROM chain")
def log_seal(src):
    return _sealed(src).select("session", "seq", "prev_hash", "hash")


@query("log_verify_chain", f"""WITH edited AS (
  SELECT session, seq, CASE WHEN cents % 97 = 0 THEN 'x' ELSE hash END AS hash, lag(hash) OVER (PARTITION BY session ORDER BY seq) AS true_prev, event_id, cents FROM @log),
 rows1 AS (SELECT session, CASE WHEN event_id % 211 = 0 THEN seq + 1 ELSE seq END AS seq, seq AS pos, hash, cents % 97 <> 0 AS ok,
   CASE WHEN event_id % 101 = 0 THEN 'y' ELSE true_prev END AS prev_hash FROM edited),
 lagged AS (SELECT *, lag(seq) OVER (PARTITION BY session ORDER BY seq, pos) AS before_seq, lag(hash) OVER (PARTITION BY session ORDER BY seq, pos) AS before_hash FROM rows1),
 judged AS (SELECT *, CASE WHEN seq <> coalesce(before_seq, 0) + 1 THEN 'Event sequence expected ' || (coalesce(before_seq, 0) + 1) || ' but found ' || seq
   WHEN NOT ok THEN 'Event ' || seq || ' hash mismatch'
   WHEN before_seq IS NULL AND prev_hash IS NOT NULL THEN 'First event has prev_hash set'
   WHEN before_seq IS NOT NULL AND prev_hash IS DISTINCT FROM before_hash THEN 'Event ' || seq || ' prev_hash does not link to previous' END AS reason FROM lagged)
 SELECT session, count(*) AS total, count(reason) = 0 AS ok, min(seq) FILTER (WHERE reason IS NOT NULL) AS broken_at_seq,
   arg_min(reason, struct_pack(s := seq, r := reason)) FILTER (WHERE reason IS NOT NULL) AS reason FROM judged GROUP BY session""")
def log_verify_chain(src):
    from ..ordered import neighbour, slice_of
    log = src.log.withColumn("_slice", slice_of("seq"))
    linked = neighbour(log, ["session"], ["seq"], F.col("hash"), "true_prev").drop("_slice")
    broken = linked.select(
        "session", F.col("seq").alias("pos"), F.when(F.expr("event_id % 211 = 0"), F.col("seq") + 1).otherwise(F.col("seq")).alias("seq"),
        F.when(F.expr("cents % 97 = 0"), "x").otherwise(F.col("hash")).alias("hash"), F.expr("cents % 97 <> 0").alias("seal_ok"),
        F.when(F.expr("event_id % 101 = 0"), "y").otherwise(F.col("true_prev")).alias("prev_hash"))
    return L.verify_chain(broken, F.col("seal_ok"), order=("seq", "pos"))


@query("log_verify_sealed", """SELECT session, count(*) AS total, TRUE AS ok FROM @log GROUP BY session""")
def log_verify_sealed(src):
    sealed = _sealed(src)
    good = L.link(F.col("prev_hash"), F.col("digest")) == F.col("hash")
    return L.verify_chain(sealed, good).select("session", "total", "ok")


@query("document_chunk_ingest", """WITH d AS (SELECT doc_id, sha256(text) AS sha256, string_split_regex(regexp_replace(text, '(\\r\\n|\\r|\\n)$', ''), '\\r\\n|\\r|\\n') AS lines FROM documents),
 b AS (SELECT doc_id, sha256, lines, unnest(range(0, len(lines), 80)) AS s FROM d)
 SELECT doc_id, sha256, s + 1 AS start_line, least(s + 80, len(lines)) AS end_line, sha256(array_to_string(lines[s + 1:s + 80], chr(10))) AS content_sha
 FROM b WHERE regexp_matches(array_to_string(lines[s + 1:s + 80], chr(10)), '\\S')""")
def document_chunk_ingest(src):
    chunks = L.document_chunks(src.documents.select("doc_id", "text"), F.concat(F.lit("doc"), "doc_id"), F.col("text"))
    return chunks.select("doc_id", "sha256", "start_line", "end_line", F.sha2("content", 256).alias("content_sha"))


_SECRET_SQL = "regexp_matches(text, '" + "|".join(f"(?:{p})" for p in tx.SECRET_VALUES) + "')"


@query("transcript_ingest", f"""SELECT 'conv' || conv_id AS session, turn + 1 AS seq, 'transcript.turn' AS type, role AS actor, turn AS turn_index,
 CASE WHEN {_SECRET_SQL} THEN '[REDACTED]' ELSE text END AS content,
 CASE WHEN {_SECRET_SQL} THEN 'restricted' ELSE 'public' END AS sensitivity FROM conversations""")
def transcript_ingest(src):
    return L.transcript_events(src.conversations)


@query("secret_redaction", f"""SELECT doc_id, CASE WHEN {_SECRET_SQL} THEN '[REDACTED]' ELSE text END AS content,
 CASE WHEN {_SECRET_SQL} THEN 'restricted' ELSE 'public' END AS sensitivity,
 CASE WHEN {_SECRET_SQL} THEN 'body.text' ELSE '' END AS redacted_paths FROM documents""")
def secret_redaction(src):
    docs = src.documents.select("doc_id", F.to_json(F.struct(F.struct("text").alias("body"))).alias("payload"))
    return L.redact_batch(docs).select(
        "doc_id", F.get_json_object("payload", "$.body.text").alias("content"), "sensitivity",
        F.array_join("redacted_paths", ",").alias("redacted_paths"))


@query("source_refresh_plan", """WITH cur AS (SELECT 'doc' || doc_id AS path, sha256(CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END) AS sha256 FROM documents WHERE doc_id % 7 <> 0),
 prev AS (SELECT 'doc' || doc_id AS path, sha256(text) AS sha256, n_chars % 10 = 0 AS old FROM documents WHERE doc_id % 5 <> 0),
 j AS (SELECT coalesce(c.path, p.path) AS path, c.sha256 AS cs, p.sha256 AS ps FROM cur c FULL JOIN prev p ON c.path = p.path),
 s AS (SELECT path, cs, ps, CASE WHEN ps IS NULL THEN 'discovered' WHEN cs IS NULL THEN 'deleted' WHEN cs <> ps THEN 'changed' ELSE 'unchanged' END AS status FROM j)
 SELECT path, status, CASE status WHEN 'deleted' THEN 'source_deleted' WHEN 'changed' THEN 'source_changed' END AS reason,
  status IN ('changed', 'deleted') AS retire, status IN ('changed', 'discovered') AS "index" FROM s""")
def source_refresh_plan(src):
    docs = src.documents.withColumn("path", F.concat(F.lit("doc"), "doc_id"))
    cur = docs.filter("doc_id % 7 <> 0").select(
        "path", F.sha2(F.when(F.expr("doc_id % 3 = 0"), F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    prev = docs.filter("doc_id % 5 <> 0").select("path", F.sha2("text", 256).alias("sha256"))
    return L.refresh_plan(cur, prev).select("path", "status", "reason", "retire", "index")


@query("packet_summaries", """WITH p AS (SELECT u.conv_id, u.turn, u.text AS ut, a.text AS att FROM conversations u LEFT JOIN conversations a
   ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
 e AS (SELECT *, nullif(trim(regexp_replace(trim(ut, ' '), '\\s+', ' ', 'g')), '') AS u1, nullif(trim(regexp_replace(trim(att, ' '), '\\s+', ' ', 'g')), '') AS a1 FROM p)
 SELECT 'conv' || conv_id AS session, turn + 1 AS source_seq, 'model' || (conv_id % 3) AS model, CASE WHEN turn % 5 = 4 THEN 500 ELSE 200 END AS status_code,
  CASE WHEN length(u1) <= 240 THEN u1 ELSE rtrim(substr(u1, 1, 237)) || '...' END AS request_text,
  CASE WHEN length(a1) <= 240 THEN a1 ELSE rtrim(substr(a1, 1, 237)) || '...' END AS response_text FROM e""")
def packet_summaries(src):
    return L.packet_summaries(packets(src)).select("session", "source_seq", "model", "status_code", "request_text", "response_text")


def packets(src):
    turns = src.conversations
    asked = turns.filter("role = 'user'")
    replies = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    message = lambda role, body: F.struct(F.lit(role).alias("role"), body.alias("content"))
    payload = F.to_json(F.struct(
        F.concat(F.lit("model"), F.expr("conv_id % 3")).alias("model"), F.when(F.expr("turn % 5 = 4"), 500).otherwise(200).alias("status_code"),
        F.struct(F.struct(F.array(message("system", F.lit("rules")), message("user", F.col("text"))).alias("messages")).alias("body")).alias("request"),
        F.struct(F.struct(F.array(F.struct(F.struct(F.col("reply").alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response")))
    return asked.join(replies, ["conv_id", "turn"], "left").select(
        F.concat(F.lit("conv"), "conv_id").alias("session"), (F.col("turn") + 1).alias("seq"), F.lit("h").alias("hash"), payload.alias("payload"))


_RECORDS = """SELECT 'conv' || conv_id AS session, turn AS line, CASE WHEN role = 'user' THEN 'tool_use' ELSE 'tool_result' END AS kind,
 'call' || CAST(floor((turn + 1) / 2) AS BIGINT) AS call_id, 'tool' || (conv_id % 6) AS name, text AS content,
 CASE WHEN length(text) % 5 = 0 THEN 1 ELSE 0 END AS is_error, conv_id || ':' || turn AS ref FROM @conversations WHERE role <> 'system'"""


@query("session_log_import", f"""WITH r AS ({_RECORDS}), res AS (SELECT * FROM r WHERE kind = 'tool_result' AND ref NOT IN (SELECT conv_id || ':' || turn FROM conversations WHERE conv_id % 4 = 0))
 SELECT res.session, res.call_id, res.ref, coalesce(u.name, 'tool') AS tool_name, u.line AS use_line, res.line AS result_line,
  CASE WHEN res.is_error = 1 THEN 'failed' ELSE 'succeeded' END AS status, res.content AS result_summary
 FROM res LEFT JOIN (SELECT * FROM r WHERE kind = 'tool_use') u ON u.session = res.session AND u.call_id = res.call_id""")
def session_log_import(src):
    seen = src.conversations.filter("conv_id % 4 = 0").select(F.concat_ws(":", "conv_id", "turn").alias("ref"))
    return L.paired_tool_calls(src.sql(_RECORDS), seen)


@query("log_status", """SELECT session, count(*) AS events, max(seq) AS last_seq, arg_max(hash, seq) AS last_hash, max(ts_us) AS last_ts_us FROM @log GROUP BY session""")
def log_status(src):
    return L.log_status(src.log)


@query("log_diff", """SELECT session, type, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq FROM @log WHERE seq BETWEEN 20 AND 60 GROUP BY session, type""")
def log_diff(src):
    return L.replay(src.log, 20, 60).groupBy("session", "type").agg(
        F.count(F.lit(1)).alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


_FLAGS_SQL = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in tx.INJECTION.items())


@query("injection_flags", f"""SELECT 'd' || doc_id AS id, array_to_string(list_filter([{_FLAGS_SQL}], lambda x: x IS NOT NULL), ',') AS flags FROM documents
 UNION ALL SELECT 'p' || page_id, array_to_string(list_filter([{_FLAGS_SQL.replace('(text,', '(html,')}], lambda x: x IS NOT NULL), ',') FROM pages""")
def injection_flags(src):
    rows = src.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(
        src.pages.select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text")))
    return rows.select("id", F.array_join(tx.injection_flags(F.col("text")), ",").alias("flags"))
