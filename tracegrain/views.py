"""Adapters from the driver tables to the engine's tables.

Adapters are SELECTs in the part of SQL that Spark and ANSI engines share, so the oracle reads the same
input rows; `@name` refers to another view or a base table.  Only the log itself is built by a Spark job.
"""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import row_numbers
from .session import checkpoint_root, parallelism

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
               "pages", "benchmark", "labels", "conversations")

_TEXT_TABLES = ("documents", "conversations", "pages", "embeddings")
_LOG_COLUMNS = ["session", "seq", "ts_us", "type", "actor", "k", "value", "cents", "event_id", "payload", "hash"]
_log_paths: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName().startswith("timestamp"):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    if name in _TEXT_TABLES and df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        df = df.repartition(spark.sparkContext.defaultParallelism)  # one small file: give the per-row text work all cores
    return df


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a log: one session per user, gap-free seq by (ts, event_id), content hash.

    Numbering is an ingest step: done once per application, written to the shared checkpoint folder and
    read back by every query.
    """
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    path = _log_paths.get(key)
    if path is None:
        tag = hashlib.md5(key[1].encode()).hexdigest()[:12]
        path = f"{checkpoint_root(spark)}/tracegrain-{key[0]}-{tag}/log"
        # micros of the stored wall clock, whatever the session's time zone
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
        events = table(spark, sf_dir, "events").select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session"), "user_id", "ts",
            micros.alias("ts_us"), F.col("event_type").alias("type"), "value", "event_id",
            F.col("props").alias("payload"))
        numbered = row_numbers(events, ["session"], ["ts", "event_id"])
        log = numbered.select(
            "session", "seq", "ts_us", "type",
            F.concat(F.lit("a"), F.pmod("user_id", F.lit(20)).cast("string")).alias("actor"),
            F.regexp_extract("payload", "[0-9]+", 0).cast("bigint").alias("k"), "value",
            F.round(F.col("value") * 100).cast("bigint").alias("cents"), "event_id", "payload")
        log = log.withColumn("hash", F.sha2(F.concat_ws("|", "session", F.col("seq").cast("string"),
                                                        F.col("ts_us").cast("string"), "type", "payload"), 256))
        log = log.select(*_LOG_COLUMNS).repartitionByRange(parallelism(spark), "session", "seq")
        log.sortWithinPartitions("session", "seq").write.mode("overwrite").parquet(path)
        _log_paths[key] = path
    return spark.read.parquet(path)


_LOG_ORACLE = """SELECT *, sha256(session || '|' || seq || '|' || ts_us || '|' || type || '|' || payload) AS hash FROM (
  SELECT 'u' || user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
         epoch_us(ts) AS ts_us, event_type AS type, 'a' || (user_id % 20) AS actor,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, value, CAST(round(value * 100) AS BIGINT) AS cents,
         event_id, props AS payload FROM events)"""

# The events carry five bare types; the memory log gives them the vocabulary the rules and folds read.
_MTYPE = """CASE type
 WHEN 'signup' THEN CASE k % 3 WHEN 0 THEN 'goal.created' WHEN 1 THEN 'task.proposed' ELSE 'user.preference_changed' END
 WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'tool.call.completed' WHEN 1 THEN 'document.indexed' WHEN 2 THEN 'file.edit.applied' ELSE 'code.call.indexed' END
 WHEN 'click' THEN CASE k % 5 WHEN 0 THEN 'task.claimed' WHEN 1 THEN 'memory.reinforced' WHEN 2 THEN 'memory.feedback' WHEN 3 THEN 'causal.edge.generated' ELSE 'coordination.finding.reported' END
 WHEN 'purchase' THEN CASE k % 4 WHEN 0 THEN 'task.completed' WHEN 1 THEN 'decision.made' WHEN 2 THEN 'coordination.finding.promoted' ELSE 'inference.edge.generated' END
 ELSE CASE k % 4 WHEN 0 THEN 'command.completed' WHEN 1 THEN 'coordination.conflict.detected' WHEN 2 THEN 'memory.rolled_back' ELSE 'probe.failed' END END"""

_MPAYLOAD = """'{"title":"goal ' || (k % 10) || '","taskId":"t' || (k % 25) || '","goalTitle":"goal ' || (k % 7)
 || '","summary":"s' || (k % 6) || '","decision":"d' || (k % 15) || '","rationale":"because ' || (k % 4)
 || '","status":"' || CASE WHEN k % 2 = 0 THEN 'ok' ELSE 'open' END || '","key":"p' || (k % 5) || '","value":"' || (k % 3)
 || '","tool_name":"tool' || (k % 8) || '","call_id":"c' || event_id || '","command":"run ' || (k % 9) || '","outcome":"'
 || CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'succeeded' END || '","exit_code":' || (k % 2) || ',"path":"src/f' || (k % 12)
 || '.py","operation":"modified","content":"text ' || (k % 30) || '","start_line":' || (k + 1) || ',"end_line":' || (k + 5)
 || ',"caller":"fn' || (k % 6) || '","callee":"fn' || (k % 11) || '","target_path":"src/f' || (k % 4)
 || '.py","target_qualified_name":"fn' || (k % 11) || '","entity_name":"m' || (k % 20) || '","entity_type":"memory","feedback":"'
 || CASE WHEN k % 2 = 0 THEN 'useful' ELSE 'wrong' END || '","reason":"r' || (k % 3) || '","mission_id":"mission' || (k % 3)
 || '","worker_id":"w' || (k % 8) || '","finding_id":"f' || (k % 40) || '","claim_key":"ck' || (k % 10) || '","claim_value":"'
 || (k % 4) || '","finding_ids":["f' || (k % 40) || '","f' || ((k + 1) % 40) || '"],"confidence":' || CASE WHEN k % 2 = 0 THEN '0.5' ELSE '0.75' END
 || ',"source":{"name":"t' || (k % 25) || '","entity_type":"task"},"target":{"name":"d' || (k % 15) || '","entity_type":"decision"},'
 || '"relation_type":"enabled","graph_relation_type":"causal_enabled","causal_method":"cited","inference_method":"cited_v1",'
 || '"evidence":{"source_event_seq":' || seq || ',"reason":"cited"}}'"""

VIEWS: dict[str, str] = {
    "mlog": f"SELECT session, seq, ts_us, {_MTYPE} AS type, actor, k, value, cents, event_id, {_MPAYLOAD} AS payload, hash FROM @log",
    # view -> surfaced, click -> confirmed, purchase -> promoted, error -> invalidated; the target is props.k
    "reinforcements": """SELECT session, seq, ts_us, k AS target, CASE type WHEN 'view' THEN 'surfaced' WHEN 'click' THEN 'confirmed'
        WHEN 'purchase' THEN 'promoted' ELSE 'invalidated' END AS kind, CAST(NULL AS DOUBLE) AS weight
        FROM @log WHERE type <> 'signup'""",
    "steps": "SELECT session, seq, hash, type AS step, CASE WHEN type = 'error' THEN 0 ELSE 1 END AS ok FROM @log",
    # findings: worker = user, claim = (props.k, event type); a third of them carry no claim of their own
    "findings": """SELECT 'm' || (event_id % 40) AS mission, session AS worker, 'f' || event_id AS finding_id, seq, event_id, hash,
        'ck' || k AS claim_key, type AS claim_value, 'src' || (k % 50) AS source_ref, 'v' || (event_id % 3) AS source_sha,
        CASE WHEN cents % 11 = 0 THEN 1 ELSE 0 END AS stale, CASE WHEN cents % 13 = 0 THEN 0 ELSE 1 END AS has_evidence,
        CASE WHEN cents % 7 = 0 THEN 1 ELSE 0 END AS test_backed, 'pending' AS status, ts_us
        FROM @log WHERE type IN ('purchase', 'error', 'click')""",
    "reviews": """SELECT 'm' || (l.doc_id % 40) AS mission, 'f' || l.doc_id AS finding_id, l.doc_id AS seq,
        CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'deferred' END AS status FROM @labels l""",
    "promotions": """SELECT mission, finding_id, event_id AS seq, 'accepted' AS status FROM @findings WHERE event_id % 9 = 0""",
    "fleet_events": """SELECT 'fl' || (event_id % 4) AS fleet, event_id AS seq, CASE type WHEN 'view' THEN 'reviewed' WHEN 'click' THEN 'superseded'
        WHEN 'error' THEN 'rolled_back' ELSE 'promoted' END AS kind, 'p' || (k % 60) AS pid, 'p' || (cents % 60) AS other,
        CASE cents % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'deferred' ELSE 'unclear' END AS decision,
        CASE k % 3 WHEN 0 THEN 'skill' WHEN 1 THEN 'rule' ELSE 'outcome' END AS memory_kind, 'ck' || (k % 9) AS conflict_key,
        'v' || (cents % 3) AS conflict_value, CASE WHEN cents % 2 = 0 THEN 'active' ELSE 'pending' END AS initial FROM @log""",
    "statements": """SELECT mission, finding_id, claim_key, claim_value, 'svc' || (event_id % 12) || ' zone' || (event_id % 7) || ' build ' ||
        CASE claim_value WHEN 'purchase' THEN 'passed' WHEN 'error' THEN 'failed' ELSE 'enabled' END AS summary FROM @findings""",
    "feedback": """SELECT session, seq, event_id, 'pf' || (k % 6) AS profile, 'g' || (k % 15) AS target_a, 'h' || (cents % 10) AS target_b,
        CASE type WHEN 'click' THEN 'helpful' WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'used' ELSE 'rejected' END WHEN 'error' THEN 'failed' ELSE 'noted' END AS outcome
        FROM @log WHERE type <> 'view'""",
    "checkouts": """SELECT event_id AS seq, 'pf' || (k % 6) AS profile, CASE WHEN cents % 3 = 0 THEN 'fail' ELSE 'pass' END AS evidence_status, cents % 4 AS warnings,
        CASE WHEN k % 5 < 2 THEN 'reason' || (k % 5) END AS suppress_reason FROM @log WHERE type = 'view'""",
    "skill_versions": """SELECT 'sk' || (k % 25) AS skill_id, CAST(cents % 3 AS VARCHAR(9)) AS version, event_id AS seq, CASE cents % 5 WHEN 0 THEN 'validated' WHEN 1 THEN 'revised'
        WHEN 2 THEN 'proposed' WHEN 3 THEN 'deprecated' ELSE 'contradicted' END AS status FROM @log WHERE type = 'signup'""",
    "skill_outcomes": """SELECT 'sk' || (k % 30) AS skill_id, CAST(cents % 3 AS VARCHAR(9)) AS version, CASE WHEN k % 7 = 0 THEN NULL ELSE (cents % 101) / 100.0 END AS success_score,
        CASE event_id % 5 WHEN 0 THEN 'used' WHEN 1 THEN 'failed' WHEN 2 THEN 'passed' ELSE 'seen' END AS feedback FROM @log WHERE type = 'click'""",
    "meta_events": """SELECT session, seq, hash, CASE type WHEN 'error' THEN 'unknown' WHEN 'click' THEN 'assessment' WHEN 'purchase' THEN 'cluster' WHEN 'view' THEN 'reverify' ELSE 'other' END AS kind,
        'ck' || (k % 12) AS claim_key, CASE WHEN type = 'purchase' THEN CASE WHEN cents % 3 = 0 THEN 'resolved' ELSE 'unresolved' END WHEN cents % 4 = 0 THEN 'closed' ELSE 'open' END AS status,
        (cents % 100) / 100.0 AS confidence, k % 3 AS conflicts FROM @log""",
    "consolidation_events": """SELECT session, seq, CASE type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'rolled_back' WHEN 'view' THEN 'reviewed' ELSE 'other' END AS kind,
        'cand' || (k % 8) AS candidate_id, CASE k % 3 WHEN 0 THEN 'episode' WHEN 1 THEN 'claim' ELSE 'procedure' END AS candidate_type,
        CASE cents % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'deferred' ELSE 'conflicted' END AS status, seq - 1 AS target_seq,
        CASE WHEN cents % 9 = 0 THEN 1 ELSE 0 END AS stale FROM @log""",
    "ledger": """SELECT 'q' || (o_custkey % 200) AS question, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 AS fact_id, 'o' || l_orderkey AS source_group,
        CASE l_linenumber % 3 WHEN 0 THEN 'currency' WHEN 1 THEN 'quantity' ELSE 'number' END AS kind,
        CASE WHEN l_linenumber % 3 = 0 THEN CAST(round(l_extendedprice / 1000) AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS value,
        CASE l_partkey % 4 WHEN 0 THEN 'hour' WHEN 1 THEN 'day' WHEN 2 THEN 'minute' ELSE 'week' END AS unit, 'p' || l_partkey || l_returnflag AS label,
        'p' || (l_partkey % 300) AS identity, l_partkey % 5 AS relevance, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 AS ord, CAST(l_shipdate AS DATE) AS event_date,
        CASE WHEN l_partkey % 3 = 0 THEN 'stated_total' ELSE 'incremental_update' END AS include_reason,
        CASE WHEN l_suppkey % 9 = 0 THEN 'off_topic' END AS exclude_reason FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey""",
    "notes": """SELECT session, seq, event_id, ts_us, 'I paid $' || (cents % 9000) || '.' || lpad(CAST(k AS VARCHAR(9)), 2, '0') || ' for ' || (k % 12 + 1) || ' items over ' || (k % 9 + 1) ||
        CASE cents % 4 WHEN 0 THEN ' hours' WHEN 1 THEN ' days' WHEN 2 THEN ' minutes' ELSE ' weeks' END || ' on ' || CASE WHEN k % 2 = 0 THEN '2023-0' || (k % 9 + 1) || '-1' || (k % 9) ELSE 'March ' || (k % 27 + 1) END ||
        ', ' || (k % 20 + 1) || CASE WHEN k % 3 = 0 THEN ' weeks ago' ELSE ' days ago' END || CASE WHEN k % 10 = 3 THEN ' with my dog named Rex' || (cents % 5) WHEN k % 10 = 7 THEN ' near my cat, Tom' || (cents % 5) ELSE '' END AS text FROM @log""",
    "code_files": """SELECT CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'src/' WHEN 3 THEN 'src/' ELSE 'lib/' END || 'pkg' || (p_partkey % 50) || '/mod' || p_partkey ||
        CASE WHEN p_size % 2 = 0 THEN '.py' ELSE '/__init__.py' END AS path FROM @part""",
    "code_imports": """SELECT 'src/app/s' || l_suppkey || '.py' AS path, 'pkg' || (l_partkey % 50) || '.mod' || l_partkey AS module, l_orderkey * 10 + l_linenumber AS line FROM @lineitem""",
    "code_calls": """SELECT 'src/app/s' || l_suppkey || '.py' AS path, CASE l_linenumber % 4 WHEN 0 THEN 'helper' || (l_partkey % 9) WHEN 1 THEN 'm.mod' || (l_partkey % 40) WHEN 2 THEN 'self.helper' || (l_partkey % 9) ELSE 'print' END AS callee,
        l_orderkey * 10 + l_linenumber AS line FROM @lineitem""",
    "code_symbols": """SELECT 'src/app/s' || s_suppkey || '.py' AS path, 'helper' || (s_suppkey % 9) AS name, 'App.helper' || (s_suppkey % 9) AS qualified_name FROM @supplier
        UNION ALL SELECT 'src/app/s' || s_suppkey || '.py', 'helper' || ((s_suppkey + 1) % 9), 'helper' || ((s_suppkey + 1) % 9) FROM @supplier""",
    "code_imported": """SELECT DISTINCT 'src/app/s' || l_suppkey || '.py' AS path, 'mod' || (l_partkey % 40) AS name, 'pkg/mod' || (l_partkey % 40) || '.py' AS target_path, 'run' || (l_partkey % 40) AS target_name
        FROM @lineitem WHERE l_linenumber % 2 = 0""",
    "traced": """SELECT session, seq, ts_us, hash, CASE type WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'model.call.requested' ELSE 'coordination.mission.created' END WHEN 'view' THEN 'tool.call.completed' WHEN 'click' THEN 'transcript.turn'
        WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'coordination.finding.reported' ELSE 'coordination.finding.promoted' END ELSE 'coordination.finding.reviewed' END AS type,
        CASE WHEN type = 'signup' THEN 'ms' || event_id WHEN event_id % 3 = 0 THEN 'ms' || (event_id - event_id % 10) END AS mission_id, CASE WHEN type = 'purchase' AND k % 2 = 0 THEN 'f' || event_id ELSE 'f' || (event_id - event_id % 7) END AS finding_id FROM @log""",
    "edges": """SELECT DISTINCT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM @lineitem JOIN @orders ON l_orderkey = o_orderkey
        UNION SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM @lineitem""",
    "geo": """SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'located_in' AS relation FROM @customer
        UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in' FROM @supplier
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM @nation""",
}


def _refs(sql: str) -> list[str]:
    return sorted(set(re.findall(r"@(\w+)", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, the log, or an adapter view as a DataFrame."""
    if name in BASE_TABLES:
        return table(spark, sf_dir, name)
    if name == "log":
        return event_log(spark, sf_dir)
    return sql(spark, sf_dir, VIEWS[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    frames = {ref: view(spark, sf_dir, ref) for ref in _refs(text)}
    return spark.sql(re.sub(r"@(\w+)", r"{\1}", text.replace("{", "{{").replace("}", "}}")), **frames)


def oracle(text: str) -> str:
    """The same view references as leading WITH clauses, for the SQL side of a check."""
    names: list[str] = []

    def visit(body: str) -> None:
        for ref in _refs(body):
            if ref in BASE_TABLES or ref in names:
                continue
            visit(_LOG_ORACLE if ref == "log" else VIEWS[ref])
            names.append(ref)

    visit(text)
    ctes = [f"{n} AS MATERIALIZED ({_LOG_ORACLE if n == 'log' else VIEWS[n]})" for n in names]
    body = re.sub(r"@(\w+)", r"\1", text).strip()
    plain = [re.sub(r"@(\w+)", r"\1", c) for c in ctes]
    if not plain:
        return body
    if body[:4].upper() == "WITH":
        head = re.match(r"(?is)with\s+(recursive\s+)?", body)
        return f"WITH {head.group(1) or ''}" + ",\n".join(plain) + ",\n" + body[head.end():]
    return "WITH " + ",\n".join(plain) + "\n" + body
