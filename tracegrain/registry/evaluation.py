"""Evaluation, compaction, export and window-count queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import plugins
from ..functions import text as tx
from ..operators import bootstrap as S
from ..operators import compaction as C
from ..operators import evaluation as E
from ..operators import portable as P
from ..operators import retrieval as B
from ..plans import pipelines
from ..streaming import jobs
from .base import query
from .facts import _entities
from .replay import _GOV, _OUTCOMES, _outcomes
from .retrieval import _BM25

_RUNS = """SELECT type AS backend, k AS case_id, 'cat' || (k % 5) AS category, event_id % 10 AS run, CAST(max(cents % 10001) / 10000.0 AS DOUBLE) AS score, CAST(max(cents % 977) / 10.0 AS DOUBLE) AS latency_ms,
 CAST(CASE WHEN k % 7 = 0 THEN NULL ELSE max(cents % 2) END AS DOUBLE) AS recall_at_5, CAST(max(cents % 3) / 2.0 AS DOUBLE) AS answer_recall_at_5, max(cents % 4096) AS bytes FROM @log GROUP BY type, k, event_id % 10"""

_CASES = f"""cs AS (SELECT item_id AS case_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))[1:6] AS expected, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))[7:9] AS source, ['license'] AS forbidden FROM benchmark),
 rs AS (SELECT query AS case_id, rank, lower(text) AS t FROM kw JOIN documents ON doc_id = doc WHERE rank <= 10),
 tm AS (SELECT case_id, 'e' AS kind, unnest(expected) AS term FROM cs UNION ALL SELECT case_id, 's', unnest(source) FROM cs UNION ALL SELECT case_id, 'f', unnest(forbidden) FROM cs),
 bs AS (SELECT tm.case_id, kind, term, min(rank) AS rank FROM tm JOIN rs ON rs.case_id = tm.case_id AND contains(rs.t, tm.term) GROUP BY ALL),
 g AS (SELECT c.case_id, len(expected) AS ne, len(source) AS ns, (SELECT count(*) FROM bs WHERE bs.case_id = c.case_id AND kind = 'e') AS he, (SELECT count(*) FROM bs WHERE bs.case_id = c.case_id AND kind = 'f') AS hf,
   (SELECT count(*) FROM bs WHERE bs.case_id = c.case_id AND kind = 's') AS hs, (SELECT count(*) FROM bs WHERE bs.case_id = c.case_id AND kind = 'e' AND rank <= 5) AS a5,
   (SELECT min(rank) FROM bs WHERE bs.case_id = c.case_id AND kind = 's') AS fs, (SELECT min(rank) FROM bs WHERE bs.case_id = c.case_id AND kind = 'e') AS fe FROM cs c WHERE c.case_id IN (SELECT case_id FROM rs)),
 f AS (SELECT *, CASE WHEN ns > 0 THEN fs ELSE fe END AS first FROM g),
 scored AS (SELECT case_id, round(greatest(0.0, CASE WHEN ne > 0 THEN he / ne ELSE 1.0 END - hf), 4)::DOUBLE AS score, CASE WHEN ns + ne > 0 THEN CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END END::DOUBLE AS recall_at_1,
   CASE WHEN ns + ne > 0 THEN CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END END::DOUBLE AS recall_at_5, CASE WHEN ns + ne > 0 THEN CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END END::DOUBLE AS recall_at_10,
   round(CASE WHEN ne > 0 THEN a5 / ne END, 4) AS answer_recall_at_5, round(CASE WHEN ns > 0 THEN hs / ns END, 4) AS source_recall, hf AS forbidden_hits, ne - he AS missing_expected FROM f)"""


def _scored(src):
    words = F.array_sort(F.array_distinct(tx.words(F.col("text"))))
    empty = F.array().cast("array<string>")
    cases = src.benchmark.select(F.col("item_id").alias("case_id"), F.slice(words, 1, 6).alias("expected"), F.slice(words, 7, 3).alias("source"),
                                 F.array(F.lit("license")).alias("forbidden"), empty.alias("identity"))
    hits = B.keyword_search(src.benchmark, src.documents, "item_id", F.col("text"), "doc_id", F.col("text"), 10)
    results = hits.select(F.lit("bm25").alias("backend"), F.col("query").alias("case_id"), "rank", F.col("doc").alias("item"))
    return E.score_cases(cases, results, src.documents.select(F.col("doc_id").alias("item"), "text"))


@query("retrieval_scores", f"WITH {_BM25}, {_CASES} SELECT case_id, score, recall_at_1, recall_at_5, recall_at_10, answer_recall_at_5, source_recall, forbidden_hits, missing_expected FROM scored")
def retrieval_scores(src):
    return _scored(src).select("case_id", "score", "recall_at_1", "recall_at_5", "recall_at_10", "answer_recall_at_5", "source_recall", "forbidden_hits", "missing_expected")


@query("miss_taxonomy", f"""WITH {_BM25}, {_CASES}, c AS (SELECT CASE WHEN forbidden_hits > 0 THEN 'stale_or_forbidden_hit' WHEN recall_at_10 = 0 THEN 'retrieval_miss' WHEN recall_at_5 = 0 THEN 'ranking_miss'
 WHEN recall_at_5 = 1 AND answer_recall_at_5 = 0 THEN 'synthesis_miss' WHEN score >= 1.0 THEN 'hit' WHEN missing_expected > 0 THEN 'answer_miss' ELSE 'partial_hit' END AS miss_category FROM scored)
 SELECT 'bm25' AS backend, miss_category, count(*) AS runs FROM c WHERE miss_category <> 'hit' GROUP BY miss_category""")
def miss_taxonomy(src):
    return E.miss_taxonomy(E.miss_category(_scored(src)))


@query("run_summary", f"""WITH r AS ({_RUNS}) SELECT backend, category, count(*) AS runs, round(avg(score), 4) AS mean_score, round(avg(recall_at_5), 4) AS mean_recall_at_5, round(avg(answer_recall_at_5), 4) AS mean_answer_recall_at_5,
 round(avg(bytes), 4) AS mean_bytes, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms FROM r GROUP BY GROUPING SETS ((backend), (backend, category))""")
def run_summary(src):
    out = E.run_summary(src.sql(_RUNS))
    return out.withColumns({c: F.round(c, 6) for c in ("p50_ms", "p95_ms", "p99_ms")})


@query("paired_deltas", f"""WITH r AS ({_RUNS}) SELECT b.backend AS baseline, count(*) AS pairs, round(avg(round(a.score - b.score, 4)), 4) AS mean_difference FROM r a JOIN r b ON a.case_id = b.case_id AND a.run = b.run
 WHERE a.backend = 'view' AND b.backend <> 'view' GROUP BY b.backend""")
def paired_deltas(src):
    return E.paired_deltas(src.sql(_RUNS), "view").groupBy("baseline").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("delta"), 4).alias("mean_difference"))


@query("paired_comparison")
def paired_comparison(src):
    return E.paired_comparison(src.sql(_RUNS), "view")


_PAIRS = f"""SELECT b.backend AS baseline, a.case_id || '/' || a.run AS pair, a.score - b.score AS delta, a.score AS mine, b.score AS theirs FROM ({_RUNS}) a JOIN ({_RUNS}) b ON a.case_id = b.case_id AND a.run = b.run
 WHERE a.backend = 'view' AND b.backend <> 'view'"""
_DRAWS = f"""p AS ({_PAIRS}), d AS (SELECT p.*, blk, md5(pair || ':' || blk) AS h FROM p, range(0, 10) t(blk)),
 u AS (SELECT d.*, i, ('0x' || substr(h, 8 * CAST(i AS INTEGER) + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d, range(0, 4) t(i)),
 w AS (SELECT baseline, delta, mine, theirs, blk * 4 + i AS replicate, {" + ".join(f"(u >= {s!r}::DOUBLE)::INT" for s in S.STEPS)} AS w FROM u)"""


@query("bootstrap_intervals", f"""WITH {_DRAWS}, r AS (SELECT baseline, replicate, sum(w * delta) / sum(w) AS m, sum(w * mine) / sum(w * theirs) AS q FROM w GROUP BY ALL)
 SELECT baseline, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(quantile_cont(q, 0.025), 6) AS ratio_low, round(quantile_cont(q, 0.975), 6) AS ratio_high FROM r GROUP BY baseline""")
def bootstrap_intervals(src):
    pairs = src.sql(_PAIRS)
    mean = S.intervals(pairs, ["baseline"], F.col("pair"), F.col("delta"), count=40)
    ratio = S.intervals(pairs, ["baseline"], F.col("pair"), F.col("mine"), F.col("theirs"), count=40)
    return mean.join(ratio.withColumnsRenamed({"low": "ratio_low", "high": "ratio_high"}), "baseline").select(
        "baseline", *[F.round(c, 6).alias(c) for c in ("low", "high", "ratio_low", "ratio_high")])


_THRESH = "SELECT * FROM (VALUES ('score_floor', 'score', 'min', 0.4), ('latency_budget', 'latency', 'max', 60.0), ('latency_regression', 'latency', 'ratio', 0.25), ('recall_floor', 'recall', 'min', 0.5)) t(check_name, metric, kind, bound)"


@query("regression_guardrails", f"""WITH r AS ({_RUNS}), m AS (SELECT backend, metric, v FROM (SELECT backend, avg(score) AS s, avg(latency_ms) AS l FROM r WHERE backend IN ('view', 'click') GROUP BY backend), LATERAL (SELECT 'score' AS metric, s AS v UNION ALL SELECT 'latency', l)),
 j AS (SELECT t.*, c.v AS cv, b.v AS bv FROM ({_THRESH}) t LEFT JOIN m c ON c.metric = t.metric AND c.backend = 'view' LEFT JOIN m b ON b.metric = t.metric AND b.backend = 'click')
 SELECT check_name, coalesce(CASE kind WHEN 'min' THEN coalesce(cv >= bound, FALSE) WHEN 'max' THEN cv <= bound ELSE cv <= bv * (1 + bound) END, TRUE) AS passed FROM j""")
def regression_guardrails(src):
    means = src.sql(_RUNS).filter("backend IN ('view', 'click')").groupBy("backend").agg(F.avg("score").alias("score"), F.avg("latency_ms").alias("latency"))
    long = means.select("backend", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("score", "latency")])).alias("x")).select("backend", "x.*")
    return E.guardrails(long.filter("backend = 'view'"), long.filter("backend = 'click'"), src.spark.sql(_THRESH)).select("check_name", "passed")


_CAL = """SELECT CASE WHEN (cents % 100) >= 55 THEN 'likely' WHEN (cents % 100) >= 20 THEN 'possible' ELSE 'unlikely' END AS verdict, CASE k % 3 WHEN 0 THEN 'present' WHEN 1 THEN 'absent' ELSE 'partial' END AS family, k % 2 AS label, CAST((cents % 100) / 100.0 AS DOUBLE) AS score FROM @log"""


@query("calibration", f"""WITH r AS ({_CAL}) SELECT 'verdict' AS kind, verdict AS name, count(*) AS n, round(avg(label), 4) AS positive_rate, NULL::DOUBLE AS brier FROM r GROUP BY verdict
 UNION ALL SELECT 'family', family, count(*), round(avg(label), 4), round(avg((score - label) * (score - label)), 4) FROM r GROUP BY family""")
def calibration(src):
    return E.calibration(src.sql(_CAL))


def _ids(expr: str) -> str:
    return f"CASE WHEN {expr} = 0 THEN 'e0' WHEN {expr} = 1 THEN 'e1' ELSE 'e2' END"


@query("state_recovery_scores", f"""WITH r AS (SELECT type AS baseline, CASE WHEN k % 6 = 0 THEN [] ELSE list_distinct([{_ids('k % 3')}, {_ids('cents % 3')}]) END AS ret, {_ids('(k + 1) % 3')} AS minimal, {_ids('(cents + 1) % 3')} AS stale, {_ids('(k + cents) % 3')} AS distractor, k % 6 = 0 OR k % 11 = 0 AS abstain, k % 4 AS term, cents % 4 AS want, cents % 2 AS cite FROM @log),
 m AS (SELECT baseline, CASE WHEN term = want THEN 1.0 ELSE 0.0 END AS a, CASE WHEN list_contains(ret, minimal) THEN 1.0 ELSE 0.0 END AS e, CASE WHEN list_contains(ret, stale) THEN 0.0 ELSE 1.0 END AS s, CASE WHEN list_contains(ret, distractor) THEN 0.0 ELSE 1.0 END AS d,
  CASE WHEN (len(ret) = 0) = abstain THEN 1.0 ELSE 0.0 END AS ab, CASE WHEN (len(ret) = 0 AND abstain) OR (len(ret) > 0 AND cite = 1) THEN 1.0 ELSE 0.0 END AS c FROM r)
 SELECT baseline, count(*) AS cases, round(avg(a), 4)::DOUBLE AS state_accuracy, round(avg(e), 4)::DOUBLE AS evidence_recall, round(avg(s), 4)::DOUBLE AS stale_rejection, round(avg(d), 4)::DOUBLE AS distractor_resistance, round(avg(ab), 4)::DOUBLE AS abstention, round(avg(c), 4)::DOUBLE AS citation_coverage FROM m GROUP BY baseline""")
def state_recovery_scores(src):
    one = lambda e: F.array(F.expr(_ids(e)))
    returned = F.when(F.expr("k % 6 = 0"), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(one("k % 3"), one("cents % 3"))))
    rows = src.log.select(
        F.col("type").alias("baseline"), F.col("event_id").alias("case_id"), returned.alias("returned"), F.array(F.expr("k % 4")).alias("terms"), F.array(F.expr("cents % 4")).alias("expected_terms"),
        one("(k + 1) % 3").alias("minimal"), one("(cents + 1) % 3").alias("stale"), one("(k + cents) % 3").alias("distractor"), F.expr("k % 6 = 0 OR k % 11 = 0").alias("should_abstain"),
        F.when(F.expr("cents % 2 = 1"), F.size(returned)).otherwise(F.lit(-1)).alias("cited"))
    return E.state_means(E.state_recovery(rows))


@query("coordination_scores", """WITH p AS (SELECT DISTINCT mission, claim_key, claim_value FROM @findings WHERE event_id % 2 = 0), g AS (SELECT DISTINCT mission, claim_key, claim_value FROM @findings WHERE event_id % 3 = 0),
 j AS (SELECT coalesce(p.mission, g.mission) AS mission, p.mission IS NOT NULL AS hp, g.mission IS NOT NULL AS hg FROM p FULL JOIN g ON p.mission = g.mission AND p.claim_key = g.claim_key AND p.claim_value = g.claim_value)
 SELECT mission, count(*) FILTER (WHERE hp) AS predicted, count(*) FILTER (WHERE hg) AS gold, count(*) FILTER (WHERE hp AND hg) AS matched, round(CASE WHEN count(*) FILTER (WHERE hp) > 0 THEN count(*) FILTER (WHERE hp AND hg) / count(*) FILTER (WHERE hp) ELSE 1.0 END, 4) AS precision,
 round(CASE WHEN count(*) FILTER (WHERE hg) > 0 THEN count(*) FILTER (WHERE hp AND hg) / count(*) FILTER (WHERE hg) ELSE 1.0 END, 4) AS recall FROM j GROUP BY mission""")
def coordination_scores(src):
    rows = src.findings
    return E.claim_scores(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 3 = 0"), ["claim_key", "claim_value"], "mission")


@query("consolidation_gold_scores", """SELECT event_id AS case_id, k % 5 <> 0 AND k % 3 <> 0 AS candidate_match, k % 5 <> 0 AND cents % 2 = 0 AS source_fidelity, k % 5 <> 0 AND cents % 3 <> 0 AS citation_coverage, k % 5 <> 0 AND cents % 7 <> 0 AS authority_boundary,
 round(((k % 5 <> 0 AND k % 3 <> 0)::INT + (k % 5 <> 0 AND cents % 2 = 0)::INT + (k % 5 <> 0 AND cents % 3 <> 0)::INT + (k % 5 <> 0 AND cents % 7 <> 0)::INT) / 4, 4) AS score FROM @log""")
def consolidation_gold_scores(src):
    log = src.log
    two = F.array(F.lit("a"), F.lit("b"))
    cases = log.select(F.col("event_id").alias("case_id"), F.col("event_id").alias("candidate_id"), F.lit("claim").alias("candidate_type"), two.alias("sources"))
    found = log.filter("k % 5 <> 0").select(
        F.col("event_id").alias("candidate_id"), F.when(F.expr("k % 3 <> 0"), "claim").otherwise("episode").alias("candidate_type"),
        F.when(F.expr("cents % 2 = 0"), F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("sources"),
        F.when(F.expr("cents % 3 <> 0"), two).otherwise(F.array(F.lit("a"))).alias("cited"), F.when(F.expr("cents % 7 <> 0"), "non_authoritative").otherwise("accepted").alias("authority_status"))
    return E.candidate_scores(cases, found)


@query("causal_gold_scores", """WITH r AS (SELECT k AS case_id, (cents % 4 = 0) AS hit, (cents % 4 = 0 AND event_id % 2 = 0) AS rm, (cents % 4 = 0 AND event_id % 3 = 0) AS ct, (cents % 4 = 0 AND event_id % 5 <> 0) AS ab FROM @log),
 m AS (SELECT case_id, max(struct_pack(t := hit::INT + rm::INT + ct::INT + ab::INT, h := hit::INT, r := rm::INT, c := ct::INT, a := ab::INT)) AS b FROM r GROUP BY case_id)
 SELECT case_id, b.h AS hit, b.r AS relation_match, b.c AS citation, b.a AS authority_boundary, round(b.t / 4, 4) AS score FROM m""")
def causal_gold_scores(src):
    log = src.log
    cases = log.select(F.col("k").alias("case_id")).distinct().withColumns({"endpoint": F.lit("x"), "relation": F.lit("caused")})
    results = log.select(F.col("k").alias("case_id"), F.when(F.expr("cents % 4 = 0"), "x").otherwise("y").alias("endpoint"), F.when(F.expr("event_id % 2 = 0"), "caused").otherwise("blocked").alias("relation"),
                         F.expr("event_id % 3 = 0").alias("cited"), F.when(F.expr("event_id % 5 <> 0"), "non_authoritative").otherwise("accepted").alias("authority_status"))
    return E.causal_scores(cases, results)


# --- compaction ----------------------------------------------------------------------------------------------------------
_IDENTS = """idn AS (SELECT session, seq, unnest(list_distinct(['log://' || session || '/events/' || seq || '#' || substr(hash, 1, 12), 'src/f' || (k % 12) || '.py:' || (k + 1) || '-' || (k + 5), 't' || (k % 25), 'goal ' || (k % 7), 'goal ' || (k % 10),
  'mission' || (k % 3), 'w' || (k % 8), 'f' || (k % 40), 'ck' || (k % 10), (k % 4)::VARCHAR])) AS identity FROM @mlog)"""


@query("event_identities", f"WITH {_IDENTS} SELECT session, seq, identity FROM idn")
def event_identities(src):
    return C.identity_rows(src.mlog)


@query("compaction_audit", f"""WITH {_IDENTS}, rep AS (SELECT m.session, lower(m.type || ' text ' || (m.k % 30) || ' s' || (m.k % 6) || chr(10) || (SELECT string_agg(identity, chr(10)) FROM idn i WHERE i.session = m.session AND i.seq = 1)) AS r FROM @mlog m WHERE m.seq = 1),
 d AS (SELECT DISTINCT session, identity FROM idn), h AS (SELECT d.session, count(*) AS identities, count(*) FILTER (WHERE contains(r, lower(identity))) AS kept FROM d JOIN rep ON rep.session = d.session GROUP BY d.session)
 SELECT h.session, (SELECT count(*) FROM @mlog m WHERE m.session = h.session) AS events, identities, kept, round(kept / identities, 4) AS identity_recall, 1.0::DOUBLE AS citation_coverage, kept = identities AS safe FROM h""")
def compaction_audit(src):
    return C.audit(src.mlog).select("session", "events", "identities", "kept", "identity_recall", "citation_coverage", "safe")


@query("compaction_projection")
def compaction_projection(src):
    return C.projection(src.mlog, 4).select("session", "position", "seq", "citation", "context")


@query("compaction_search")
def compaction_search(src):
    asked = src.log.select((F.col("k") % 20).alias("query")).distinct().withColumn("text", F.concat(F.lit("decision task text "), F.col("query").cast("string"), F.lit(" mission1 t"), F.col("query").cast("string")))
    return C.search(C.projection(src.mlog, 2), asked, 5).select("query", "session", "seq", "score", "rank")


_PROC = """SELECT event_id, CASE cents % 9 WHEN 0 THEN 'validated' WHEN 1 THEN 'revised' WHEN 2 THEN 'proposed' WHEN 3 THEN 'pending' WHEN 4 THEN 'deprecated' WHEN 5 THEN 'stale' WHEN 6 THEN 'accepted' WHEN 7 THEN 'odd' ELSE 'deferred' END AS status, k % 11 = 0 AS stale,
 CASE WHEN k % 7 = 0 THEN '' ELSE 'c' || k END AS citation, CASE WHEN k % 5 = 0 THEN ts_us END AS valid_to, CASE WHEN k % 13 = 0 THEN 'x' ELSE ' ' END AS superseded_by FROM @log"""


@query("procedure_classification", f"""WITH p AS ({_PROC}), r AS (SELECT *, CASE WHEN status IN ('deprecated', 'stale') THEN status || '_status' WHEN stale THEN 'stale_flag' WHEN citation = '' THEN 'missing_citation' WHEN valid_to IS NOT NULL THEN 'valid_to_closed' WHEN trim(superseded_by) <> '' THEN 'superseded' WHEN status = 'odd' THEN 'unknown_status' END AS excluded_reason FROM p)
 SELECT event_id, excluded_reason, CASE WHEN excluded_reason IS NOT NULL THEN 'excluded' WHEN status IN ('proposed', 'pending', 'deferred') THEN 'diagnostic' ELSE 'applicable' END AS bucket FROM r""")
def procedure_classification(src):
    return C.classify_procedures(src.sql(_PROC)).select("event_id", "excluded_reason", "bucket")


@query("evolution_gate", """SELECT event_id, CASE WHEN type = 'view' AND cents % 100 >= 85 THEN 'auto_apply' WHEN type = 'click' AND cents % 100 >= 50 THEN 'auto_apply' ELSE 'requires_review' END AS decision FROM @log""")
def evolution_gate(src):
    policy = src.spark.createDataFrame([("view", "auto_with_rollback", None), ("click", "auto_with_rollback", 0.5), ("error", "require_review", None)], "op string, tier string, threshold double")
    return C.evolution_gate(src.log.select("event_id", F.col("type").alias("op"), (F.col("cents") % 100 / 100.0).alias("confidence")), policy).select("event_id", "decision")


@query("deterministic_ids", """SELECT 'promo:' || substr(sha256('fleet' || (k % 4) || '|' || type || '|' || session), 1, 24) AS promotion_id, count(*) AS appends FROM @log GROUP BY 1""")
def deterministic_ids(src):
    made = C.deterministic_id("promo:", F.concat(F.lit("fleet"), (F.col("k") % 4).cast("string")), F.col("type"), F.col("session"))
    return src.log.groupBy(made.alias("promotion_id")).agg(F.count(F.lit(1)).alias("appends"))


# --- export --------------------------------------------------------------------------------------------------------------
def _merkle_sql() -> str:
    steps = ["l0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, sha256('\\x00'::BLOB || encode(text)) AS h FROM documents)"]
    for n in range(1, 25):
        steps.append(f"l{n} AS MATERIALIZED (SELECT i // 2 AS i, CASE WHEN count(*) = 2 THEN sha256('\\x01'::BLOB || unhex(min_by(h, i)) || unhex(max_by(h, i))) ELSE min(h) END AS h FROM l{n - 1} GROUP BY i // 2)")
    return "WITH " + ", ".join(steps) + " SELECT h AS root FROM l24"


@query("merkle_root", _merkle_sql())
def merkle_root(src):
    nodes, _ = P.merkle_nodes(src.documents.select("doc_id", "text"), ["doc_id"], F.col("text"))
    return P.merkle_root(nodes)


@query("merkle_inclusion", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, TRUE AS included FROM documents")
def merkle_inclusion(src):
    nodes, leaves = P.merkle_nodes(src.documents.select("doc_id", "text"), ["doc_id"], F.col("text"))
    return P.verify_inclusion(leaves, P.inclusion_proofs(leaves, nodes), P.merkle_root(nodes))


@query("erasable_payloads", "SELECT event_id, CASE WHEN k % 10 = 0 THEN '[FORGOTTEN]' ELSE payload END AS payload FROM @log")
def erasable_payloads(src):
    log = src.log
    keys = log.select("event_id", F.unhex(F.substring(F.sha2(F.concat(F.lit("vault"), "hash"), 256), 1, 32)).alias("key"))
    sealed = P.encrypt_payloads(log.select("event_id", "k", "payload"), keys, "event_id")
    left = P.erase(keys, log.filter("k % 10 = 0"), "event_id")
    return P.read_payloads(sealed, left, "event_id").select("event_id", "payload")


# --- windows and plug-ins ------------------------------------------------------------------------------------------------
def _timed(src):
    return src.log.withColumn("ts", F.timestamp_micros("ts_us"))


@query("window_counts_tumbling", "SELECT type, (ts_us // 86400000000) * 86400000000 AS start_us, count(*) AS events, sum(cents)::BIGINT AS cents FROM @log GROUP BY ALL")
def window_counts_tumbling(src):
    return jobs.windowed_counts(_timed(src), "tumbling", "type").select("type", F.unix_micros("start").alias("start_us"), "events", "cents")


@query("window_counts_sliding", """SELECT type, (ts_us // 21600000000) * 21600000000 - o * 21600000000 AS start_us, count(*) AS events, sum(cents)::BIGINT AS cents FROM @log, range(0, 4) t(o) GROUP BY ALL""")
def window_counts_sliding(src):
    return jobs.windowed_counts(_timed(src), "sliding", "type").select("type", F.unix_micros("start").alias("start_us"), "events", "cents")


@query("window_counts_session", """WITH g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY session ORDER BY seq) < 7200000000 THEN 0 ELSE 1 END AS n FROM @log), s AS (SELECT *, sum(n) OVER (PARTITION BY session ORDER BY seq) AS w FROM g)
 SELECT session, min(ts_us) AS start_us, max(ts_us) + 7200000000 AS end_us, count(*) AS events FROM s GROUP BY session, w""")
def window_counts_session(src):
    return jobs.windowed_counts(_timed(src), "session", "session").select("session", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@query("plugin_embedding")
def plugin_embedding(src):
    def load():
        import zlib
        return lambda texts: [[float(zlib.crc32(f"{i}{t}".encode()) % 1000) / 1000 for i in range(8)] for t in texts]
    model = plugins.embedder(load)
    return plugins.embed_entities(_entities(src).select("session", "seq", "name", "entity_type"), F.col("name"), model, "crc8").select(
        "session", "seq", "name", F.array_join(F.transform("vector", lambda x: F.format_number(x, 3)), ",").alias("vector"), "version")


@query("plugin_fragments", """SELECT doc_id, count(*) AS fragments FROM (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS line FROM documents) WHERE regexp_matches(line, '\\S') GROUP BY doc_id""")
def plugin_fragments(src):
    plugins.register_fragments(src.spark)
    rows = src.spark.sql("SELECT doc_id, fragment FROM {docs}, LATERAL text_fragments(text)", docs=src.documents)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fragments"))


@query("hybrid_query")
def hybrid_query(src):
    return pipelines.hybrid_search(src.benchmark.select(F.col("item_id").alias("qid"), "text"), src.documents.select("doc_id", "text"), "qid", "doc_id", F.col("text"), 10)


@query("nightly_consolidation")
def nightly_consolidation(src):
    policy = src.spark.createDataFrame([("consolidation.episode", "auto_with_rollback", 0.6)], "op string, tier string, threshold double")
    out = pipelines.nightly_pass(src.mlog, ~F.col("type").startswith("memory."), F.when(F.col("type").isin("tool.call.completed", "command.completed", "file.edit.applied"), F.col("type")),
                                 F.col("k") % 3 != 0, src.meta_events, policy)
    return out["summary"]


_CTX = """SELECT session AS query, event_id AS item, 'g' || (cents % 15) AS target, 'pf' || (k % 6) AS profile, CAST((cents % 11) / 10.0 AS DOUBLE) AS overlap, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS cited, k % 2 AS source_lane,
 cents % 2 AS typed, 0.0 AS outcome, ts_us AS valid_from, CAST((cents % 50) / 10.0 AS DOUBLE) AS score, k % 13 = 0 AS exempt, session, seq, 'key' || (cents % 40) AS key, seq AS ord, k % 3 AS lane_priority,
 CASE WHEN k % 3 = 0 THEN NULL ELSE 'cite' || k END AS citation FROM @log"""


def _checkout(src):
    empty = F.array().cast("array<string>")
    contexts = src.sql(_CTX).withColumns({"query_cues": empty, "cues": empty})
    salience = src.log.select(F.expr("'g' || (cents % 15)").alias("target")).distinct().withColumn("salience", F.substring("target", 2, 9).cast("double") / 8.0)
    return pipelines.checkout(contexts, src.sql(_GOV), _outcomes(src), salience, budget=8, as_of_seq=60)


_CHECKOUT = _OUTCOMES + f""", cg AS ({_GOV}), cw AS (SELECT session, seq FROM cg WHERE kind = 'rule' AND lower(trim(review_status)) IN ('pending', 'rejected', 'deferred')
  UNION SELECT a.session, a.seq FROM cg a JOIN cg r ON r.session = a.session AND r.target_seq = a.seq AND r.kind = 'rollback' WHERE a.kind IN ('rule', 'correction')),
 c0 AS (SELECT * FROM ({_CTX}) WHERE seq <= 60), ck AS (SELECT * FROM c0 WHERE (session, seq) NOT IN (SELECT (session, seq) FROM cw)),
 cl AS (SELECT ck.* REPLACE (ck.score * coalesce(m.multiplier, 1.0) AS score), coalesce(m.suppress, FALSE) AS gone FROM ck LEFT JOIN m ON m.profile = ck.profile AND m.target = ck.target),
 cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, key ORDER BY ord) AS rn FROM cl WHERE NOT gone) WHERE rn = 1),
 cs AS (SELECT cp.*, sal, least(10.0, greatest(0.01, coalesce(sal, 1.0)))::DOUBLE AS f FROM cp LEFT JOIN (SELECT DISTINCT 'g' || (cents % 15) AS target, (cents % 15) / 8.0 AS sal FROM @log) x ON x.target = cp.target),
 cj AS (SELECT *, round(overlap * f, 6) AS prim, round(score * f, 6) AS fin, coalesce(sal < 0.15, FALSE) AS faint FROM cs)"""


@query("governed_checkout", _CHECKOUT + """ SELECT query, item, key, prim AS "primary", rank FROM (SELECT *, row_number() OVER (PARTITION BY query
  ORDER BY prim DESC, cited DESC, source_lane DESC, typed DESC, outcome DESC, valid_from DESC, fin DESC, item) AS rank FROM cj WHERE NOT faint OR exempt) WHERE rank <= 8""")
def governed_checkout(src):
    return _checkout(src)["evidence"].select("query", "item", "key", "primary", "rank")


@query("checkout_exclusions", _CHECKOUT + """ SELECT query, reason, count(*) AS rows FROM (
  SELECT query, 'governance' AS reason FROM c0 WHERE (session, seq) IN (SELECT (session, seq) FROM cw) UNION ALL SELECT query, 'outcome_suppressed' FROM cl WHERE gone
  UNION ALL SELECT query, 'attenuated' FROM cj WHERE faint AND NOT exempt) GROUP BY query, reason""")
def checkout_exclusions(src):
    return _checkout(src)["excluded"].groupBy("query", "reason").agg(F.count(F.lit(1)).alias("rows"))
