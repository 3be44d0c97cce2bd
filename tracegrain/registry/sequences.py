"""Ordered-sequence, resolution-join and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evidence as E
from ..operators import joins as J
from ..operators import sequences as S
from ..operators import facts as K
from .base import query
from .facts import _VERSIONS, _history

# --- windows and mining --------------------------------------------------------------------------------------------------
_WIN = """WITH a AS (SELECT session, seq, type, CAST(floor((row_number() OVER (PARTITION BY session ORDER BY seq) - 1) / 8) AS BIGINT) AS block FROM @mlog WHERE type NOT LIKE 'memory.%'),
 w AS (SELECT session, block, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq, list(type) AS types FROM a GROUP BY session, block),
 seg AS (SELECT *, 'segment:' || session || ':' || lpad(first_seq::VARCHAR, 6, '0') || '-' || lpad(last_seq::VARCHAR, 6, '0') AS segment_id FROM w)"""


def _windows(src):
    return S.consolidation_windows(src.mlog.filter(~F.col("type").startswith("memory.")))


@query("consolidation_windows", _WIN + """ SELECT segment_id, session, events, first_seq, last_seq, (SELECT string_agg(t || '=' || n, ',' ORDER BY t) FROM (SELECT t, count(*) AS n FROM (SELECT unnest(types) AS t) GROUP BY t)) AS type_counts FROM seg""")
def consolidation_windows(src):
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("type_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return _windows(src).select("segment_id", "session", "events", "first_seq", "last_seq", counts.alias("type_counts"))


@query("consolidation_proposals", _WIN + """, f AS (SELECT *, len(list_filter(types, lambda t: t LIKE 'file.edit.%' OR t LIKE 'task.%' OR t LIKE 'coordination.%')) > 0 AS sig,
  len(list_filter(types, lambda t: t = 'tool.call.completed')) >= 2 OR (len(list_filter(types, lambda t: t LIKE 'file.edit.%')) > 0 AND len(list_filter(types, lambda t: t LIKE 'tool.call.%' OR t LIKE 'command.%' OR t LIKE 'task.%')) > 0) AS steps FROM seg)
 SELECT segment_id, 'episode' AS candidate_type, 0.68::DOUBLE AS confidence FROM f UNION ALL SELECT segment_id, 'claim', 0.62::DOUBLE FROM f WHERE events >= 2 AND sig UNION ALL SELECT segment_id, 'procedure', 0.58::DOUBLE FROM f WHERE steps""")
def consolidation_proposals(src):
    return S.consolidation_proposals(_windows(src)).select("segment_id", "candidate_type", "confidence")


def _traces(src):
    return S.session_traces(src.log, F.col("type"), F.col("type") != "error")


@query("trace_sessionisation", "SELECT session, seq, type AS step, type <> 'error' AS ok, row_number() OVER (PARTITION BY session ORDER BY seq) AS pos FROM @log")
def trace_sessionisation(src):
    return _traces(src).select("session", "seq", "step", "ok", "pos")


@query("successful_runs", """WITH r AS (SELECT session, seq, type, sum(CASE WHEN type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq)::BIGINT AS run FROM @log)
 SELECT session, run, count(*) AS length, min(seq) AS first_seq, max(seq) AS last_seq FROM r WHERE type <> 'error' GROUP BY session, run""")
def successful_runs(src):
    return S.successful_runs(_traces(src)).filter("ok").groupBy("session", "run").agg(
        F.count(F.lit(1)).alias("length"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def _mine(tag: str = "", where: str = "") -> str:
    return f"""r{tag} AS (SELECT session, seq, CASE WHEN type = 'error' THEN '!' ELSE type END AS step FROM @log {where}),
 w{tag} AS (SELECT session, seq, list(step) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS ahead FROM r{tag}),
 u{tag} AS (SELECT session, seq, ahead, CASE WHEN list_position(ahead, '!') > 0 THEN list_position(ahead, '!') - 1 ELSE len(ahead) END AS len FROM w{tag}),
 g{tag} AS (SELECT session, seq, array_to_string(ahead[1:n], '>') AS steps, n FROM (SELECT session, seq, ahead, unnest(range(2, CAST(len + 1 AS BIGINT))) AS n FROM u{tag} WHERE len >= 2)),
 m{tag} AS (SELECT steps, n, count(DISTINCT session) AS support, count(*) AS occurrences, min(seq) AS first_seq, list_sort(list(DISTINCT session)) AS sessions FROM g{tag} GROUP BY steps, n HAVING count(DISTINCT session) >= 2)"""


def _mined(tag: str = "") -> str:
    return f"FROM m{tag} m WHERE NOT EXISTS (SELECT 1 FROM m{tag} o WHERE o.n > m.n AND o.support = m.support AND o.sessions = m.sessions AND contains('>' || o.steps || '>', '>' || m.steps || '>'))"


_MINE = "WITH " + _mine()
_EVEN = "WHERE CAST(regexp_extract(session, '[0-9]+') AS BIGINT) % 2 = 0"


@query("procedure_ngrams", _MINE + " SELECT steps, count(*) AS occurrences, count(DISTINCT session) AS support FROM g GROUP BY steps")
def procedure_ngrams(src):
    grams = S.procedure_ngrams(_traces(src)).withColumn("steps", F.array_join("gram", ">"))
    return grams.groupBy("steps").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("session").alias("support"))


@query("procedure_mining", _MINE + " SELECT steps, n AS length, support, occurrences, first_seq, round(least(0.85, 0.5 + 0.05 * (support - 2)), 2)::DOUBLE AS confidence " + _mined())
def procedure_mining(src):
    return S.mine_procedures(_traces(src)).select("steps", "length", "support", "occurrences", "first_seq", "confidence")


@query("procedure_mining_rerun", f"{_MINE}, {_mine('e', _EVEN)} SELECT steps, support FROM (SELECT steps, support {_mined()}) WHERE steps NOT IN (SELECT steps {_mined('e')})")
def procedure_mining_rerun(src):
    """A second run leaves out what was proposed before; here before means sessions of even users."""
    mined = S.mine_procedures(_traces(src)).select("steps", "support")
    known = S.mine_procedures(_traces(src).filter(F.regexp_extract("session", r"(\d+)", 1).cast("bigint") % 2 == 0)).select("steps")
    from ..operators.setops import unseen
    return unseen(mined, known, ["steps"])


# --- temporal ------------------------------------------------------------------------------------------------------------
_PROG_ROWS = """SELECT 'g' || (k % 10) AS program, event_id, event_id AS ord, type AS label, type || ' item ' || (k % 7) AS raw_span, 'src' || (k % 50) AS source_group,
 CASE WHEN cents % 17 <> 0 THEN DATE '2024-01-01' + CAST(floor((ts_us - 1704067200000000) / 86400000000) AS INT) END AS event_date, 'id' || (cents % 200) AS identity,
 CASE WHEN cents % 23 = 0 THEN 'withdrawn' END AS exclude_reason FROM @log"""


@query("temporal_evidence_program", f"""WITH r AS ({_PROG_ROWS}), s AS (SELECT *, CASE WHEN contains(lower(label || ' ' || raw_span), 'purchase') THEN 1 ELSE 0 END + CASE WHEN contains(lower(label || ' ' || raw_span), 'item 3') THEN 1 ELSE 0 END AS hits FROM r),
 b AS (SELECT program, event_id AS bid, event_date AS bdate FROM (SELECT *, row_number() OVER (PARTITION BY program ORDER BY hits DESC, source_group, ord) AS rn FROM s WHERE event_date IS NOT NULL AND hits > 0) WHERE rn = 1),
 j AS (SELECT s.*, b.bid, CASE WHEN exclude_reason IS NOT NULL THEN exclude_reason WHEN event_id = bid THEN 'temporal_count_target' WHEN event_date IS NULL THEN 'missing_temporal_count_date'
  WHEN (s.program IN ('g0', 'g2', 'g4', 'g6', 'g8') AND event_date >= bdate) OR (s.program NOT IN ('g0', 'g2', 'g4', 'g6', 'g8') AND event_date <= bdate) THEN 'temporal_count_outside_window' END AS reason FROM s LEFT JOIN b ON b.program = s.program),
 d AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY program, identity, reason IS NULL ORDER BY ord) END AS rn FROM j)
 SELECT program, event_id, event_id = bid AS boundary, CASE WHEN rn > 1 THEN 'duplicate_identity' ELSE reason END AS reason FROM d""")
def temporal_evidence_program(src):
    rows = src.sql(_PROG_ROWS)
    programs = rows.select("program").distinct().withColumns({
        "terms": F.array(F.lit("purchase"), F.lit("item 3")), "distinct": F.lit(True),
        "direction": F.when(F.substring("program", 2, 9).cast("int") % 2 == 0, "before").otherwise("after")})
    return S.temporal_program(programs, rows).select("program", "event_id", "boundary", "reason")


_INC = "inc AS (SELECT * FROM @ledger WHERE exclude_reason IS NULL)"


@query("date_intervals", f"""WITH {_INC}, o AS (SELECT question, event_date, source_group, min(struct_pack(r := -relevance, o := ord)) AS s FROM inc GROUP BY ALL),
 p AS (SELECT a.question, date_diff('day', a.event_date, b.event_date) AS days, min(struct_pack(r := a.s.r + b.s.r, o := a.s.o + b.s.o)) AS k FROM o a JOIN o b ON a.question = b.question AND a.source_group <> b.source_group
  AND b.event_date > a.event_date AND b.event_date <= a.event_date + 366 GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY k, days) AS rank FROM p)
 SELECT question, rank, days, CASE WHEN days % 7 = 0 THEN days // 7 END AS weeks, -k.r AS relevance FROM r WHERE rank <= 5""")
def date_intervals(src):
    return E.date_intervals(src.ledger)


@query("temporal_sequence", f"""WITH {_INC}, o AS (SELECT question, identity, min(event_date) AS event_date FROM inc GROUP BY ALL)
 SELECT question, identity, event_date, dense_rank() OVER (PARTITION BY question ORDER BY event_date) AS position FROM o""")
def temporal_sequence(src):
    return E.temporal_sequence(src.ledger)


@query("long_horizon_split", f"""WITH t AS (SELECT session, max(seq) AS n FROM @log GROUP BY session), sp AS (SELECT session, n - 20 AS split_seq FROM t WHERE n > 20),
 c AS (SELECT session, seq AS item_id, 'note ' || type || ' item ' || (k % 9) AS text, k % 12 AS sources, seq AS max_seq, CASE WHEN k % 4 = 0 THEN NULL ELSE (k % 10) / 10.0 END AS confidence FROM @log),
 j AS (SELECT c.session, c.item_id, round(0.4 * ((CASE WHEN type_ok THEN 1 ELSE 0 END + 1) / 2.0) + 0.25 * least(1.0, sources / 8.0) + 0.2 * least(1.0, greatest(0.0, max_seq::DOUBLE / split_seq)) + 0.15 * coalesce(confidence, 0.5), 6)::DOUBLE AS score
  FROM (SELECT *, contains(text, 'purchase') AS type_ok FROM c) c JOIN sp ON sp.session = c.session AND max_seq <= split_seq)
 SELECT session, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, item_id) AS rank FROM j) WHERE rank <= 5""")
def long_horizon_split(src):
    items = src.log.select(
        "session", F.col("seq").alias("item_id"), F.expr("'note ' || type || ' item ' || (k % 9)").alias("text"), (F.col("k") % 12).alias("sources"),
        F.col("seq").alias("max_seq"), F.when(F.expr("k % 4 <> 0"), (F.col("k") % 10) / 10.0).alias("confidence"))
    asked = src.log.select("session").distinct().withColumns({"query_id": F.lit(1), "text": F.lit("purchase item")})
    return S.long_horizon(items, S.horizon_split(src.log, 20), asked, budget=5).select("session", "item_id", "score", "rank")


_EVID = """SELECT session AS query_id, 'src' || (k % 30) AS source_id, 'cite' || (cents % 40) AS citation, type AS lane, (cents % 50) / 10.0 AS score, seq AS ord, 'snip ' || (k % 3) AS snippet FROM @log"""


@query("evidence_grouping", f"""WITH e AS ({_EVID}), o AS (SELECT query_id, source_id, citation, lane, snippet, max(score) AS score, min(ord) AS ord FROM e GROUP BY ALL)
 SELECT query_id, source_id, count(*) AS rows, count(DISTINCT citation) AS citations, array_to_string(list_sort(list(DISTINCT lane)), ',') AS lanes, max(score)::DOUBLE AS top_score, arg_min(snippet, ord) AS snippet FROM o GROUP BY ALL""")
def evidence_grouping(src):
    return S.evidence_groups(src.sql(_EVID).withColumn("score", F.col("score").cast("double")))


_WS = "SELECT session, type AS category, 's' || (k % 6) AS summary, 'cite' || (cents % 7) AS citation, seq AS ord, event_id FROM @log"


@query("working_set", f"""WITH b AS (SELECT session, category, summary, citation, min(struct_pack(l := CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END, o := ord)) AS o FROM ({_WS}) GROUP BY ALL)
 SELECT session, category, summary, citation, rank FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY o, citation) AS rank FROM b) WHERE rank <= 8""")
def working_set(src):
    rows = src.sql(_WS)
    return S.working_set(rows.filter("event_id % 2 = 0").drop("event_id"), rows.filter("event_id % 2 = 1").drop("event_id"), 8)


# --- ledgers -------------------------------------------------------------------------------------------------------------
@query("evidence_numeric_results", f"""WITH {_INC} SELECT question, kind, count(*) AS rows, sum(value)::BIGINT AS total, round(avg(value), 4) AS average, max(value) - min(value) AS difference, max(value) AS largest,
 arg_max(label, struct_pack(v := value, f := fact_id)) AS largest_label, count(DISTINCT source_group) AS sources FROM inc GROUP BY ALL""")
def evidence_numeric_results(src):
    return E.numeric_results(src.ledger)


@query("currency_dedup", """WITH m AS (SELECT question, source_group, value, min(ord) AS f FROM @ledger WHERE kind = 'currency' AND exclude_reason IS NULL GROUP BY ALL)
 SELECT l.question, l.fact_id, CASE WHEN l.kind = 'currency' AND l.ord > m.f THEN 'duplicate_source_value' ELSE l.exclude_reason END AS exclude_reason FROM @ledger l
 LEFT JOIN m ON m.question = l.question AND m.source_group = l.source_group AND m.value = l.value""")
def currency_dedup(src):
    return E.dedupe_currency(src.ledger).select("question", "fact_id", "exclude_reason")


@query("duration_totals", f"""WITH {_INC}, o AS (SELECT DISTINCT question, source_group, value, unit FROM inc), h AS (SELECT question, bool_or(unit = 'hour') AS has FROM o GROUP BY question)
 SELECT o.question, count(*) AS rows, sum(value * CASE unit WHEN 'minute' THEN 1 WHEN 'hour' THEN 60 WHEN 'day' THEN 1440 ELSE 10080 END)::BIGINT AS minutes, count(DISTINCT source_group) AS sources
 FROM o JOIN h ON h.question = o.question WHERE NOT has OR unit = 'hour' GROUP BY o.question""")
def duration_totals(src):
    return E.duration_totals(src.ledger, "hour")


@query("distinct_item_counts", f"""SELECT question, count(DISTINCT identity) AS items, count(DISTINCT source_group) AS sources FROM @ledger WHERE exclude_reason IS NULL AND relevance >= 2 GROUP BY question""")
def distinct_item_counts(src):
    return E.distinct_counts(E.count_threshold(src.ledger, 2))


@query("distinct_item_list", f"""SELECT question, identity, min(ord) AS first_ord, count(*) AS mentions FROM @ledger WHERE exclude_reason IS NULL AND relevance >= 2 GROUP BY ALL""")
def distinct_item_list(src):
    return E.distinct_items(E.count_threshold(src.ledger, 2))


@query("numeric_state", f"""WITH {_INC}, t AS (SELECT question, max(ord) FILTER (WHERE include_reason = 'stated_total') AS lo, arg_max(value, ord) FILTER (WHERE include_reason = 'stated_total') AS last_total,
   arg_min(value, ord) FILTER (WHERE include_reason = 'stated_total') AS first_total, count(*) FILTER (WHERE include_reason = 'stated_total') AS totals FROM inc GROUP BY question),
 i AS (SELECT inc.question, sum(value)::BIGINT AS increments, count(*) AS increment_rows FROM inc JOIN t ON t.question = inc.question WHERE include_reason = 'incremental_update' AND (lo IS NULL OR ord > lo) GROUP BY inc.question)
 SELECT t.question, last_total, first_total, totals, coalesce(increments, 0) AS increments, coalesce(increment_rows, 0) AS increment_rows, coalesce(last_total, 0) + coalesce(increments, 0) AS answer,
  CASE WHEN totals >= 2 THEN last_total - first_total END AS difference FROM t LEFT JOIN i ON i.question = t.question""")
def numeric_state(src):
    return E.numeric_state(src.ledger.withColumn("kind", F.lit("numeric_state")))


@query("evidence_policy", """WITH r AS (SELECT 'src' || i AS profile, unnest(['license', 'the', 'copyright', 'und']) AS term FROM range(0, 20) t(i)),
 f AS (SELECT DISTINCT source AS profile, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: len(w) > 1)) AS term FROM documents)
 SELECT r.profile, r.term, f.term IS NOT NULL AS satisfied FROM r LEFT JOIN f ON f.profile = r.profile AND f.term = r.term""")
def evidence_policy(src):
    profiles = src.documents.select(F.col("source").alias("profile")).distinct()
    required = profiles.withColumn("term", F.explode(F.array(*[F.lit(t) for t in ("license", "the", "copyright", "und")])))
    return E.evidence_policy(required, src.documents.select(F.col("source").alias("profile"), "text"))


@query("slot_coverage", f"""WITH {_INC}, h AS (SELECT question, kind, count(*) AS rows, count(DISTINCT source_group) AS groups FROM inc GROUP BY ALL),
 s AS (SELECT DISTINCT question, unnest(['currency', 'quantity', 'date']) AS kind FROM @ledger)
 SELECT s.question, s.kind, coalesce(rows, 0) AS rows, coalesce(groups, 0) AS groups, coalesce(rows, 0) >= 3 AND coalesce(groups, 0) >= 2 AS covered FROM s LEFT JOIN h ON h.question = s.question AND h.kind = s.kind""")
def slot_coverage(src):
    slots = src.ledger.select("question").distinct().withColumn("kind", F.explode(F.array(F.lit("currency"), F.lit("quantity"), F.lit("date"))))
    return E.slot_coverage(slots.withColumns({"min_rows": F.lit(3), "min_groups": F.lit(2)}), src.ledger).select("question", "kind", "rows", "groups", "covered")


_OPS = "CASE l.ord % 6 WHEN 0 THEN 'total' WHEN 1 THEN 'count' WHEN 2 THEN 'quantity' WHEN 3 THEN 'unit_price' WHEN 4 THEN 'points' ELSE 'point_rate' END"


@query("derived_ratios", f"""WITH b AS (SELECT question, {_OPS} AS kd, arg_max(value, struct_pack(r := relevance, o := -ord)) AS v FROM @ledger l WHERE exclude_reason IS NULL GROUP BY ALL),
 p AS (SELECT question, max(v) FILTER (WHERE kd = 'total') AS t, max(v) FILTER (WHERE kd = 'count') AS c, max(v) FILTER (WHERE kd = 'quantity') AS q, max(v) FILTER (WHERE kd = 'unit_price') AS u,
  max(v) FILTER (WHERE kd = 'points') AS pt, max(v) FILTER (WHERE kd = 'point_rate') AS pr FROM b GROUP BY question)
 SELECT question, round(t / nullif(c, 0), 4)::DOUBLE AS unit_price, q * u AS sales_total, pt * pr AS points_value FROM p""")
def derived_ratios(src):
    kinds = ["total", "count", "quantity", "unit_price", "points", "point_rate"]
    rows = src.ledger.withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("ord") % 6 + 1).cast("int")))
    return E.derived_values(rows)


@query("preference_profile", f"""WITH {_INC} SELECT question, count(DISTINCT identity) AS preferences, count(DISTINCT source_group) AS sources, max(relevance) AS overlap,
 round(least(0.95, 0.56 + 0.1 * least(count(DISTINCT identity), 3) + 0.03 * max(relevance)), 4)::DOUBLE AS confidence FROM inc GROUP BY question""")
def preference_profile(src):
    return E.preference_profile(src.ledger)


@query("most_recent_value", f"""SELECT question, arg_min(value, struct_pack(d := date_diff('day', event_date, DATE '2005-01-01'), o := ord)) AS value, min(date_diff('day', event_date, DATE '2005-01-01')) AS days_ago FROM @ledger GROUP BY question""")
def most_recent_value(src):
    return E.most_recent_value(src.ledger.withColumn("days_ago", F.date_diff(F.lit("2005-01-01").cast("date"), "event_date")))


_TITLES = """SELECT question, 'title ' || identity AS title, CASE WHEN ord % 2 = 0 THEN 'start' ELSE 'finish' END AS role, event_date, relevance, ord FROM @ledger"""


@query("titled_durations", f"""WITH t AS ({_TITLES}), b AS (SELECT question, title, role, arg_max(event_date, struct_pack(r := relevance, o := -ord)) AS d FROM t GROUP BY ALL),
 p AS (SELECT question, title, max(d) FILTER (WHERE role = 'start') AS s, max(d) FILTER (WHERE role = 'finish') AS f FROM b GROUP BY ALL),
 w AS (SELECT question, date_diff('day', s, f) // 7 AS weeks FROM p WHERE s IS NOT NULL AND f >= s)
 SELECT question, count(*) AS titles, sum(weeks)::BIGINT AS weeks FROM w GROUP BY question""")
def titled_durations(src):
    return E.titled_total(E.titled_durations(src.sql(_TITLES)))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: len(w) > 1))"


@query("absent_terms", f"""WITH q AS (SELECT item_id AS query_id, unnest({_WORDS.format('text')}) AS term FROM benchmark), c AS (SELECT DISTINCT unnest({_WORDS.format('text')}) AS term FROM conversations)
 SELECT query_id, term FROM q WHERE term NOT IN (SELECT term FROM c)""")
def absent_terms(src):
    corpus = src.conversations.select(F.explode(tx.long_words(F.col("text"))).alias("term"))
    return E.missing_terms(src.benchmark.withColumnRenamed("item_id", "query_id"), corpus, F.array_distinct(tx.long_words(F.col("text"))))


def _mention_sql(text: str, ident: str, table: str) -> str:
    return " UNION ALL ".join(f"SELECT {ident} AS id, '{k}' AS kind, unnest(regexp_extract_all({text}, '{p}', 1)) AS raw_span FROM {table}" for k, p in E.MENTIONS.items())


@query("typed_mentions", f"SELECT id, kind, raw_span, count(*) AS n FROM ({_mention_sql('text', "'d' || doc_id", 'documents')} UNION ALL {_mention_sql('text', "'e' || event_id", '@notes')}) GROUP BY ALL")
def typed_mentions(src):
    texts = src.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(
        src.notes.select(F.concat(F.lit("e"), "event_id").alias("id"), "text"))
    return E.mentions(texts).groupBy("id", "kind", "raw_span").agg(F.count(F.lit(1)).alias("n"))


@query("mention_values", f"""WITH m AS ({_mention_sql('text', 'event_id', '@notes')}), j AS (SELECT m.*, CAST(epoch_ms(n.ts_us // 1000) AS DATE) AS day FROM m JOIN @notes n ON n.event_id = m.id)
 SELECT id, kind, raw_span, CASE kind WHEN 'currency' THEN CAST(replace(raw_span, ',', '')::DECIMAL(18, 4) * 100 AS BIGINT)
   WHEN 'duration' THEN CAST(regexp_extract(raw_span, '^[0-9.]+')::DECIMAL(18, 4) AS BIGINT) * CASE regexp_extract(raw_span, '[a-z]+') WHEN 'minutes' THEN 1 WHEN 'minute' THEN 1 WHEN 'hours' THEN 60 WHEN 'hour' THEN 60 WHEN 'days' THEN 1440 WHEN 'day' THEN 1440 ELSE 10080 END
   WHEN 'quantity' THEN CAST(regexp_extract(raw_span, '^[0-9.]+') AS BIGINT) END AS amount,
  CASE kind WHEN 'date_iso' THEN CAST(raw_span AS DATE) WHEN 'date_month' THEN make_date(year(day), 3, CAST(regexp_extract(raw_span, '[0-9]+') AS BIGINT))
   WHEN 'date_relative' THEN day - CAST(regexp_extract(raw_span, '^[0-9]+') AS INT) * CASE WHEN contains(raw_span, 'week') THEN 7 ELSE 1 END END AS event_date FROM j""")
def mention_values(src):
    notes = src.notes.select(F.col("event_id").alias("id"), "text", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts_us") / 86400000000).cast("int")).alias("day"))
    return E.mention_values(E.mentions(notes), F.col("day")).select("id", "kind", "raw_span", "amount", "event_date")


# --- lookups -------------------------------------------------------------------------------------------------------------
@query("exact_lookup", f"""WITH {_VERSIONS}, q AS (SELECT DISTINCT k AS query_id, 't' || (k % 25) AS name, CASE WHEN k % 2 = 0 THEN 'task' END AS want FROM @log),
 h AS (SELECT q.query_id, v.session, v.name, v.entity_type, v.valid_from, v.source_seq, row_number() OVER (PARTITION BY q.query_id ORDER BY v.valid_from DESC, v.session, v.entity_type, v.source_seq DESC) AS rank
  FROM q JOIN vers v ON v.name = q.name AND (q.want IS NULL OR q.want = v.entity_type) WHERE v.valid_to IS NULL)
 SELECT query_id, session, name, entity_type, valid_from, rank FROM h WHERE rank <= 10""")
def exact_lookup(src):
    asked = src.log.select(F.col("k").alias("query_id"), F.expr("'t' || (k % 25)").alias("name"), F.expr("CASE WHEN k % 2 = 0 THEN 'task' END").alias("entity_type")).distinct()
    return J.exact_lookup(asked, K.as_of(_history(src)), 10).select("query_id", "session", "name", "entity_type", "valid_from", "rank")


@query("hash_link_join", "SELECT session, seq, lag(seq) OVER (PARTITION BY session ORDER BY seq) AS previous_seq FROM @log")
def hash_link_join(src):
    from ..ordered import neighbour, slice_of
    log = neighbour(src.log.withColumn("_slice", slice_of("seq")), ["session"], ["seq"], F.col("hash"), "prev_hash")
    return J.previous_event(log).select("session", "seq", "previous_seq")


_CITES = """SELECT event_id, CASE WHEN k % 5 = 0 THEN 'none' ELSE 'see log://' || session || '/events/' || (seq + k % 2) || '#' || CASE WHEN k % 3 = 0 THEN hash ELSE substr(hash, 1, 12) END END AS citation FROM @log"""


@query("citation_resolution", """SELECT event_id, k % 5 <> 0 AND k % 2 = 0 AS resolved, CASE WHEN k % 5 <> 0 AND k % 2 = 0 THEN type END AS type FROM @log""")
def citation_resolution(src):
    return J.resolve_citations(src.sql(_CITES), src.log).select("event_id", "resolved", "type")


@query("trace_correlation", """WITH s AS (SELECT *, 'event:' || session || ':' || seq AS span, struct_pack(a := ts_us, b := session, c := seq) AS ord,
   last_value(CASE WHEN type = 'model.call.requested' THEN 'event:' || session || ':' || seq END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS model FROM @traced)
 SELECT model AS source, span AS target, CASE type WHEN 'tool.call.completed' THEN 'observed_tool_call' ELSE 'responded_with' END AS relation FROM s WHERE model IS NOT NULL AND type IN ('tool.call.completed', 'transcript.turn')
 UNION SELECT arg_max(m.span, m.ord), s.span, 'contains' FROM s JOIN s m ON m.type = 'coordination.mission.created' AND m.mission_id = s.mission_id AND m.ord < s.ord WHERE s.type <> 'coordination.mission.created' GROUP BY s.span
 UNION SELECT s.span, arg_max(f.span, f.ord), CASE s.type WHEN 'coordination.finding.reviewed' THEN 'reviews' ELSE 'promotes' END FROM s JOIN s f ON f.type = 'coordination.finding.reported' AND f.finding_id = s.finding_id AND f.ord < s.ord
  WHERE s.type IN ('coordination.finding.reviewed', 'coordination.finding.promoted') GROUP BY s.span, s.type""")
def trace_correlation(src):
    return J.trace_edges(src.traced)


@query("import_resolution", """WITH f AS (SELECT DISTINCT path FROM @code_files), i AS (SELECT line, replace(module, '.', '/') AS b FROM @code_imports)
 SELECT i.line, coalesce(a.path, b1.path, c.path, d.path) AS target_path, CASE WHEN a.path IS NOT NULL OR b1.path IS NOT NULL THEN 'module' WHEN c.path IS NOT NULL OR d.path IS NOT NULL THEN 'src_module' ELSE 'unresolved' END AS resolution
 FROM i LEFT JOIN f a ON a.path = i.b || '.py' LEFT JOIN f b1 ON b1.path = i.b || '/__init__.py' LEFT JOIN f c ON c.path = 'src/' || i.b || '.py' LEFT JOIN f d ON d.path = 'src/' || i.b || '/__init__.py'""")
def import_resolution(src):
    return J.resolve_imports(src.code_imports, src.code_files).select("line", "target_path", "resolution")


_CALLS = """WITH c AS (SELECT *, list_last(string_split(callee, '.')) AS short FROM @code_calls), s AS (SELECT path, name, min(qualified_name) AS qn FROM @code_symbols GROUP BY ALL),
 i AS (SELECT path, name, min(struct_pack(p := target_path, n := target_name)) AS t FROM @code_imported GROUP BY ALL)"""


@query("call_resolution", _CALLS + """ SELECT c.line, CASE WHEN s1.qn IS NOT NULL OR s2.qn IS NOT NULL THEN c.path ELSE coalesce(i1.t, i2.t).p END AS target_path, coalesce(s1.qn, s2.qn, coalesce(i1.t, i2.t).n) AS target_name,
 CASE WHEN s1.qn IS NOT NULL OR s2.qn IS NOT NULL THEN 'same_file_symbol' WHEN i1.t IS NOT NULL OR i2.t IS NOT NULL THEN 'imported_symbol' ELSE 'unresolved' END AS resolution FROM c
 LEFT JOIN s s1 ON s1.path = c.path AND s1.name = c.callee LEFT JOIN s s2 ON s2.path = c.path AND s2.name = c.short LEFT JOIN i i1 ON i1.path = c.path AND i1.name = c.callee LEFT JOIN i i2 ON i2.path = c.path AND i2.name = c.short""")
def call_resolution(src):
    return J.resolve_calls(src.code_calls, src.code_symbols, src.code_imported).select("line", "target_path", "target_name", "resolution")


@query("coverage_links", _CALLS + " SELECT DISTINCT c.path, x.target_path, x.target_name, c.line FROM c JOIN @code_imported x ON x.path = c.path AND x.name = c.short")
def coverage_links(src):
    return J.coverage_links(src.code_calls, src.code_imported)


_REFS = "SELECT 'ref' || (k % 30) AS name, event_id AS seq, session, seq AS target_seq, hash AS target_hash FROM @log WHERE type = 'signup'"


@query("named_refs", f"""WITH r AS (SELECT name, arg_max(struct_pack(s := session, t := target_seq, h := target_hash), seq) AS t FROM ({_REFS}) GROUP BY name) SELECT name, t.s AS session, t.t AS target_seq, t.h AS target_hash FROM r""")
def named_refs(src):
    return J.resolve_refs(src.sql(_REFS))


@query("events_at_ref", f"""WITH r AS (SELECT name, arg_max(struct_pack(s := session, t := target_seq), seq) AS t FROM ({_REFS}) GROUP BY name) SELECT r.name, l.session, l.seq, l.type FROM r JOIN @log l ON l.session = r.t.s AND l.seq <= r.t.t""")
def events_at_ref(src):
    return J.events_at_ref(src.log, J.resolve_refs(src.sql(_REFS))).select("name", "session", "seq", "type")


@query("alias_bridge", """WITH a AS (SELECT session, seq, CASE WHEN contains(text, 'my dog') THEN 'dog' ELSE 'cat' END AS target, regexp_extract(text, '(Rex\\d|Tom\\d)', 1) AS alias FROM @notes WHERE contains(text, 'my dog') OR contains(text, 'my cat')),
 f AS (SELECT session, target, alias, min(seq) AS seq FROM a GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session, target ORDER BY seq, alias) AS rn FROM f),
 n AS (SELECT session, target, string_agg(alias, ' ' ORDER BY rn) AS names FROM r WHERE rn <= 3 GROUP BY ALL), q AS (SELECT DISTINCT session, t.t AS target FROM @log, (VALUES ('dog'), ('cat')) t(t))
 SELECT q.session, 'what did my ' || q.target || ' eat' || coalesce(' ' || names, '') AS widened FROM q LEFT JOIN n ON n.session = q.session AND n.target = q.target""")
def alias_bridge(src):
    aliases = J.possessive_aliases(src.notes.select("session", "seq", "text"))
    asked = src.log.select("session").distinct().withColumn("query", F.explode(F.array(F.lit("what did my dog eat"), F.lit("what did my cat eat"))))
    return J.bridge_queries(asked, aliases).select("session", "widened")
