"""Source-preserving compaction: identities, safety audit, exemplar projection and its search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import long_words
from ..ordered import top_k
from ..session import cut
from .vectors import hash_embedding, k_centres, mean_distance

IDENTITY = r"\b(?:identity|doc|decision|task|user|goal)-code-\d{4}\b"
# payload keys that name durable things, in order (fixed values)
NAMED_KEYS = ("taskId", "userId", "goalTitle", "title", "mission_id", "worker_id", "finding_id", "claim_key", "claim_value")


def citation() -> Column:
    return F.format_string("log://%s/events/%d#%s", F.col("session"), F.col("seq"), F.substring("hash", 1, 12))


def event_identities(events: DataFrame) -> DataFrame:
    """Events with `identities`: citation, path with lines, source turn, named keys and ids in the text."""
    p = F.from_json("payload", "map<string,string>")
    rows = events.withColumn("_p", F.coalesce(p, F.create_map().cast("map<string,string>")))
    text = lambda k: F.nullif(F.trim(F.col("_p")[k]), F.lit(""))
    number = lambda k: text(k).try_cast("bigint")
    lines = F.concat(text("path"), F.lit(":"), number("start_line").cast("string"), F.lit("-"), number("end_line").cast("string"))
    turn = F.concat(text("source"), F.lit(":turn-"), number("turn_index").cast("string"))
    plain_source = F.when(~F.startswith(F.coalesce(text("source"), F.lit("")), F.lit("{")), text("source"))
    content = F.concat_ws(" ", text("content"), text("summary"), text("description"))
    fixed = F.array_compact(F.array(citation(), F.coalesce(lines, text("path")), F.coalesce(turn, plain_source), *[text(k) for k in NAMED_KEYS]))
    found = F.regexp_extract_all(content, F.lit(IDENTITY), 0)
    context = F.concat_ws(" ", "type", text("content"), text("summary"))
    cited = (F.when(F.col("type") == "document.indexed", text("path").isNotNull())
             .when(F.col("type") == "transcript.turn", text("source").isNotNull() & number("turn_index").isNotNull()).otherwise(F.lit(True)))
    return rows.withColumns({"identities": F.array_distinct(F.concat(fixed, found)), "context": context, "cited": cited}).drop("_p")


def identity_rows(events: DataFrame) -> DataFrame:
    """session, seq, identity: a row for each identity of an event."""
    # a plain explode would be preceded by a filter on the size of `identities`, in which each use of the payload parses it anew
    rows = event_identities(events).select("session", "seq", F.explode_outer("identities").alias("identity"))
    return rows.filter("identity IS NOT NULL")


def audit(events: DataFrame, verdicts: DataFrame | None = None, recall_floor: float = 1.0, coverage_floor: float = 1.0, dim: int = 64) -> DataFrame:
    """Per session: would one representative keep every identity, and how spread are the events?

    Identity hits are an equi join of distinct identities with the session's one representative text; the
    spread uses the sum of unit vectors instead of event pairs.
    """
    # read four times, and the vectors repeat the text many times over, so its expressions are worked out once
    rows = cut(event_identities(events).select("session", "seq", "identities", "context", "cited"))
    first = rows.groupBy("session").agg(F.min_by(F.struct("context", "identities"), "seq").alias("r")).select(
        "session", F.lower(F.concat(F.col("r.context"), F.lit("\n"), F.array_join("r.identities", "\n"))).alias("_rep"))
    named = rows.select("session", F.explode("identities").alias("identity")).distinct().join(first, "session")
    recall = named.groupBy("session").agg(F.count(F.lit(1)).alias("identities"), F.count_if(F.contains("_rep", F.lower("identity"))).alias("kept"))
    base = rows.groupBy("session").agg(F.count(F.lit(1)).alias("events"), F.round(F.avg(F.col("cited").cast("int")), 4).alias("citation_coverage"))
    texts = rows.select("session", F.struct("session", "seq").alias("vec_id"), "context")
    vectors = hash_embedding(texts, "vec_id", F.col("context"), dim, unique=True).select(F.col("vec_id.session").alias("session"), "vec_id", "vector")
    out = base.join(recall, "session").join(mean_distance(vectors, "session").select("session", "spread"), "session")
    out = out.withColumn("identity_recall", F.round(F.col("kept") / F.col("identities"), 4))
    intact = F.lit(True)
    if verdicts is not None:
        out = out.join(verdicts.select("session", F.col("ok").alias("_ok")), "session", "left")
        intact = F.coalesce("_ok", F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(~intact, "integrity check failed"), F.when(F.col("identity_recall") < recall_floor, f"identity recall below {recall_floor:.3f}"),
        F.when(F.col("citation_coverage") < coverage_floor, f"citation coverage below {coverage_floor:.3f}")))
    return out.withColumn("unsafe_reasons", F.array_join(reasons, "; ")).withColumn("safe", F.size(reasons) == 0).drop("_ok")


def projection(events: DataFrame, records: int, dim: int = 64) -> DataFrame:
    """Exemplar records per session with their text, identities and citation."""
    rows = event_identities(events)
    vectors = hash_embedding(rows.select(F.struct("session", "seq").alias("key"), "context"), "key", F.col("context"), dim, unique=True).select(
        F.col("key.session").alias("session"), F.col("key.seq").alias("vec_id"), "vector")
    chosen = k_centres(vectors, "session", records).withColumnRenamed("vec_id", "seq")
    return chosen.join(rows.select("session", "seq", "context", "identities", citation().alias("citation")), ["session", "seq"])


def search(records: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Records ranked by the share of query words they hold (queries: query, text)."""
    words = F.array_distinct(long_words(F.concat_ws(" ", "context", F.array_join("identities", " "))))
    post = records.select("session", "seq", "citation", F.explode(words).alias("w"))
    asked = queries.withColumn("_q", F.array_distinct(long_words(F.col("text"))))
    terms = asked.select("query", F.size("_q").alias("_n"), F.explode("_q").alias("w"))
    hits = terms.join(post, "w").groupBy("query", "session", "seq", "citation").agg(F.round(F.count(F.lit(1)) / F.first("_n"), 4).alias("score"))
    return top_k(hits, ["query"], [F.desc("score"), F.col("session"), F.col("seq")], k)


# procedure statuses (fixed values)
APPLICABLE, DIAGNOSTIC = ("validated", "revised", "accepted"), ("proposed", "pending", "deferred")
EXCLUDED = ("rejected", "conflicted", "deprecated", "contradicted", "stale")


def classify_procedures(rows: DataFrame) -> DataFrame:
    """Bucket and reason per procedural row (status, stale, citation, valid_to, superseded_by)."""
    s = F.col("status")
    reason = (F.when(s.isin(*EXCLUDED), F.concat(s, F.lit("_status"))).when(F.col("stale"), "stale_flag")
              .when(F.coalesce("citation", F.lit("")) == "", "missing_citation").when(F.col("valid_to").isNotNull(), "valid_to_closed")
              .when(F.coalesce(F.trim("superseded_by"), F.lit("")) != "", "superseded")
              .when(~s.isin(*APPLICABLE, *DIAGNOSTIC), "unknown_status"))
    bucket = F.when(reason.isNotNull(), "excluded").when(s.isin(*DIAGNOSTIC), "diagnostic").otherwise("applicable")
    return rows.withColumns({"excluded_reason": reason, "bucket": bucket})


def evolution_gate(proposals: DataFrame, policy: DataFrame, default_threshold: float = 0.85) -> DataFrame:
    """auto_apply or requires_review per proposal (op, confidence) under its tier (policy: op, tier, threshold)."""
    rows = proposals.join(policy, "op", "left").withColumns({
        "tier": F.coalesce("tier", F.lit("propose_only")), "threshold": F.coalesce("threshold", F.lit(default_threshold))})
    auto = (F.col("tier") == "auto_with_rollback") & (F.col("confidence") >= F.col("threshold"))
    return rows.withColumn("decision", F.when(auto, "auto_apply").otherwise("requires_review"))


def deterministic_id(prefix: str, *parts: Column) -> Column:
    """Same content, same id: an append repeated is recognised."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))
