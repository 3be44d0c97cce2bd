"""Event-log scans, ingestion and sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical_json, looks_secret, redact_json, redact_text
from ..ordered import neighbour, row_numbers, slice_of, top_k
from ..session import cut

# One schema covers both envelopes; nested objects stay JSON text until a rule asks for them.
RECORD = T.StructType([
    *[T.StructField(n, T.StringType()) for n in (
        "timestamp", "type", "actor", "thread", "payload", "prev_hash", "hash", "id", "parent_event_id", "actorId", "threadId",
        "parentEventId", "_corrupt_record")],
    T.StructField("seq", T.LongType()),
    T.StructField("caused_by", T.ArrayType(T.StringType())), T.StructField("causedBy", T.ArrayType(T.StringType())),
    T.StructField("security", T.StructType([T.StructField("sensitivity", T.StringType()),
                                            T.StructField("redacted_paths", T.ArrayType(T.StringType()))])),
    T.StructField("integrity", T.StructType([T.StructField("hash", T.StringType()), T.StructField("previousHash", T.StringType())])),
])
SESSION_ID = r"^[A-Za-z0-9_.-]{1,128}$"


def normalise(raw: DataFrame) -> DataFrame:
    v1 = F.col("integrity").isNotNull() & F.col("actorId").isNotNull()
    bare = lambda c: F.regexp_replace(c, "^sha256:", "")
    id_seq = F.regexp_extract("id", r"^evt_[a-z]+_(\d{12})_[a-f0-9]{16}$", 1)
    return raw.select(
        F.regexp_extract(F.col("_file"), r"([^/]+)\.[A-Za-z]+$", 1).alias("session"), "_file", "_block", "_row",
        F.when(v1, F.when(id_seq != "", id_seq.cast("bigint"))).otherwise(F.col("seq")).alias("seq"),
        "timestamp", F.unix_micros(F.try_to_timestamp("timestamp")).alias("ts_us"), "type",
        F.coalesce("actorId", "actor").alias("actor"), F.coalesce("threadId", "thread", F.lit("default")).alias("thread"),
        "payload", "security", bare(F.coalesce(F.col("integrity.previousHash"), "prev_hash")).alias("prev_hash"),
        bare(F.coalesce(F.col("integrity.hash"), "hash")).alias("hash"), "id",
        F.coalesce("parentEventId", "parent_event_id").alias("parent_id"),
        F.coalesce("causedBy", "caused_by", F.array().cast("array<string>")).alias("caused_by"),
        F.when(v1, "v1").otherwise("legacy").alias("envelope"), "_corrupt_record")


def read_log(spark: SparkSession, path: str, line_order: bool = False) -> DataFrame:
    """JSONL logs of either envelope, one session per file, as one row shape; bad lines keep `_corrupt_record`.

    With `line_order`, rows without their own seq get their line position in the file.
    """
    raw = (
        spark.read.schema(RECORD).json(path)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
        .withColumn("_row", F.monotonically_increasing_id()))
    rows = normalise(raw)
    if line_order:
        rows = row_numbers(rows, ["_file"], ["_block", "_row"], out="_line")
        rows = rows.withColumn("seq", F.coalesce("seq", "_line")).drop("_line")
    return rows.drop("_block", "_row", "_file")


def valid_and_rejected(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split rows into those within the envelope's bounds and rejects with the reason."""
    reason = (
        F.when(F.col("_corrupt_record").isNotNull(), "not_json")
        .when(~F.col("session").rlike(SESSION_ID), "session_id")
        .when(F.col("seq").isNull() | (F.col("seq") < 1), "seq")
        .when(F.col("ts_us").isNull(), "timestamp")
        .when(F.coalesce(F.length(F.trim("type")), F.lit(0)) == 0, "type"))
    judged = log.withColumn("reject_reason", reason)
    return judged.filter("reject_reason IS NULL").drop("reject_reason"), judged.filter("reject_reason IS NOT NULL")


def tail(log: DataFrame, n: int) -> DataFrame:
    """Last n events of each session, newest first by `rank`."""
    return top_k(log, ["session"], [F.desc("seq")], n)


def after_cursor(log: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows after each session's cursor (session, cursor), and the new cursors."""
    rows = log.join(cursors, "session", "left").filter(F.col("seq") > F.coalesce("cursor", F.lit(0))).drop("cursor")
    moved = (rows.groupBy("session").agg(F.max("seq").alias("_new")).join(cursors, "session", "full")
             .select("session", F.coalesce("_new", "cursor").alias("cursor")))
    return rows, moved


def replay(log: DataFrame, from_seq: int = 1, to_seq: int | None = None) -> DataFrame:
    out = log.filter(F.col("seq") >= from_seq)
    return out if to_seq is None else out.filter(F.col("seq") <= to_seq)


# ---------------------------------------------------------------------------------------------------------------------
# seal and verify

def row_digest(session="session", seq="seq", ts="ts_us", kind="type", payload="payload") -> Column:
    """Content digest of a row in the declared canonical form."""
    return F.sha2(F.concat_ws("|", session, F.col(seq).cast("string"), F.col(ts).cast("string"), kind, payload), 256)


def link(prev: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(prev, F.lit("")), digest), 256)


def redact_batch(batch: DataFrame) -> DataFrame:
    """Payloads with secrets replaced, their class, redacted paths, and whether they are not JSON."""
    safe = redact_json(F.col("payload"))
    return batch.withColumn("_safe", safe).withColumns({
        "payload": F.col("_safe.payload"), "sensitivity": F.col("_safe.sensitivity"),
        "redacted_paths": F.col("_safe.redacted_paths"), "malformed": F.col("_safe.malformed")}).drop("_safe")


def _chain_slice(pdf: pd.DataFrame) -> pd.DataFrame:
    import hashlib
    pdf = pdf.sort_values("seq")
    prev = pdf["tip"].iloc[0] or ""
    before, sealed = [], []
    for digest in pdf["digest"]:
        before.append(prev or None)
        prev = hashlib.sha256(f"{prev}|{digest}".encode()).hexdigest()
        sealed.append(prev)
    return pd.DataFrame({"session": pdf["session"], "seq": pdf["seq"], "prev_hash": before, "hash": sealed})


def seal(batch: DataFrame, tips: DataFrame | None = None, width: int = 1 << 16) -> DataFrame:
    """Link a batch into each session's hash chain: adds `prev_hash` and `hash`.

    `batch` carries gap-free seq and `digest`; `tips` gives (session, tip) of already sealed rows.  A chain is
    sequential inside a session, so sessions run in parallel and a long session runs in rounds of `width`
    rows: no group ever holds more than one slice, and only tips pass between rounds.
    """
    spark = batch.sparkSession
    rows = batch.select("session", "seq", "digest").withColumn("_slice", slice_of("seq", width))
    bounds = rows.agg(F.min("_slice"), F.max("_slice")).first()
    schema = "session string, seq bigint, prev_hash string, hash string"
    tips = tips if tips is not None else spark.createDataFrame([], "session string, tip string")
    if bounds[0] is None:
        return batch.withColumns({"prev_hash": F.lit(None).cast("string"), "hash": F.lit(None).cast("string")})
    sealed: DataFrame | None = None
    for index in range(bounds[0], bounds[1] + 1):
        part = rows.filter(F.col("_slice") == index).join(tips, "session", "left")
        done = part.groupBy("session").applyInPandas(_chain_slice, schema)
        if bounds[1] > bounds[0]:
            done = cut(done)
            ends = done.groupBy("session").agg(F.max_by("hash", "seq").alias("_end"))
            tips = cut(tips.join(ends, "session", "full").select("session", F.coalesce("_end", "tip").alias("tip")))
        sealed = done if sealed is None else sealed.unionByName(done)
    return batch.join(sealed, ["session", "seq"])


def verify_chain(rows: DataFrame, sealed_ok: Column, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """First break per session by sequence, seal, genesis and link checks; every row is checked in parallel."""
    checked = neighbour(rows.withColumn("_ok", sealed_ok).withColumn("_slice", slice_of("seq")), ["session"], list(order),
                        F.struct("seq", "hash"), "_before")
    expected = F.coalesce(F.col("_before.seq"), F.lit(0)) + 1
    seq = F.col("seq").cast("string")
    reason = (
        F.when(F.col("seq") != expected, F.concat(F.lit("Event sequence expected "), expected.cast("string"), F.lit(" but found "), seq))
        .when(~F.coalesce("_ok", F.lit(False)), F.concat(F.lit("Event "), seq, F.lit(" hash mismatch")))
        .when((expected == 1) & F.col("prev_hash").isNotNull(), "First event has prev_hash set")
        .when((expected > 1) & ~F.col("prev_hash").eqNullSafe(F.col("_before.hash")),
              F.concat(F.lit("Event "), seq, F.lit(" prev_hash does not link to previous"))))
    checked = checked.withColumn("_reason", reason)
    first = F.min(F.when(F.col("_reason").isNotNull(), F.struct("seq", "_reason")))
    return checked.groupBy("session").agg(F.count(F.lit(1)).alias("total"), first.alias("_break")).select(
        "session", F.col("_break").isNull().alias("ok"), "total", F.col("_break.seq").alias("broken_at_seq"),
        F.col("_break._reason").alias("reason"))


def foreign_seal_ok() -> Column:
    """Seal check of foreign logs: SHA-256 of the envelope's canonical JSON (sorted keys, no blanks)."""
    q = lambda name: F.to_json(F.struct(F.col(name).alias("v")), {"ignoreNullFields": "false"})
    text = lambda name: F.regexp_extract(q(name), r'(?s)^\{"v":(.*)\}$', 1)
    security = F.when(F.col("security").isNotNull(), F.concat(F.lit(',"security":'), F.to_json("security")))
    legacy = F.concat(
        F.lit('{"actor":'), text("actor"), F.lit(',"payload":'), F.col("payload"), F.lit(',"prev_hash":'), text("prev_hash"),
        F.coalesce(security, F.lit("")), F.lit(',"seq":'), F.col("seq").cast("string"), F.lit(',"thread":'), text("thread"),
        F.lit(',"timestamp":'), text("timestamp"), F.lit(',"type":'), text("type"), F.lit("}"))
    prefixed = F.when(F.col("prev_hash").isNotNull(), F.concat(F.lit('"sha256:'), "prev_hash", F.lit('"'))).otherwise(F.lit("null"))
    v1 = F.concat(
        F.lit('{"event":{"actorId":'), text("actor"), F.lit(',"causedBy":'), F.to_json("caused_by"), F.lit(',"id":'), text("id"),
        F.lit(',"parentEventId":'), text("parent_id"), F.lit(',"payload":'), F.col("payload"), F.lit(',"threadId":'), text("thread"),
        F.lit(',"timestamp":'), text("timestamp"), F.lit(',"type":'), text("type"), F.lit('},"previousHash":'), prefixed, F.lit("}"))
    return F.sha2(canonical_json(F.when(F.col("envelope") == "v1", v1).otherwise(legacy)), 256) == F.col("hash")


# ---------------------------------------------------------------------------------------------------------------------
# ingestion

def document_chunks(docs: DataFrame, path: Column, text: Column, max_lines: int = 80) -> DataFrame:
    """Blocks of `max_lines` lines with their line range and the whole text's SHA-256; blank blocks are dropped."""
    lines = F.split(F.regexp_replace(text, r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / max_lines).cast("int")),
                         lambda i: F.struct((i * max_lines + 1).alias("start_line"),
                                            F.slice("_lines", i * max_lines + 1, max_lines).alias("part")))
    return (
        docs.select("*", path.alias("path"), F.sha2(text, 256).alias("sha256"), lines.alias("_lines"))
        .withColumn("_b", F.explode(blocks))
        .select(*[c for c in docs.columns if c != "path"], "path", "sha256", F.col("_b.start_line").alias("start_line"),
                (F.col("_b.start_line") + F.size("_b.part") - 1).alias("end_line"),
                F.array_join("_b.part", "\n").alias("content"))
        .filter(F.trim("content").rlike(r"\S")))


def transcript_events(turns: DataFrame) -> DataFrame:
    """Conversation turns as log events with withheld secrets."""
    return turns.select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("session"), (F.col("turn") + 1).alias("seq"),
        F.lit("transcript.turn").alias("type"), F.col("role").alias("actor"), F.col("turn").alias("turn_index"),
        redact_text(F.col("text")).alias("content"),
        F.when(looks_secret(F.col("text")), "restricted").otherwise("public").alias("sensitivity"))


def refresh_plan(current: DataFrame, previous: DataFrame, transform_changed: Column | bool = False) -> DataFrame:
    """Compare fingerprints (path, sha256): one row per path with its status, reason and follow-up events."""
    both = current.select("path", F.col("sha256").alias("sha256")).join(
        previous.select("path", F.col("sha256").alias("previous_sha256")), "path", "full")
    changed = transform_changed if isinstance(transform_changed, Column) else F.lit(transform_changed)
    moved = F.col("sha256") != F.col("previous_sha256")
    status = (F.when(F.col("previous_sha256").isNull(), "discovered").when(F.col("sha256").isNull(), "deleted")
              .when(moved | changed, "changed").otherwise("unchanged"))
    reason = (F.when(F.col("status") == "deleted", "source_deleted")
              .when((F.col("status") == "changed") & moved, "source_changed").when(F.col("status") == "changed", "transform_changed"))
    return both.withColumn("status", status).select(
        "path", "status", reason.alias("reason"), F.concat(F.lit("source."), "status").alias("source_event"),
        F.col("status").isin("changed", "deleted").alias("retire"), F.col("status").isin("changed", "discovered").alias("index"),
        "sha256", "previous_sha256")


_PACKET = ("session_id string, provider_path string, model string, status_code string, "
           "request struct<body: struct<messages: array<struct<role:string,content:string>>, input: string>>, "
           "response struct<body: struct<choices: array<struct<message:struct<content:string>,delta:struct<content:string>>>, "
           "output_text: string, bytes: bigint>>")


def _excerpt(text: Column, limit: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("...")))


def packet_summaries(events: DataFrame, limit: int = 240) -> DataFrame:
    """Model, status, last user message and first assistant message of request/response packets."""
    p = F.from_json("payload", _PACKET)
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    user = F.element_at(F.filter(F.col("p.request.body.messages"), lambda m: (m["role"] == "user") & filled(m["content"]).isNotNull()), -1)
    replies = F.filter(F.transform(F.col("p.response.body.choices"),
                                   lambda c: F.coalesce(filled(c["message"]["content"]), filled(c["delta"]["content"]))),
                       lambda t: t.isNotNull())
    rows = events.withColumn("p", p).select(
        F.coalesce(filled(F.col("p.session_id")), "session").alias("session"), F.col("seq").alias("source_seq"),
        F.col("hash").alias("source_hash"), F.coalesce(filled(F.col("p.provider_path")), F.lit("unknown-provider-path")).alias("provider_path"),
        F.coalesce(F.col("p.status_code").try_cast("int"), F.lit(0)).alias("status_code"), filled(F.col("p.model")).alias("model"),
        F.size("p.request.body.messages").alias("message_count"),
        _excerpt(F.coalesce(user["content"], filled(F.col("p.request.body.input"))), limit).alias("request_text"),
        _excerpt(F.coalesce(F.get(replies, F.lit(0)), filled(F.col("p.response.body.output_text"))), limit).alias("response_text"))
    summary = F.concat_ws(
        " ", F.concat(F.lit("LLM packet "), "provider_path", F.coalesce(F.concat(F.lit(" "), "model"), F.lit("")), F.lit(" status "),
                      F.col("status_code").cast("string"), F.lit(".")),
        F.concat(F.lit("User: "), "request_text"), F.concat(F.lit("Assistant: "), "response_text"))
    return rows.withColumn("summary", summary)


def paired_tool_calls(records: DataFrame, seen_refs: DataFrame | None = None) -> DataFrame:
    """Pair tool_use with tool_result by (session, call_id); rows whose ref was captured before are left out.

    Records: session, line, kind, call_id, name, content, is_error, ref.
    """
    uses = records.filter("kind = 'tool_use'").select("session", "call_id", F.col("line").alias("use_line"), "name")
    results = records.filter("kind = 'tool_result'").select(
        "session", "call_id", F.col("line").alias("result_line"), "content", "is_error", "ref")
    if seen_refs is not None:
        results = results.join(seen_refs.select("ref"), "ref", "left_anti")
    pairs = results.join(uses, ["session", "call_id"], "left")
    return pairs.select(
        "session", "call_id", "ref", F.coalesce("name", F.lit("tool")).alias("tool_name"), "use_line", "result_line",
        F.when(F.col("is_error") == 1, "failed").otherwise("succeeded").alias("status"), F.col("content").alias("result_summary"))


# ---------------------------------------------------------------------------------------------------------------------
# sinks and status

def export_view(events: DataFrame, entity_rows: DataFrame, edge_rows: DataFrame, *, since_seq: int | None = None,
                max_seq: int | None = None, kinds: list[str] | None = None, grains: tuple[str, ...] = ("event", "entity", "edge"),
                since_us: int | None = None, until_us: int | None = None, exclude_sensitivities: tuple[str, ...] = ()) -> DataFrame:
    """Events, entities and edges in one canonical entry shape with a content digest as entry id."""
    if exclude_sensitivities:
        events = events.filter(~F.col("sensitivity").isin(*exclude_sensitivities))
    parts = {
        "event": events.select("session", F.lit("event").alias("grain"), F.col("type").alias("kind"), F.col("payload").alias("content"),
                               "seq", F.col("ts_us").alias("valid_from")),
        "entity": entity_rows.select("session", F.lit("entity").alias("grain"), F.concat(F.lit("entity:"), "entity_type").alias("kind"),
                                     F.concat_ws("|", "name", "summary", "props_text").alias("content"),
                                     F.col("source_seq").alias("seq"), "valid_from"),
        "edge": edge_rows.select("session", F.lit("edge").alias("grain"), F.concat(F.lit("edge:"), "relation").alias("kind"),
                                 F.concat_ws("|", "source", "relation", "target").alias("content"),
                                 F.col("source_seq").alias("seq"), "valid_from"),
    }
    out = None
    for grain in grains:
        out = parts[grain] if out is None else out.unionByName(parts[grain])
    for bound, test in ((since_seq, F.col("seq") > F.lit(since_seq)), (max_seq, F.col("seq") <= F.lit(max_seq)),
                        (since_us, F.col("valid_from") >= F.lit(since_us)), (until_us, F.col("valid_from") <= F.lit(until_us))):
        if bound is not None:
            out = out.filter(test)
    if kinds is not None:
        out = out.filter(F.col("kind").isin(*kinds))
    entry = F.sha2(F.concat_ws("|", "session", "grain", "kind", "content", F.col("seq").cast("string")), 256)
    return out.withColumn("entry_id", entry)


def export_cursor(entries: DataFrame) -> DataFrame:
    return entries.groupBy("session").agg(F.max("seq").alias("since_seq"))


def log_status(log: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Per session: events, last seq, hash and time, and the integrity verdict if given."""
    out = log.groupBy("session").agg(
        F.count(F.lit(1)).alias("events"), F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("last_hash"),
        F.max("ts_us").alias("last_ts_us"))
    return out if verdicts is None else out.join(verdicts.select("session", "ok", "reason"), "session", "left")
