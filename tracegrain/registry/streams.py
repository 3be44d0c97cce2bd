"""Streams over files written from the driver tables, drained to the end and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import discard, shared_folder, stored
from ..sources import log_source as S
from ..sources import logs as L
from ..streaming import jobs as J
from ..streaming import reinforcement as Q
from . import facts as registered_facts
from .base import query
from .logs import packets

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folders(src, *names):
    return [shared_folder(src.spark, n) for n in names]


def _files(src, rows, n=3):
    """`rows` as n appended sets of files, and a stream that takes set by set; the rows are made once, by all tasks."""
    path, files = shared_folder(src.spark, "stream-input"), [0]
    dealt = stored(rows.withColumn("_set", F.pmod(F.xxhash64(*rows.columns), F.lit(n))), "stream-rows")
    for part in range(n):
        dealt.filter(F.col("_set") == part).drop("_set").write.mode("append").parquet(path)
        files.append(len(src.spark.read.schema(rows.schema).parquet(path).inputFiles()))
    discard(dealt)
    most = max(b - a for a, b in zip(files, files[1:], strict=False))
    return src.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", most).parquet(path)


def _envelopes(log):
    """Lines of both envelopes, by turns; the session travels as the thread."""
    stamp = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    legacy = F.to_json(F.struct("seq", stamp.alias("timestamp"), "type", "actor", F.col("session").alias("thread"), "payload", "hash"))
    evt = F.concat(F.lit("evt_app_"), F.lpad(F.col("seq").cast("string"), 12, "0"), F.lit("_"), F.substring("hash", 1, 16))
    v1 = F.to_json(F.struct(evt.alias("id"), stamp.alias("timestamp"), "type", F.col("actor").alias("actorId"), F.col("session").alias("threadId"), "payload",
                            F.struct(F.concat(F.lit("sha256:"), "hash").alias("hash")).alias("integrity")))
    return log.select(F.when(F.col("event_id") % 2 == 0, legacy).otherwise(v1).alias("value"))


def _read(rows):
    return rows.select(F.col("thread").alias("session"), "seq", "ts_us", "type", "actor", "hash", "envelope")


_LINES = "SELECT session, seq, ts_us, type, actor, hash, CASE WHEN event_id % 2 = 0 THEN 'legacy' ELSE 'v1' END AS envelope FROM @log"


@query("log_source_scan", _LINES)
def log_source_scan(src):
    path = shared_folder(src.spark, "log-files")
    _envelopes(src.log).write.mode("overwrite").option("compression", "none").text(path)
    return _read(S.events(S.lines(src.spark, path, suffix=".txt", rangebytes=100_000)))


@query("log_source_resume", _LINES)
def log_source_resume(src):
    path, out, mark = _folders(src, "log-files", "log-rows", "log-offsets")
    for turn in range(2):  # the second run starts at the bytes where the first one ended
        _envelopes(src.log.filter(F.col("cents") % 2 == turn)).write.mode("append").option("compression", "none").text(path)
        stream = S.lines(src.spark, path, stream=True, suffix=".txt", rangebytes=100_000)
        J.append_batches(stream, lambda batch: _read(S.events(batch)), out, mark).awaitTermination()
    return src.spark.read.parquet(out).drop("batch_id")


@query("stream_projection", f"SELECT session, seq, name, entity_type, summary FROM ({registered_facts._ENTITIES})")
def stream_projection(src):
    out, mark = _folders(src, "projected", "projection-offsets")
    J.project_events(_files(src, src.mlog), out, mark).awaitTermination()
    return src.spark.read.parquet(out).select("session", "seq", "name", "entity_type", "summary")


@query("stream_chain_verification", """SELECT session, seq, CASE WHEN event_id % 97 = 0 THEN 'hash mismatch' ELSE 'verified' END AS verdict FROM @log""")
def stream_chain_verification(src):
    src.spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    sealed = L.seal(src.log.withColumn("digest", L.row_digest()).drop("hash"))
    ok = (L.link(F.col("prev_hash"), F.col("digest")) == F.col("hash")) & (F.col("event_id") % 97 != 0)
    out, mark = _folders(src, "verdicts", "verdict-offsets")
    J.append_batches(J.verify_stream(_files(src, sealed.select("session", "seq", "hash", "prev_hash", ok.alias("seal_ok")))), lambda b: b, out, mark).awaitTermination()
    return src.spark.read.parquet(out).select("session", "seq", "verdict")


@query("stream_packet_watch", "SELECT 'conv' || conv_id AS session, turn + 1 AS source_seq, CASE WHEN turn % 5 = 4 THEN 500 ELSE 200 END AS status_code FROM conversations WHERE role = 'user'")
def stream_packet_watch(src):
    out, mark = _folders(src, "summaries", "summary-offsets")
    J.watch_packets(_files(src, packets(src)), out, mark).awaitTermination()
    return src.spark.read.parquet(out).select("session", "source_seq", "status_code")


@query("stream_idempotent_append", "SELECT event_id, session FROM @log")
def stream_idempotent_append(src):
    src.spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = src.log.select("event_id", "session", F.timestamp_micros("ts_us").alias("ts"))
    twice = rows.withColumn("sent", F.lit(1)).unionByName(rows.withColumn("sent", F.lit(2)))
    out, mark = _folders(src, "appended", "append-offsets")
    J.append_batches(J.idempotent(_files(src, twice), "event_id", "3650 days"), lambda b: b, out, mark).awaitTermination()
    return src.spark.read.parquet(out).select("event_id", "session")


_DELAY_MS = 6 * 3600 * 1000


@query("deferred_reinforcement", f"""SELECT 'm' || target AS target, w AS window_ms, count(*) FILTER (WHERE kind = 'surfaced') AS surfaced, count(*) FILTER (WHERE kind = 'confirmed') AS confirmed,
 count(*) FILTER (WHERE kind = 'promoted') AS promoted, count(*) FILTER (WHERE kind = 'invalidated') AS invalidated, count(*)::DOUBLE AS weight, min(ms) AS first_ms, max(ms) AS last_ms
 FROM (SELECT target, kind, ts_us // 1000 AS ms, ts_us // 1000 - (ts_us // 1000) % {_DELAY_MS} AS w FROM @reinforcements) GROUP BY target, w""")
def deferred_reinforcement(src):
    src.spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = src.reinforcements.select(F.concat(F.lit("m"), F.col("target").cast("string")).alias("target"), "kind", "weight", F.timestamp_micros("ts_us").alias("ts"))
    # one row of a target of its own, long after, moves the watermark past all windows
    last = rows.agg(F.lit("end").alias("target"), F.lit("surfaced").alias("kind"), F.lit(1.0).alias("weight"), (F.max("ts") + F.expr("interval 3650 days")).alias("ts"))
    path, out, mark = _folders(src, "feedback", "reinforced", "feedback-offsets")

    def run():
        stream = src.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
        Q.deliver(Q.deferred(stream, _DELAY_MS, "3650 days"), lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch_id={i}"), mark).awaitTermination()

    for part in (0, 1):
        rows.filter(F.pmod(F.xxhash64("target", "ts"), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(path)
    run()
    last.withColumn("ts", F.col("ts") + F.expr("interval 3650 days")).coalesce(1).write.mode("append").parquet(path)
    run()
    return src.spark.read.parquet(out).filter("target <> 'end'").drop("batch_id")
