"""Structured Streaming forms of ingestion, verification, projection and counting."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import facts
from ..sources.logs import packet_summaries


def append_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each micro-batch's result under its own batch folder; a replayed batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def watch_packets(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Packet rows to compact summaries; the checkpoint is the remembered offset."""
    return append_batches(stream, packet_summaries, path, checkpoint, **trigger)


def project_events(stream: DataFrame, path: str, checkpoint: str, book: facts.RuleBook | None = None, **trigger) -> StreamingQuery:
    """Entity assertions of each sealed event, appended; `facts.versions` over the table gives the history."""
    return append_batches(stream, lambda batch: facts.entities(batch, book), path, checkpoint, **trigger)


WAIT_ROWS = 4096  # positions of a session that wait under one state key
HELD_ROWS = 1 << 18  # rows of a session in memory at once


class ChainVerifier(StatefulProcessor):
    """Verify a session's chain from its verified tip; rows ahead of the tip wait, rows behind it are late.

    Rows wait in runs of WAIT_ROWS positions, a state key each: every call to the state store is a round trip, so a batch makes a few for each run
    that it touches and none for a row by itself.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tip = handle.getValueState("tip", "seq long, hash string")
        self.waiting = handle.getMapState("waiting", "run long", "rows string")

    def _held(self, run: int) -> dict[int, list]:
        if not self.waiting.containsKey((run,)):
            return {}
        return {seq: rest for seq, *rest in json.loads(self.waiting.getValue((run,))[0])}

    def _keep(self, run: int, rows: dict[int, list]) -> None:
        self.waiting.updateValue((run,), (json.dumps([[seq, *rest] for seq, rest in rows.items()]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        verdicts = lambda out: pd.DataFrame(out, columns=["session", "seq", "verdict"])
        seq, tip = self.tip.get() if self.tip.exists() else (0, None)
        out, fresh, n = [], {}, 0
        for pdf in rows:
            for at, *rest in zip(pdf["seq"].tolist(), pdf["hash"], pdf["prev_hash"], map(bool, pdf["seal_ok"]), strict=True):
                if at <= seq:
                    out.append((key[0], at, "late"))
                else:
                    fresh.setdefault((at - 1) // WAIT_ROWS, {})[at] = rest
                    n += 1
            if n >= HELD_ROWS:
                for run, new in fresh.items():
                    self._keep(run, self._held(run) | new)
                fresh, n = {}, 0
        while True:
            run, start = seq // WAIT_ROWS, seq
            old = self._held(run)
            new = fresh.pop(run, {})
            ahead = old | new
            while (row := ahead.pop(seq + 1, None)) is not None:
                row_hash, prev, ok = row
                seq += 1
                good = ok and (prev is None if seq == 1 else prev == tip)
                out.append((key[0], seq, "verified" if good else ("hash mismatch" if not ok else "link broken")))
                tip = row_hash
            if ahead and (new or seq > start):
                self._keep(run, ahead)
            elif old and not ahead:
                self.waiting.removeKey((run,))
            if len(out) >= HELD_ROWS:
                yield verdicts(out)
                out = []
            if ahead or seq == start or seq % WAIT_ROWS:
                break
        for run, new in fresh.items():
            self._keep(run, self._held(run) | new)
        self.tip.update((seq, tip))
        if out:
            yield verdicts(out)

    def close(self) -> None:
        pass


def verify_stream(stream: DataFrame) -> DataFrame:
    """Verdict per event (session, seq, hash, prev_hash, seal_ok); needs the RocksDB state store."""
    return stream.groupBy("session").transformWithStateInPandas(
        ChainVerifier(), "session string, seq long, verdict string", "Update", "None")


def windowed_counts(events: DataFrame, kind: str, *keys: str, size: str = "1 day", slide: str = "6 hours", gap: str = "2 hours",
                    watermark: str | None = None) -> DataFrame:
    """Counts per tumbling, sliding or session window on `ts`; the same plan runs on a batch or a stream."""
    if watermark is not None:
        events = events.withWatermark("ts", watermark)
    frame: Column = {"tumbling": lambda: F.window("ts", size), "sliding": lambda: F.window("ts", size, slide),
                     "session": lambda: F.session_window("ts", gap)}[kind]()
    counted = events.groupBy(frame.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"), F.sum("cents").alias("cents"))
    return counted.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "cents")


def idempotent(events: DataFrame, key: str, watermark: str) -> DataFrame:
    """A row whose deterministic id came before within the watermark is dropped."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])
