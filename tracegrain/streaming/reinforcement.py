"""Deferred reinforcement: feedback on a target is collected, coalesced and handed on after a delay.

The queue is a stateful stream keyed by target.  State holds one row per target and delay window: how often each kind came, the total
weight, the first and the last moment; its size follows the targets in the open windows, not the events.  A timer at the end of the window, in event
time, hands the row on and frees it.  What belongs together depends on the rows alone, so any division into micro-batches gives the rows of
the batch form (`coalesced`).

`deliver` writes each micro-batch under its own id.  A batch that the sink did not take is not committed: its state and its rows come again
when the stream is started anew, and a batch that was taken but not committed replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

KINDS = ("surfaced", "confirmed", "promoted", "invalidated")
OUT = "target string, window_ms bigint, " + ", ".join(f"{k} bigint" for k in KINDS) + ", weight double, first_ms bigint, last_ms bigint"


def _window(ts_ms: Column, delay_ms: int) -> Column:
    return ts_ms - F.pmod(ts_ms, F.lit(delay_ms))


def coalesced(feedback: DataFrame, delay_ms: int) -> DataFrame:
    """One row per target and window of `delay_ms`; feedback: target, kind, weight (null: 1), ts."""
    ms = F.unix_millis("ts")
    return feedback.groupBy("target", _window(ms, delay_ms).alias("window_ms")).agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS], F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"),
        F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))


class Queue(StatefulProcessor):
    """Holds the open windows of a target until their timers end them."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "window_ms bigint", ", ".join(f"{k} bigint" for k in KINDS) + ", weight double, first_ms bigint, last_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, late = timerValues.getCurrentWatermarkInMs(), []
        for pdf in rows:
            for window, own in pdf.groupby("window_ms"):
                held = self.open.getValue((int(window),)) if self.open.containsKey((int(window),)) else None
                counts = [int((own["kind"] == k).sum()) + (held[i] if held else 0) for i, k in enumerate(KINDS)]
                weight, first, last = float(own["weight"].sum()), int(own["ms"].min()), int(own["ms"].max())
                row = (*counts, weight + held[4], min(first, held[5]), max(last, held[6])) if held else (*counts, weight, first, last)
                if window + self.delay_ms <= watermark:  # its time is over: handed on at once
                    late.append((key[0], int(window), *row))
                else:
                    self.open.updateValue((int(window),), row)
                    self.handle.registerTimer(int(window) + self.delay_ms)
        if late:
            yield self._rows(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        window = expiredTimerInfo.getExpiryTimeInMs() - self.delay_ms
        if self.open.containsKey((window,)):
            row = self.open.getValue((window,))
            self.open.removeKey((window,))
            yield self._rows([(key[0], window, *row)])

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["target", "window_ms", *KINDS, "weight", "first_ms", "last_ms"])

    def close(self) -> None:
        pass


def deferred(feedback: DataFrame, delay_ms: int, watermark: str = "0 seconds") -> DataFrame:
    """The stream of coalesced rows; needs the RocksDB state store.  Rows later than `watermark` are dropped by it."""
    ms = F.unix_millis("ts")
    rows = feedback.withWatermark("ts", watermark).select(
        "target", "ts", "kind", F.coalesce("weight", F.lit(1.0)).alias("weight"), ms.alias("ms"), _window(ms, delay_ms).alias("window_ms"))
    return rows.groupBy("target").transformWithStateInPandas(Queue(delay_ms), OUT, "Append", "EventTime")


def deliver(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Hands every micro-batch to `sink(rows, batch_id)`; one that raises is handed over again at the next start."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
