"""Chat formatting from event logs (operator 7).

A conversation is a log of events.  `message` opens a message at position `msg` with a role; `delta` appends text; `edit` replaces the
text; `regenerate` discards the text, later deltas write the new one; `retract` takes the message out.  Logs are partitioned by
conversation and sorted by (position, tag, sequence), so the events of a message lie together, messages lie in order, and a task
folds a partition as a stream: it holds one message and one output segment, never a conversation, however long that is.

The template writes a turn as `### role:`, a line break, the text, `</turn>` and a line break.  Inside texts and roles a backslash
stands before every backslash and `#` and splits every `</`, so that neither marker can occur there, and reading drops it again.
Output comes as segments of at most about SEGMENT_CHARS (at least one turn), to be put together in order; each carries the spans of its
assistant texts as the loss mask.

Defined results: null texts and roles are empty; repeated rows are turns of their own; an event of unknown kind raises an error; events of
a message that was never opened open it with an empty role; an empty log gives no segments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT_CHARS = 1 << 20
DELTA_CHARS = 400
LOSS_ROLE = "assistant"
KINDS = ("message", "delta", "edit", "regenerate", "retract")

_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n(.*?)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and the span of its text."""
    head = f"### {escape(role).replace(':', chr(92) + ':')}:\n"
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def fold(events: Iterable[tuple]) -> Iterator[tuple]:
    """(conversation, role, text) of each message from (conversation, msg, tag, seq, kind, role, text) in order."""
    current, role, parts, live = None, "", [], False
    for conv, msg, tag, _, kind, said, text in events:
        if current != (conv, msg, tag):
            if live:
                yield current[0], role, "".join(parts)
            current, role, parts, live = (conv, msg, tag), "", [], True
        if kind == "message":
            role = said or ""
        elif kind == "regenerate" or kind == "edit":
            parts = []
        elif kind == "retract":
            live = False
        elif kind != "delta":
            raise ValueError(f"unknown event kind {kind!r}")
        parts.append(text or "")
    if live:
        yield current[0], role, "".join(parts)


def segments(messages: Iterable[tuple], most: int = SEGMENT_CHARS) -> Iterator[tuple]:
    """(conversation, segment number, formatted text, loss spans) from messages in order."""
    conv, number, out, size, spans, begun = None, 0, [], 0, [], False
    for own, role, text in messages:
        turn, start, stop = turn_text(role, text)
        if begun and (own != conv or size + len(turn) > most):
            yield conv, number, "".join(out), spans
            number = number + 1 if own == conv else 0
            out, size, spans = [], 0, []
        conv, begun = own, True
        if role == LOSS_ROLE:
            spans.append({"start": size + start, "stop": size + stop})
        out.append(turn)
        size += len(turn)
    if begun:
        yield conv, number, "".join(out), spans


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 4 << 20, weight=lambda row: 64) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def render(events: DataFrame, most: int = SEGMENT_CHARS) -> DataFrame:
    """conv_id, segment, formatted, loss (array of start, stop) of every conversation in `events`.

    `events` has conv_id long, msg long, tag string, seq long, kind, role, text string.  The rows of a conversation lie in one
    partition, in order.
    """
    rows = events.select(*[F.col(c).cast(t).alias(c) for c, t in (
        ("conv_id", "long"), ("msg", "long"), ("tag", "string"), ("seq", "long"), ("kind", "string"), ("role", "string"), ("text", "string"))])
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "msg", "tag", "seq", "kind", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("loss", _SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(segments(fold(_rows(batches)), most), schema, weight=lambda row: 64 + 2 * len(row[2]))

    return placed.mapInArrow(run, "conv_id long, segment long, formatted string, loss array<struct<start: long, stop: long>>")


def _read(rows: Iterable[tuple]) -> Iterator[tuple]:
    conv, begun = None, False
    turns = loss = None
    n = chars = loss_chars = 0
    for own, _, formatted, spans in rows:
        if begun and own != conv:
            yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars
            begun = False
        if not begun:
            conv, begun, n, chars, loss_chars, turns, loss = own, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        at = 0
        for turn in _TURN.finditer(formatted):
            if turn.start() != at:
                break
            at = turn.end()
            turns.update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
            n += 1
        if at != len(formatted):
            raise ValueError(f"conversation {own}: the formatted text can't be read at {at}")
        for span in spans or []:
            text = unescape(formatted[span["start"]:span["stop"]])
            loss.update(text.encode())
            loss_chars += len(text)
        chars += len(formatted)
    if begun:
        yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars


def read_back(rendered: DataFrame, placed: bool = False) -> DataFrame:
    """Per conversation what its formatted text and loss mask hold; `placed`: rows lie as `render` leaves them."""
    rows = rendered.select("conv_id", "segment", "formatted", "loss")
    if not placed:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_read(_rows(batches)), schema)

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of(turns: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log of a streaming writer.

    Each turn opens a message, streams a first try of its beginning, regenerates it, and streams the text in deltas.
    """
    rows = turns.select("conv_id", F.col("turn").alias("msg"), F.monotonically_increasing_id().alias("id"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    tag = F.concat_ws(":", "role", F.hex(F.xxhash64("text")), F.lpad(F.col("id").cast("string"), 20, "0"))
    empty, none = F.lit(""), F.lit(None).cast("string")

    def event(seq, kind, role, text):
        return F.struct(F.lit(seq).cast("long").alias("seq") if isinstance(seq, int) else seq.cast("long").alias("seq"),
                        F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / delta_chars), F.lit(1)) - 1),
                         lambda i: event(i + 3, "delta", none, F.substring(F.col("text"), (i * delta_chars + 1).cast("int"), F.lit(delta_chars))))
    log = F.concat(F.array(event(0, "message", F.col("role"), empty), event(1, "delta", none, F.substring("text", 1, 12)),
                           event(2, "regenerate", none, empty)), pieces)
    return rows.select("conv_id", "msg", tag.alias("tag"), F.inline(log))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formats all conversations and reads the result back."""
    return read_back(render(events_of(turns)), placed=True)
