"""Line dedup over content-defined line chunks and runs of lines (operator 3).

A hash over each pair of neighbouring lines, rolled along the text, ends a chunk where it is divisible by BOUNDARY; a line of LONG_WORDS or more
stands alone.  Boundaries depend on the lines at hand only, so a passage is cut alike wherever it stands, and text put in before it
shifts nothing.  Chunks of at least two lines (or one long line) and MIN_WORDS words that occur more than once in the corpus are
removed everywhere but at their first place, by (document, place).

With `run_words`, every line goes that lies in a run of whole lines of so many words whose like stands at an earlier place, whatever its
neighbours are.  It is enough to index the shortest such run from each line on and the shortest one up to each line: a longer
run is covered by those inside it, line by line, and each of them stands earlier where the longer one does.

Only hashes are counted over the whole corpus, combined before the shuffle; a passage that a third of all documents hold is one row on that
side.  What agrees with its first place in 128 bits of hash is then compared with it byte by byte: spans of one text that lie at one distance from
one first text are merged, and only these stretches, each once, are fetched and meet the stretches of the first text.

A repeat that begins inside its own first place (equal lines in a row) loses only what lies past that place.

Defined results: a null text stays null and an empty one empty; a text all of whose chunks go becomes empty; repeated rows (same id, same text) count
as one document and get the same result; single short lines outside such runs stay, however frequent;
lines without words go with the run before them; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import coarse, stored
from .arrow import pieces

BOUNDARY = 3
LONG_WORDS = 50
MIN_WORDS = 10
RUN_WORDS = 50
SPANS = 5

_SCHEMA = "key long, digest long, start long, end long, stop long, hash long, check long"
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def chunks(text: str, boundary: int = BOUNDARY, long_words: int = LONG_WORDS, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, bool]]:
    """(start, stop, content end, removable) of each chunk in code points; stop is past the line break that ends it."""
    lines = text.split("\n")
    at = start = held = words = before = 0
    for i, line in enumerate(lines):
        n = len(line.split())
        own = xxhash.xxh3_64_intdigest(line.encode("utf-8"))
        end = at + len(line)
        stop = min(end + 1, len(text))
        if n >= long_words and held:
            yield start, at, at - 1, held > 1 and words >= min_words
            start, held, words = at, 0, 0
        held += 1
        words += n
        rolled = xxhash.xxh3_64_intdigest(before.to_bytes(8, "little") + own.to_bytes(8, "little"))
        before = own
        if n >= long_words or i == len(lines) - 1 or (held > 1 and rolled % boundary == 0):
            yield start, stop, end, (held > 1 and words >= min_words) or n >= long_words
            start, held, words = stop, 0, 0
        at = stop


def runs(text: str, least: int = RUN_WORDS) -> Iterator[tuple[int, int, int]]:
    """(start, stop, content end) of the shortest runs of lines of `least` words, from each line on and up to each line; some come twice.

    Runs begin and end with lines that have words; stop is past the lines without words that follow.
    """
    at, lines = 0, []  # start, content end, words
    for line in text.split("\n"):
        if n := len(line.split()):
            lines.append((at, at + len(line), n))
        at += len(line) + 1
    stops = [start for start, _, _ in lines[1:]] + [len(text)]
    first = held = 0
    for (_, end, n), stop in zip(lines, stops, strict=False):
        held += n
        while held >= least:  # the shortest from `first` on
            yield lines[first][0], stop, end
            held -= lines[first][2]
            first += 1
        if first:  # the shortest up to this line
            yield lines[first - 1][0], stop, end


def _span_hash(content: bytes) -> bytes:
    return xxhash.xxh3_128_digest(content)


def _find(docs: DataFrame, run_words: int | None) -> DataFrame:
    """Removable chunks and runs: key, digest (of the whole text), start, stop, and two halves of their hash."""
    rows = docs.select(F.col("key"), F.xxhash64("text").alias("digest"), "text").filter("text is not null")
    hashed = _span_hash
    names = ["key", "digest", "start", "end", "stop", "hash", "check"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                keys, digests, starts, ends, stops, hashes = [], [], [], [], [], []
                for key, digest, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    spans = {(start, stop, end) for start, stop, end, removable in chunks(text) if removable}
                    if run_words is not None:
                        spans.update(runs(text, run_words))
                    for start, stop, end in spans:
                        starts.append(start)
                        ends.append(end)
                        stops.append(stop)
                        hashes.append(hashed(text[start:end].encode("utf-8")))
                    keys += [key] * len(spans)
                    digests += [digest] * len(spans)
                halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                columns = [pa.array(c, pa.int64()) for c in (keys, digests, starts, ends, stops)] + [pa.array(halves[:, i].copy()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, _SCHEMA)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], stop)
        else:
            out.append((start, stop))
    return out


def _span_lists(column: pa.Array) -> list[list[tuple[int, int]]]:
    return [[(s["start"], s["stop"]) for s in own or ()] for own in column.to_pylist()]


@F.arrow_udf(_SPANS)
def _merge(spans: pa.Array) -> pa.Array:
    return pa.array([[{"start": a, "stop": b} for a, b in merged(own)] for own in _span_lists(spans)], spans.type)


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the spans; where the last of it went, also without the line break that stood before."""
    out, at = [], 0
    for start, stop in merged(cuts):
        out.append(text[at:start])
        at = stop
    rest = "".join(out)
    return rest.removesuffix("\n") if at >= len(text) else rest + text[at:]


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, cuts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else without(t, own) for t, own in zip(texts.to_pylist(), _span_lists(cuts), strict=True)], pa.string())


_COPY = ["key", "digest", "first_key", "first_digest", "distance"]


def _unequal(docs: DataFrame, matches: DataFrame, n_rows: int) -> DataFrame:
    """The alignments (of a text with a first text at a distance) whose bytes do not agree, although their hashes do."""
    spans = F.explode(_merge(F.collect_set(F.struct("start", F.col("end").alias("stop")))))
    joint = stored(coarse(matches.groupBy(*_COPY).agg(spans.alias("s")).select(*_COPY, "s.start", "s.stop"), n_rows), "stretches")
    first = joint.select(F.col("first_key").alias("key"), F.col("first_digest").alias("digest"),
                         (F.col("start") - F.col("distance")).alias("start"), (F.col("stop") - F.col("distance")).alias("stop"))
    asked = joint.select(*first.columns).unionByName(first).groupBy(F.col("key").alias("_key"), F.col("digest").alias("_digest")).agg(
        F.collect_set(F.struct("start", "stop")).alias("asked"))
    texts = docs.select("key", F.xxhash64("text").alias("digest"), "text")
    rows = texts.join(asked, F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest"))).select("key", "digest", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                out = [(key, digest, a, b, text[a:b].encode("utf-8")) for key, digest, text, own in zip(
                    *(c.to_pylist() for c in part.columns[:3]), _span_lists(part.column("asked")), strict=True) for a, b in own]
                columns = zip(*out, strict=True) if out else ([],) * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.binary()], strict=True)],
                                                 names=["_k", "_d", "_a", "_b", "bytes"])

    found = stored(coarse(rows.mapInArrow(run, "_k long, _d long, _a long, _b long, bytes binary").dropDuplicates(["_k", "_d", "_a", "_b"]), n_rows), "stretch-bytes")

    def met(rows: DataFrame, key: str, digest: str, shift: Column, name: str) -> DataFrame:
        at = F.col(key).eqNullSafe(F.col("_k")) & (F.col(digest) == F.col("_d")) & (F.col("start") - shift == F.col("_a")) & (F.col("stop") - shift == F.col("_b"))
        return rows.join(found.withColumnRenamed("bytes", name), at).drop("_k", "_d", "_a", "_b")

    both = met(met(joint, "key", "digest", F.lit(0), "own"), "first_key", "first_digest", F.col("distance"), "other")
    return both.filter("own <> other").select(*_COPY).distinct()


def repeated(docs: DataFrame, run_words: int | None = None) -> DataFrame:
    """Spans to remove: key, digest, start, stop.  `docs` has key and text."""
    place = F.struct("key", "digest", "start")
    found = stored(_find(docs, run_words), "line-spans")
    n_rows = found.count() // SPANS  # several spans are as much work as a text
    first = F.min(F.struct("key", "digest", "start", "stop"))
    known = found.groupBy("hash", "check").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).filter("n > 1").drop("n")
    copies = found.join(known, ["hash", "check"]).filter(~place.eqNullSafe(F.struct("first.key", "first.digest", "first.start")))
    inside = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("digest") == F.col("first.digest")) & (F.col("start") < F.col("first.stop"))
    matches = stored(coarse(copies.select(
        "key", "digest", "start", "end", "stop", F.when(inside, F.col("first.stop")).otherwise(F.col("start")).alias("from"),
        F.col("first.key").alias("first_key"), F.col("first.digest").alias("first_digest"), (F.col("start") - F.col("first.start")).alias("distance")), n_rows), "line-matches")
    wrong = stored(coarse(_unequal(docs, matches, n_rows), n_rows), "unequal")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _COPY]
    sure = matches.join(wrong.withColumnsRenamed({c: f"_{c}" for c in _COPY}), on, "left_anti")
    return sure.filter(F.col("from") < F.col("stop")).select("key", "digest", F.col("from").alias("start"), "stop")


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", run_words: int | None = None) -> DataFrame:
    """`docs` without the repeated chunks and runs; the columns `_removed` (passages) and `_was` (code points before) follow those of `docs`."""
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    cuts = repeated(own, run_words).groupBy(F.col("key").alias("_key"), F.col("digest").alias("_digest")).agg(F.collect_set(F.struct("start", "stop")).alias("_cuts"))
    cuts = cuts.withColumn("_cuts", _merge(F.col("_cuts")))
    joined = docs.join(cuts, F.col(key).cast("long").eqNullSafe(F.col("_key")) & (F.xxhash64(F.col(text)) == F.col("_digest")), "left")
    joined = joined.withColumn("_clean", _without(F.when(F.col("_cuts").isNotNull(), F.col(text)), F.col("_cuts")))  # only texts with cuts go to Python
    cleaned = F.when(F.col("_cuts").isNull(), F.col(text)).otherwise(F.col("_clean"))
    return joined.select(*[cleaned.alias(c) if c == text else F.col(c) for c in docs.columns],
                         F.coalesce(F.size("_cuts"), F.lit(0)).alias("_removed"), F.length(F.col(text)).alias("_was"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", run_words: int | None = None) -> DataFrame:
    """The rows of `docs`, all columns, with cleaned texts and their lengths, without rows of whose text nothing is left."""
    done = remove(docs, key, text, run_words).filter((F.col("_removed") == 0) | F.col(text).rlike(r"\S"))
    if length in docs.columns:
        done = done.withColumn(length, F.when(F.col("_removed") > 0, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return done.select(*docs.columns)


def line_dedup(docs: DataFrame, run_words: int | None = None) -> DataFrame:
    """doc_id, text without repeated chunks and runs, removed_chunks (passages), removed_chars."""
    done = remove(docs.select("doc_id", "text"), run_words=run_words)
    return done.select("doc_id", "text", F.col("_removed").alias("removed_chunks"), (F.col("_was") - F.length("text")).cast("long").alias("removed_chars"))
