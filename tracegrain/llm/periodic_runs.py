"""Periodic runs of words by the dictionary of basic factors (operator 12).

The dictionary names, for each power of two m, the factor of m words at every place: equal names, equal factors.  The names of length 2m are
those of pairs of names of length m.  At each level every place looks for its successor, the next occurrence of its factor such that both lie within 2m
words; places whose successor lies as far away as the successor's own form an arithmetic progression and propose its difference as a period.  Neighbouring
proposals of one period are one; each is extended to both sides as far as words one period apart agree, in steps of the dictionary's lengths, and
proposals of several levels that end up at the same stretch are one run.

None is missed: in a run of period q and at least 4q words, let m be the power of two with q <= m < 2q.  A successor nearer than q would give the
run a smaller period, so that of the first word is q on, and so is its successor's own: 2q + m words are inside the run.  For the same reason a
proposed period is the least one of its stretch, and a stretch is proposed once a level, by all its places but the last 2q + m, so
the extension takes a step or two and there are no more proposals than runs of three periods.

A factor that occurs once has no equal longer one, so only repeated factors are carried to the next level; in natural texts few are after the
third.  A batch of texts is one array of word numbers, with a number of its own after each text, so factors never reach over two texts.
Batches hold a few megabytes of text or one text; a text of n words takes 4 bytes for each word and level, of which there are log2(n/2) at most.

Defined results: a null or empty text, or one without words, has no run and collapses to the empty text.  Repeated rows give repeated
results; a null id is an id like others; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
BLANKS = r"[\x20\x09-\x0D]+"
PIECE_BYTES = 1 << 20


class Factors:
    """Names of the factors of 1, 2, 4 … words at each place of `words`; a factor that occurs once has a negative name of its own."""

    def __init__(self, words: np.ndarray):
        self.size = len(words)
        self.alone = -1 - np.arange(self.size, dtype=np.int64)
        self.levels = [self._named(np.arange(self.size), words)]

    def _named(self, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Names at all places from the keys at `places`."""
        _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
        out = self.alone.astype(np.int32 if self.size < 2 ** 31 else np.int64)
        often = count[name] > 1
        out[places[often]] = name[often]
        return out

    def grow(self) -> bool:
        """Adds the level of twice the length; false if no factor of that length is repeated."""
        m, last = 1 << (len(self.levels) - 1), self.levels[-1]
        places = np.flatnonzero(last[:self.size - m] >= 0) if self.size > m else np.empty(0, np.int64)
        places = places[last[places + m] >= 0]
        self.levels.append(self._named(places, last[places].astype(np.int64) * self.size + last[places + m]))
        return bool((self.levels[-1] >= 0).any())

    def successors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places, in the order of their names, and the distance from each to the next of the same name (0: none) at the last level."""
        last = self.levels[-1]
        places = np.flatnonzero(last >= 0)
        places = places[np.argsort(last[places], kind="stable")]
        gap = np.zeros(len(places), np.int64)
        same = last[places[1:]] == last[places[:-1]]
        gap[:-1][same] = (places[1:] - places[:-1])[same]
        return places, gap

    def agree(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from a (a < b) and from b on agree, or how many before them; in steps of falling powers of two, the greatest repeatedly."""
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            m, names = 1 << k, self.levels[k]
            live = np.arange(len(a))
            while len(live):
                x, y = (a[live] + done[live], b[live] + done[live]) if forward else (a[live] - done[live] - m, b[live] - done[live] - m)
                inside = (x >= 0) & (y + m <= self.size)
                live, x, y = live[inside], x[inside], y[inside]
                live = live[names[x] == names[y]]
                done[live] += m
                if k < len(self.levels) - 1:  # a second step of this length would have been one of the level above
                    break
        return done


def runs(words: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """(start, length, period) of all runs in `words` (integers), by start and period, for `least_exponent` of 4 or more."""
    if least_exponent < 4:
        raise ValueError("shorter runs may lack the 2q + m words of a progression")
    factors = Factors(words)
    found = []
    gap_at = np.zeros(factors.size, np.int64)
    while True:
        m = 1 << (len(factors.levels) - 1)
        places, gap = factors.successors()
        near = (gap > 0) & (gap <= m)
        places, gap = places[near], gap[near]
        gap_at[places] = gap
        steady = gap_at[places + gap] == gap  # the successor's own successor is as far: an arithmetic progression
        gap_at[places] = 0
        at, period = places[steady], gap[steady]
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        border = np.ones(len(at) + 1, bool)
        border[1:-1] = (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])
        at, last, period = at[border[:-1]], at[border[1:]], period[border[:-1]]
        start = at - factors.agree(at, at + period, False)
        length = last + factors.agree(last, last + period, True) + period - start
        long = length >= np.maximum(least_length, least_exponent * period)
        found.append(np.stack([start, length, period], axis=1)[long])
        if 4 * m > factors.size or not factors.grow():
            break
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept(n: int, own: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds beyond its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, own[:, 0] + own[:, 2], 1)
    np.add.at(change, own[:, 0] + own[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_words`, `runs` (array of start, length, period) and `collapsed` (the kept words, one space between) of every row."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    run_type = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(run_type)), T.StructField("collapsed", T.StringType())])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        split = [t.encode("utf-8").split() for t in part.column(1).to_pylist()]  # bytes split at ASCII blanks only
        arrays = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int64, len(own)) for own in split]
        begins = np.cumsum([0] + [len(a) + 1 for a in arrays])
        whole = np.concatenate([x for i, a in enumerate(arrays) for x in (a, np.array([len(numbers) + i]))])
        found = runs(whole)
        bounds = np.searchsorted(found[:, 0], begins)
        found[:, 0] -= np.repeat(begins[:-1], np.diff(bounds))
        collapsed = []
        for own, a, b in zip(split, bounds, bounds[1:], strict=False):
            stay = own if a == b else [w for w, k in zip(own, kept(len(own), found[a:b]).tolist(), strict=True) if k]
            collapsed.append(b" ".join(stay))
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(
            [pa.array(found[:, k]) for k in range(3)], names=["start", "length", "period"]))
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([len(a) for a in arrays], pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                yield work(part)

    return rows.mapInArrow(run, schema)


def planted(key: Column, text: Column) -> Column:
    """The texts in which every tenth id, by hash, is given a period: from a place on its words repeat those of the first period."""
    h = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        source = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
        return F.array_join(F.transform(source, lambda i: F.get(w, i)), " ")

    once = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))  # the words are computed once
    return F.when(h % 10 == 0, F.get(once, F.lit(0))).otherwise(text)


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text; texts as `planted` gives them."""
    found = find(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(
        best.isNull() | (r["length"] > best["length"]), r).otherwise(best))  # runs come by start and period, so the first of equals stays
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), lines.alias("lines"), "collapsed")
    return best.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
