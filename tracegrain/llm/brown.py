"""Language-model scores by class-based word bigrams (operator 13).

A text is its words, A-Z lower-cased, and one end.  Exchange clustering (Brown et al.) assigns each frequent word to one of CLASSES classes such
that the class bigrams of the training texts are as likely as can be; every other word that the training texts hold twice or more joins the class in which its
neighbours are likeliest.  The end (which also stands before the first word) is a class of its own, and so are the words seen once, which stand for the unknown ones.  A token's probability mixes

* class transition times word emission: P(class | class before) * P(word | class), and
* the base: (count + 1) / (N + V + 1) over all training tokens, with one share for all unknown words.

Both sum to 1 over the V known tokens and the unknown one, so scores are log10 probabilities and 10 ** (-score / n_tokens) is a perplexity.

A word is frequent if its count is at least LEAST_COUNT and at least LEAST_SHARE of all tokens, so there are at most 1 / LEAST_SHARE of them whatever
the corpus: that bounds the tables which are broadcast (words, counts, classes) and collected.  Everything else grows with the corpus and stays distributed:

* texts become numbers once: those of frequent words, and for the rest their place in the text's own list of words;
* counts of all words: tasks pre-aggregate, words are the key (words of LONG bytes and more by a digest of that length);
* bigrams: tasks count pairs of word numbers and send them, packed, to the buckets of their first and of their second word; a word whose share
  of the pairs is large is dealt over several buckets.  Merged buckets are written once;
* each exchange round reads them and sums a word's neighbours by class: at most a few cells for each word and bucket are shuffled.  A word moves to the
  class that gains most, its own contribution taken out first.  All words of a round see the classes of its beginning, and every
  second word, by hash, may move (fewer once a round made things worse); so the result depends on neither partitions nor order;
* words that are not frequent: tasks count the classes before and after each, under 64-bit hashes of the words less the bits of a class, in packed buckets like the
  bigrams; their classes are joined to the texts' lists.  Two words of one hash get one class, each keeps its own count.  Such a word holds less than LEAST_SHARE of all
  tokens (or one token), so no key is hot.  The class bigrams are then counted again with all classes;
* words seen once share a class, whose emission is (count + 1) / (tokens + words + 1), and an unknown word's is that of count 0.

Defined results: a null or empty text is its end alone; a null id hashes as the empty string; repeated rows count and score each by
itself; without training rows N and V are 0 and all tokens are unknown; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import arrow_bytes, discard, stored, swept
from .arrow import pieces

FOLDS, HELD = 7, 2
CLASSES = 32
ROUNDS = 8
LEAST_COUNT = 2
LEAST_SHARE = 1e-6
MIX = 0.9  # weight of the class model
PRIOR = 10.0  # transitions that a class borrows from the distribution of all classes
LONG = 24
FLUSH_WORDS = 300_000
FLUSH_PAIRS = 1 << 22
CHUNK = 256
CHUNK_WORDS = 4096
BATCH_BYTES = 4 << 20
CLASS_BITS, PLACE_SHIFT = 6, 35  # a count below the frequency bound takes 29 bits up to 5e14 tokens; a text of 2 GB has fewer than 2 ** 28 different words
END = b""


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def tokens(text: str | None) -> list[bytes]:
    """Keys of the words; bytes split at ASCII blanks only."""
    return [w if len(w) < LONG else blake2b(w, digest_size=LONG).digest() for w in (text or "").encode("utf-8").lower().split()]


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary key; END for the ends), n over all rows of (key, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def packed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for part in pieces(batch, "text"):
                for text in part.column("text").to_pylist():
                    held.update(tokens(text))
                held[END] += part.num_rows
                if len(held) >= FLUSH_WORDS:
                    yield packed()
        if held:
            yield packed()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The frequent words, the most frequent first, and totals over all training tokens."""

    words: list[bytes]
    counts: np.ndarray
    n_tokens: int
    n_words: int

    @property
    def tail(self) -> int:
        return len(self.words)

    @property
    def end(self) -> int:
        return len(self.words) + 1

    @property
    def least(self) -> float:
        """The count from which a word is frequent."""
        return max(LEAST_COUNT, LEAST_SHARE * self.n_tokens)

    def numbers(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    least = max(LEAST_COUNT, LEAST_SHARE * total["n"])  # the others are classed by `joined`
    top = counts.filter((F.col("n") >= least) & (F.col("word") != F.lit(END))).toArrow()  # at most 1 / LEAST_SHARE rows
    words, n = top.column("word").to_pylist(), top.column("n").to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return Vocabulary([words[i] for i in order], np.array([n[i] for i in order], np.int64), total["n"], total["v"])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _pack(sorted_keys: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Differences of sorted keys and counts, as planes of bytes, compressed."""
    planes = lambda x: zlib.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)
    return planes(np.diff(sorted_keys, prepend=np.int64(0))), planes(n)


def _unpack(keys: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = [np.frombuffer(zlib.decompress(x), np.uint8).reshape(8, -1) for x in (keys, n)]
    d, n = (np.ascontiguousarray(x.T).view("<u8").ravel().astype(np.int64) for x in flat)
    return np.cumsum(d), n


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _ids(row: list[int]) -> bytes:
    """Numbers as planes of bytes, small ones (of frequent words, and of a text's first others) in few of them: most planes are zeros for the files' compression."""
    x = np.array(row, np.int64)
    return np.ascontiguousarray(np.where(x < 0, -1 - 2 * x, 2 * x).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(ids: bytes) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(ids, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return np.where(x & 1, -1 - (x >> 1), x >> 1)


def numbered(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The columns but text, ids and words: a text's tokens as numbers, packed; number -1 - i is the i-th of `words`, the text's words that are not frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.numbers().get
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, words, sizes = [], [], []
                for text in part.column("text").to_pylist():
                    own: dict[bytes, int] = {}
                    place = own.setdefault
                    row = [i if (i := number(w, -1)) >= 0 else -1 - place(w, len(own)) for w in tokens(text)]
                    ids.append(_ids(row))
                    words += own
                    sizes.append(len(own))
                bounds = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(bounds, pa.array(words, pa.binary()))],
                                                 names=[*others, "ids", "words"])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in others]
    return docs.mapInArrow(run, ", ".join([*kinds, "ids binary", "words array<binary>"]))


def _packed_by(bucket: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """bucket, keys, n of sorted buckets, and keys sorted within them."""
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    blocks = [_pack(key[i:j], n[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), *(pa.array(x, pa.binary()) for x in zip(*blocks, strict=True))], names=["bucket", "keys", "n"])


def _buckets(vocab: Vocabulary) -> int:
    return 1 << min(16, max(6, (vocab.n_tokens >> 18).bit_length()))


def bigrams(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """bucket, keys, n: packed counts of neighbours, keyed by (word, side, other word); side 0 has what follows the word, 1 what is before it."""
    return _bigrams(numbered(docs.select("text"), vocab), vocab)


def _bigrams(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    buckets, tail, end = _buckets(vocab), vocab.tail, vocab.end
    size = vocab.end + 1
    share = np.concatenate([vocab.counts, [max(0, vocab.n_tokens - vocab.counts.sum())] * 2]) / max(vocab.n_tokens, 1)
    parts = np.ceil(4 * share * buckets).astype(np.int64).clip(1, buckets)  # of a word that holds a large share of all pairs
    dealt = texts.sparkSession.sparkContext.broadcast(parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = dealt.value
        held, size_held = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            a, b = pairs // size, pairs % size
            for side, (word, other) in enumerate(((a, b), (b, a))):
                bucket = ((_mixed(word) + _mixed(other) % parts[word].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                key = (word * 2 + side) * size + other
                order = np.lexsort((key, bucket))
                yield _packed_by(bucket[order], key[order], n[order])

        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                ids = _numbers(ids)
                ids = np.concatenate([[end], np.where(ids < 0, tail, ids), [end]])
                held.append(ids[:-1] * size + ids[1:])
                size_held += len(ids)
                if size_held >= FLUSH_PAIRS:
                    yield from packed()
                    held, size_held = [], 0
        if held:
            yield from packed()

    return _merged(texts.select("ids").mapInArrow(count, _PACKED), buckets)


_PACKED = "bucket int, keys binary, n binary"


def _merged(packed: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket with the sums of its packed counts."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(bucket: int, blocks: list) -> pa.RecordBatch:
            keys, n = _summed(*(np.concatenate(x) for x in zip(*blocks, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in _pack(keys, n))], names=["bucket", "keys", "n"])

        own, blocks, held = None, [], 0
        for batch in batches:
            for bucket, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != own and blocks:
                    yield merged(own, blocks)
                    blocks, held = [], 0
                own = bucket
                blocks.append(_unpack(keys, n))
                held += len(blocks[-1][0])
                if held > FLUSH_PAIRS:
                    blocks = [_summed(*(np.concatenate(x) for x in zip(*blocks, strict=True)))]
                    held = 0
        if blocks:
            yield merged(own, blocks)

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, _PACKED)


def contexts(pairs: DataFrame, vocab: Vocabulary, classes: np.ndarray, share: int = 1, turn: int = 0) -> DataFrame:
    """word, cells, n: per frequent word (those of one of `share` parts by hash) and bucket its neighbours by class; cells are those that follow by class, those before by class, and the word itself."""
    shared = pairs.sparkSession.sparkContext.broadcast(classes)
    size, width, tail = vocab.end + 1, int(classes.max()) + 1, vocab.tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, movable = shared.value, _mixed(np.arange(size)) % np.uint64(share) == turn % share
        movable[tail:] = False
        for batch in batches:
            for _, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, n = _unpack(keys, n)
                other, word = key % size, key // size
                on = movable[word // 2]
                other, word, n = other[on], word[on], n[on]
                side, word = word % 2, word // 2
                cell = np.where(other == word, 2 * width, side * width + of[other])
                keep = (other != word) | (side == 0)
                cells, n = _summed((word * (2 * width + 1) + cell)[keep], n[keep])
                word, cell = cells // (2 * width + 1), (cells % (2 * width + 1)).astype("<u2")
                edges = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]])) if len(word) else np.zeros(1, np.int64)
                spans = list(zip(edges, edges[1:], strict=False))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word[edges[:-1]]), pa.array([cell[i:j].tobytes() for i, j in spans], pa.binary()),
                     pa.array([n[i:j].astype("<i8").tobytes() for i, j in spans], pa.binary())], names=["word", "cells", "n"])

    return pairs.mapInArrow(run, "word long, cells binary, n binary")


def transitions(pairs: DataFrame, vocab: Vocabulary, classes: np.ndarray) -> np.ndarray:
    """Counts of (class, class after it)."""
    shared = pairs.sparkSession.sparkContext.broadcast(classes)
    size, width = vocab.end + 1, int(classes.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = shared.value, np.zeros(width * width, np.int64)
        for batch in batches:
            for _, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, n = _unpack(keys, n)
                word = key // size
                after = word % 2 == 0
                cell, m = _summed((of[word // 2] * width + of[key % size])[after], n[after])
                total[cell] += m
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    found = pairs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width * width, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(width, width)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def gains(table: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Log likelihood of the class bigrams with each word in each class, up to a constant per word.

    `table` counts (class, class after it) with the words in their classes `own`; `after`, `before` (word, class) and `alone` count the
    neighbours of each word, itself apart.
    """
    at = np.arange(len(own))
    n = np.repeat(table[None].astype(float), len(own), axis=0)
    n[at, own, :] -= after
    n[at, :, own] -= before
    n[at, own, own] -= alone
    row = _xlogx(n + after[:, None, :]) - _xlogx(n)
    column = _xlogx(n + before[:, :, None]) - _xlogx(n)
    middle = np.arange(table.shape[0])
    same = n[:, middle, middle]
    both = _xlogx(same + after + before + alone[:, None]) - _xlogx(same)
    held = after.sum(axis=1) + alone
    total = np.repeat(table.sum(axis=1)[None].astype(float), len(own), axis=0)
    total[at, own] -= held
    marginal = _xlogx(total + held[:, None]) - _xlogx(total)
    return row.sum(axis=2) - row[:, middle, middle] + column.sum(axis=1) - column[:, middle, middle] + both - 2 * marginal


def likelihood(table: np.ndarray) -> float:
    """What of the log likelihood of the class bigrams depends on the classes."""
    return float(_xlogx(table.astype(float)).sum() - 2 * _xlogx(table.sum(axis=1).astype(float)).sum())


def exchange(pairs: DataFrame, vocab: Vocabulary, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of each frequent word, then those of the tail and of the end; and the counts of their transitions.

    Words that move together may spoil each other's gains: a round that makes the corpus less likely is taken back, and half as many words may move.
    """
    words = np.arange(vocab.tail)
    classes = np.concatenate([words % n_classes, [n_classes, n_classes + 1]]).astype(np.int64)
    best = classes, transitions(pairs, vocab, classes)
    spark, share = pairs.sparkSession, 2
    for turn in range(rounds if vocab.tail else 0):
        classes, table = best
        if turn == rounds // 2:
            swept(spark)
        shared = spark.sparkContext.broadcast((table, classes))

        def decide(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            table, of = shared.value
            width = len(table)

            def decided(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
                word, x = np.array(list(rows)), np.array(list(rows.values()))
                own = of[word]
                gain = gains(table, own, x[:, :width], x[:, width:2 * width], x[:, 2 * width])[:, :n_classes]
                best = gain.argmax(axis=1)
                moved = gain[np.arange(len(word)), best] > gain[np.arange(len(word)), own] + 1e-6
                return pa.RecordBatch.from_arrays([pa.array(word[moved]), pa.array(best[moved])], names=["word", "class"])

            rows: dict[int, np.ndarray] = {}
            for batch in batches:  # rows of a word follow each other
                for word, cells, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if word not in rows:
                        if len(rows) >= CHUNK:
                            yield decided(rows)
                            rows = {}
                        rows[word] = np.zeros(2 * width + 1)
                    rows[word][np.frombuffer(cells, "<u2")] += np.frombuffer(n, "<i8")
            if rows:
                yield decided(rows)

        moves = contexts(pairs, vocab, classes, share, turn).repartition("word").sortWithinPartitions("word").mapInArrow(decide, "word long, class long").toArrow()
        if moves.num_rows:
            classes = classes.copy()
            classes[moves.column("word").to_numpy()] = moves.column("class").to_numpy()
            table = transitions(pairs, vocab, classes)
            if likelihood(table) > likelihood(best[1]):
                best = classes, table
            else:
                share *= 2
    return best


def neighbours(texts: DataFrame, vocab: Vocabulary, classes: np.ndarray) -> DataFrame:
    """bucket, keys, n: packed counts by (hash of a word that is not frequent, cell), in the cells of `contexts`; texts: ids, hashes."""
    shared = texts.sparkSession.sparkContext.broadcast(classes)
    buckets, tail, end, width = _buckets(vocab), vocab.tail, vocab.end, int(classes.max()) + 1
    shift, down = _cell_bits(width), 63 - _buckets(vocab).bit_length() + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, size = shared.value, [], 0

        def packed() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return _packed_by(key >> down, key, n)

        for batch in batches:
            lists = batch.column("hashes")
            flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, ids in enumerate(batch.column("ids").to_pylist()):
                ids = np.concatenate([[end], _numbers(ids), [end]])
                at = np.flatnonzero(ids < 0)
                own = flat[bounds[i]:bounds[i + 1]][-1 - ids[at]].view(np.uint64) >> np.uint64(1 + shift) << np.uint64(shift)
                cls = of[np.where(ids < 0, tail, ids)]
                same, again = ids[at + 1] == ids[at], ids[at - 1] == ids[at]
                after = own + np.where(same, 2 * width, cls[at + 1]).astype(np.uint64)
                before = (own + (width + cls[at - 1]).astype(np.uint64))[~again]
                held += [after.view(np.int64), before.view(np.int64)]
                size += len(after) + len(before)
                if size >= FLUSH_PAIRS:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    return _merged(texts.select("ids", "hashes").mapInArrow(run, _PACKED), buckets)


def _cell_bits(width: int) -> int:
    return (2 * width).bit_length()


def pulls(table: np.ndarray) -> np.ndarray:
    """(cell, class): what a neighbour in each cell of `contexts` adds to the log likelihood of a word in each class, to first order; the last row is one occurrence's share."""
    n = table + PRIOR * np.outer(table.sum(axis=1) + 1, table.sum(axis=0) + 1) / (table.sum() + len(table)) ** 2
    return np.vstack([np.log(n.T), np.log(n), np.log(np.diag(n)), -2 * np.log(n.sum(axis=1))])


def joined(texts: DataFrame, vocab: Vocabulary, classes: np.ndarray, table: np.ndarray) -> DataFrame:
    """hash, class of the words that are not frequent but there twice or more; texts: ids, hashes.  The class of words seen once is not among the classes."""
    shared = texts.sparkSession.sparkContext.broadcast(pulls(table)[:, :len(table) - 2])
    width, shift = len(table), _cell_bits(len(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pull = shared.value
        for batch in batches:
            for _, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, n = _unpack(keys, n)
                word, cell = key >> shift, key & ((1 << shift) - 1)
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
                seen = np.add.reduceat(np.where((cell < width) | (cell == 2 * width), n, 0), first) if len(first) else first
                size = np.diff(np.append(first, len(word)))
                for i in range(0, len(first), CHUNK_WORDS):
                    own = slice(first[i], first[min(i + CHUNK_WORDS, len(first)) - 1] + size[min(i + CHUNK_WORDS, len(first)) - 1])
                    at = np.repeat(np.arange(len(first[i:i + CHUNK_WORDS])), size[i:i + CHUNK_WORDS])
                    x = np.zeros((len(first[i:i + CHUNK_WORDS]), 2 * width + 2))
                    x[at, cell[own]] = n[own]
                    x[:, -1] = seen[i:i + CHUNK_WORDS]
                    often = x[:, -1] >= LEAST_COUNT
                    yield pa.RecordBatch.from_arrays([pa.array(word[first[i:i + CHUNK_WORDS]][often]), pa.array((x[often] @ pull).argmax(axis=1).astype(np.int32))], names=["hash", "class"])

    return neighbours(texts, vocab, classes).mapInArrow(run, "hash long, class int")


def word_hash(word: Column, width: int) -> Column:
    """What `neighbours` knows a word by."""
    return F.shiftrightunsigned(F.xxhash64(word), 1 + _cell_bits(width))


def resolved(texts: DataFrame, known: DataFrame) -> DataFrame:
    """The columns but words and row, and `found`: place in words, class and count of each that is known (word, n, class), in one number each."""
    lists = texts.select("row", F.posexplode("words").alias("j", "_word"))
    found = lists.join(known.select(F.col("word").alias("_word"), "class", "n"), "_word").groupBy("row").agg(F.collect_list(F.col("j") * (1 << PLACE_SHIFT) + F.col("n") * (1 << CLASS_BITS) + F.col("class")).alias("found"))
    blank = F.array().cast("array<bigint>")
    return texts.drop("words").join(found, "row", "left").drop("row").withColumn("found", F.coalesce("found", blank))


def _classed(batch: pa.RecordBatch, classes: np.ndarray, tail: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: numbers (negative: not frequent), classes, and counts of what is not frequent, the end of the text included."""
    lists, end = batch.column("found"), tail + 1
    packed = lists.values.to_numpy(zero_copy_only=False)
    j, n, cls = packed >> PLACE_SHIFT, packed >> CLASS_BITS & (1 << PLACE_SHIFT - CLASS_BITS) - 1, packed & (1 << CLASS_BITS) - 1
    bounds = lists.offsets.to_numpy()
    for i, ids in enumerate(batch.column("ids").to_pylist()):
        ids = np.append(_numbers(ids), end)
        rare = ids < 0
        own, count = np.full(-ids.min(initial=0), classes[tail]), np.zeros(-ids.min(initial=0), np.int64)
        span = slice(bounds[i], bounds[i + 1])
        own[j[span]], count[j[span]] = cls[span], n[span]
        of, m = classes[np.maximum(ids, 0)], np.zeros(len(ids), np.int64)
        of[rare], m[rare] = own[-1 - ids[rare]], count[-1 - ids[rare]]
        yield ids, of, m


def counted(texts: DataFrame, vocab: Vocabulary, classes: np.ndarray) -> np.ndarray:
    """Counts of (class, class after it) in resolved texts (ids, found), with the classes of all words."""
    shared = texts.sparkSession.sparkContext.broadcast(classes)
    tail, width = vocab.tail, int(classes.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            for _, of, _ in _classed(batch, shared.value, tail):
                total += np.bincount(np.concatenate([[width - 1], of[:-1]]) * width + of, minlength=width * width)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    found = texts.select("ids", "found").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width * width, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(width, width)


@dataclass
class Model:
    """Probabilities by word number; the last two stand for a word seen once or never, without the factor count + 1, and for the end.

    `held` has the tokens of each class, which the count of a word that is not frequent is divided by.
    """

    vocab: Vocabulary
    classes: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    base: np.ndarray
    known_end: bool
    held: np.ndarray


def model(vocab: Vocabulary, classes: np.ndarray, table: np.ndarray, tokens: np.ndarray, words: int) -> Model:
    """`tokens`: those of words that are not frequent, by class; `words`: how many of these were seen once."""
    width = len(table)
    ends = int(table[:, width - 1].sum())
    once = int(tokens[width - 2])
    held = np.bincount(classes[:-2], vocab.counts, width) + tokens
    held[width - 1] = ends
    prior = (held + 1) / (vocab.n_tokens + width)
    transition = (table + PRIOR * prior) / (table.sum(axis=1, keepdims=True) + PRIOR)
    emission = np.concatenate([vocab.counts / held[classes[:-2]], [1 / (once + words + 1), 1.0]])
    base = np.concatenate([vocab.counts + 1, [1, ends + 1]]) / (vocab.n_tokens + vocab.n_words + 1)
    return Model(vocab, classes, transition, emission, base, bool(ends), held)


def _trained(counts: DataFrame, vocab: Vocabulary, texts: DataFrame, n_classes: int, rounds: int) -> tuple[np.ndarray, DataFrame]:
    """The classes of `exchange`, and word, n, class of the words that are not frequent; texts: ids, words."""
    pairs = stored(_bigrams(texts, vocab), "bigrams")
    classes, table = exchange(pairs, vocab, n_classes, rounds)
    discard(pairs)
    swept(pairs.sparkSession)
    rest = counts.filter((F.col("n") < vocab.least) & (F.col("word") != F.lit(END)))
    once = int(classes[vocab.tail])
    single = rest.filter(F.col("n") < LEAST_COUNT).withColumn("class", F.lit(once))
    if vocab.least <= LEAST_COUNT:
        return classes, single
    own = joined(texts.select("ids", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")), vocab, classes, table)
    often = rest.filter(F.col("n") >= LEAST_COUNT).withColumn("hash", word_hash(F.col("word"), len(table))).join(own, "hash").select("word", "n", "class")
    known = stored(often.unionByName(single), "classed")
    discard(counts)
    return classes, known


def _fitted(vocab: Vocabulary, classes: np.ndarray, known: DataFrame, texts: DataFrame) -> Model:
    """The model of resolved training texts."""
    width = int(classes.max()) + 1
    rest = known.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    tokens = np.zeros(width)
    for r in rest:
        tokens[r["class"]] = r["n"]
    return model(vocab, classes, counted(texts, vocab, classes), tokens, sum(r["v"] for r in rest if r["class"] == width - 2))


def train(docs: DataFrame, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and word, n, class of the words that are not frequent, from all rows of (key, text)."""
    counts = stored(word_counts(docs), "words")
    vocab = vocabulary(counts)
    texts = _texts(docs, vocab)
    classes, known = _trained(counts, vocab, texts, n_classes, rounds)
    return _fitted(vocab, classes, known, stored(resolved(texts, known), "resolved")), known


def _texts(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    return stored(numbered(docs, vocab).withColumn("row", F.monotonically_increasing_id()), "numbered")


def score(docs: DataFrame, trained: Model, known: DataFrame) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of (key, text)."""
    return _scored(resolved(_texts(docs.select("key", "text"), trained.vocab), known), trained)


def _scored(texts: DataFrame, trained: Model) -> DataFrame:
    """`score` of resolved texts."""
    shared = texts.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tail, once, last = m.vocab.tail, int(m.classes[m.vocab.tail]), int(m.classes[m.vocab.end])
        for batch in batches:
            out = []
            for ids, of, n in _classed(batch, m.classes, tail):
                rare, at = ids < 0, np.where(ids < 0, tail, ids)
                base = m.base[at] * np.where(rare, n + 1, 1)
                own = np.where(rare, np.where(of == once, (n + 1) * m.emission[tail], n / np.maximum(m.held[of], 1)), m.emission[at])
                p = MIX * m.transition[np.concatenate([[last], of[:-1]]), of] * own + (1 - MIX) * base
                known = len(ids) - 1 - int((rare & (n == 0)).sum()) + m.known_end
                out.append((len(ids), known, float(np.log10(base).sum()), float(np.log10(p).sum())))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64())))],
                                             names=["key", "n_tokens", "n_known", "base_score", "score"])

    kind = texts.schema["key"].dataType.simpleString()
    scores = texts.select("key", "ids", "found").mapInArrow(run, f"key {kind}, n_tokens long, n_known long, base_score double, score double")
    return scores.select("key", "n_tokens", "n_known", F.lit(trained.vocab.n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
                         F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def perplexities(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, and the scores by a model of the rows that are not held out."""
    rows = docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    with arrow_bytes(docs.sparkSession, BATCH_BYTES):
        counts = stored(word_counts(rows.filter(~held_out(F.col("key")))), "words")
        vocab = vocabulary(counts)
        texts = _texts(rows, vocab)
        classes, known = _trained(counts, vocab, texts.filter(~held_out(F.col("key"))), CLASSES, ROUNDS)
        swept(texts.sparkSession)
        whole = stored(resolved(texts, known), "resolved")
        discard(texts)
        swept(texts.sparkSession)
        trained = _fitted(vocab, classes, known, whole.filter(~held_out(F.col("key"))))
        scores = stored(_scored(whole, trained), "scores")
    return scores.withColumnRenamed("key", "doc_id").withColumn("held_out", held_out(F.col("doc_id")))
