"""Toxicity by multiple-instance learning (operator 8).

A document is a bag of sentences and only the bag has a label.  Each sentence is toxic with a probability p of its own, the document with
1 - (1 - leak) * prod(1 - p) over all its sentences: the noisy-or.  Weights are learned from document labels through that product, so the
model finds by itself which sentences explain a label, and scoring names the worst one.  Fit and score use this one formula:

* -log(1 - p) = g(z) ** 2, where z is the sum of the weights of the sentence's words and g(z) = softplus(BIAS + z) - softplus(BIAS);
* weights are positive (exp of what is learned), so a sentence without evidence has p = 0 and adds nothing, wherever it stands;
* the square keeps slight evidence slight: thousands of sentences with a weak word do not add up to a toxic book, a few plain ones do;
* leak = sigmoid of a bias per document, so a text's length alone does not raise its score.

A word's weight is the sum over its features (the word, its first letters, its last letters), so unseen forms of a known stem score as
well; a word counts once in a sentence.  Features are screened first: only those whose documents are labelled toxic clearly more often
than others (likelihood ratio of at least SCREEN) get a weight at all.  Learning reads a bounded sample of labelled rows, whole texts
(the TRAIN_ROWS whose hashed ids are smallest, up to TRAIN_CHARS together), never a row whose crc32 falls in the held-out fifth.
Scoring is one narrow Arrow pass over all texts, whole.

Defined results: a null or empty text is one empty sentence and gets the score of the leak alone; several labels for one document
count as toxic if one does; null labels are none; without labelled rows of both kinds no feature has a weight.
Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces, released

FOLDS = 5
TRAIN_ROWS = 8_000
TRAIN_CHARS = 32_000_000
SCREEN = 15.0
STEPS = 300
RATE = 0.1
DECAY = 1e-4
BIAS = -5.0
START_LEAK = -5.0
START_WEIGHT = 0.7
CACHE_ENTRIES = 100_000
CACHE_CHARS = 64

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(word: str) -> tuple[int, ...]:
    """Hashes of the features of a lower-cased word; a fixed number for each word."""
    return tuple(zlib.crc32(f.encode("utf-8")) for f in ("=" + word, "<" + word[:3], "<" + word[:4], "<" + word[:5], word[-4:] + ">"))


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences, at least one."""
    return [m.span() for m in _SENTENCE.finditer(text)] or [(0, 0)]


def words_in(low: str, span: tuple[int, int]) -> set[str]:
    return set(_WORD.findall(low, *span))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def hazard(z: np.ndarray) -> np.ndarray:
    """-log(1 - p) of sentences."""
    return (softplus(BIAS + z) - softplus(np.float64(BIAS))) ** 2


def loss_and_slopes(weights: np.ndarray, leak: float, feature_at: np.ndarray, sentence_of: np.ndarray, doc_of: np.ndarray,
                    y: np.ndarray, decay: float) -> tuple[float, np.ndarray, float]:
    """Mean noisy-or log loss with its slopes by weight and by leak; `feature_at` and `sentence_of` hold a row for each feature of each sentence."""
    z = np.bincount(sentence_of, weights[feature_at], len(doc_of))
    total = softplus(np.float64(leak)) + np.bincount(doc_of, hazard(z), len(y))
    total = np.maximum(total, 1e-9)
    loss = np.where(y == 1, -np.log(-np.expm1(-total)), total).mean() + decay / 2 * (weights ** 2).sum()
    slope = np.where(y == 1, -1.0 / np.expm1(np.minimum(total, 50.0)), 1.0) / len(y)
    sigmoid = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -50.0, 50.0)))
    at_sentence = slope[doc_of] * 2 * (softplus(BIAS + z) - softplus(np.float64(BIAS))) * sigmoid(BIAS + z)
    grad = np.bincount(feature_at, at_sentence[sentence_of], len(weights)) + decay * weights
    return float(loss), grad, float(slope.sum() * sigmoid(leak))


def screen(on: np.ndarray, off: np.ndarray, base: float, least: float = SCREEN) -> np.ndarray:
    """Which features go with toxic documents, by the likelihood ratio of the counts of toxic and other documents that have them."""
    share = on / np.maximum(on + off, 1)
    ratio = 2 * (np.where(on > 0, on * np.log(np.maximum(share, 1e-300) / base), 0.0)
                 + np.where(off > 0, off * np.log(np.maximum(1 - share, 1e-300) / (1 - base)), 0.0))
    return (share > base) & (ratio >= least)


def fit(texts: Iterable[str], labels: list[int], steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[dict[int, float], float]:
    """Feature weights and leak that minimise the noisy-or log loss (Adam on the whole sample; no random numbers)."""
    y = np.asarray(labels, dtype=np.int8)
    if len(set(labels)) < 2:
        return {}, START_LEAK
    index: dict[str, int] = {}
    words, lengths, doc_of, bounds = array("i"), array("i"), array("i"), [0]
    for d, text in enumerate(texts):
        low = text.lower()
        for span in sentences(low):
            own = words_in(low, span)
            words.extend(index.setdefault(w, len(index)) for w in own)
            lengths.append(len(own))
            doc_of.append(d)
        bounds.append(len(words))
    words, lengths, doc_of = (np.frombuffer(x, dtype=np.int32) if len(x) else np.empty(0, np.int32) for x in (words, lengths, doc_of))
    width = len(features(""))
    table = np.fromiter((f for w in index for f in features(w)), np.uint32, width * len(index)).reshape(-1, width)
    del index
    hashes = np.unique(table)
    table = np.searchsorted(hashes, table).astype(np.int32)
    counts = np.zeros((2, len(hashes)))
    for label, a, b in zip(labels, bounds, bounds[1:], strict=False):  # document by document, so nothing of all documents is built
        counts[label, np.unique(table[np.unique(words[a:b])])] += 1
    chosen = screen(counts[1], counts[0], y.mean())
    kept = hashes[chosen]
    place = np.where(chosen, np.cumsum(chosen) - 1, -1).astype(np.int32)
    known = chosen[table]
    useful = np.flatnonzero(known.any(axis=1)[words]) if len(words) else np.empty(0, np.int64)
    near = words[useful]
    sentence_at = np.searchsorted(np.cumsum(lengths), useful, side="right")  # of the words that have a chosen feature
    row, column = np.nonzero(known[near])
    sentence_of, feature_at = sentence_at[row], place[table[near[row], column]]
    log_w, leak = np.full(len(kept), math.log(START_WEIGHT)), START_LEAK
    m, v, ml, vl = np.zeros_like(log_w), np.zeros_like(log_w), 0.0, 0.0
    for step in range(1, steps + 1):
        w = np.exp(log_w)
        _, grad, grad_leak = loss_and_slopes(w, leak, feature_at, sentence_of, doc_of, y, decay)
        grad = grad * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        ml, vl = 0.9 * ml + 0.1 * grad_leak, 0.999 * vl + 0.001 * grad_leak * grad_leak
        a, b = 1 - 0.9 ** step, 1 - 0.999 ** step
        log_w -= rate * (m / a) / (np.sqrt(v / b) + 1e-12)
        leak -= rate * (ml / a) / (math.sqrt(vl / b) + 1e-12)
    return dict(zip(map(int, kept), map(float, np.exp(log_w)), strict=True)), float(leak)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> tuple[dict[int, float], float]:
    """A model from a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = known.orderBy(*order).limit(rows)  # at most `rows` ids and labels, so they go to the texts, not the texts to them
    texts = docs.select("doc_id", "text", F.length("text").alias("size"), F.xxhash64("text").alias("digest")).filter(F.col("size").between(1, chars))
    labelled = texts.join(F.broadcast(picked), "doc_id")
    total, count = 0, 0
    for r in labelled.select("doc_id", "digest", "size").orderBy(*order, "digest").limit(rows).collect():
        total += r["size"]
        if total > chars:
            break
        count += 1
    chosen = labelled.orderBy(*order, "digest").limit(count).select("text", "toxic")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(released(batches))
        labels = [int(n > 0) for batch in held for n in batch.column("toxic").to_pylist()]
        weights, leak = fit((t.as_py() for batch in held for t in batch.column("text")), labels)
        yield pa.RecordBatch.from_arrays([pa.array([*weights, None], pa.int64()), pa.array([*weights.values(), leak], pa.float64())], names=["feature", "value"])

    # one task, for the sample is bounded; repartitioned so that there is one also where the sample is empty
    learned = chosen.repartition(1).sortWithinPartitions("text", "toxic").mapInArrow(learn, "feature long, value double").collect()
    weights = {r["feature"]: r["value"] for r in learned if r["feature"] is not None}
    return weights, next((r["value"] for r in learned if r["feature"] is None), START_LEAK)


class Scorer(dict):
    """Word scores by lower-cased word, in two bounded generations, and scores of texts."""

    def __init__(self, weights: dict[int, float], leak: float):
        super().__init__()
        self.weights, self.old = weights, {}
        self.base = float(softplus(np.float64(leak)))

    def __missing__(self, word: str) -> float:
        score = self.old.get(word)
        if score is None:
            score = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[word] = score
        return score

    def score(self, text: str) -> tuple[float, int, int]:
        """Probability, and the span of the sentence that is likeliest to be toxic (first of equals)."""
        low = text.lower()
        if not any(map(self.__getitem__, set(_WORD.findall(low)))):  # the leak alone
            first = _SENTENCE.search(text)
            return -math.expm1(-self.base), *(first.span() if first else (0, 0))
        spans = sentences(low)
        z = np.array([sum(map(self.__getitem__, words_in(low, span))) for span in spans], dtype=float)
        a, b = spans[int(z.argmax())] if len(low) == len(text) else (0, len(text))
        return float(-np.expm1(-self.base - hazard(z).sum())), a, b


def score(docs: DataFrame, model: tuple[dict[int, float], float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `score`, `predicted` and the span of the worst sentence of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                           T.StructField("worst_start", T.LongType()), T.StructField("worst_stop", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*shared.value)
        for batch in released(batches):
            for part in pieces(batch, "text"):
                p, a, b = zip(*map(own.score, part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                    names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on the labelled rows outside the held-out fold and scores every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "worst_start", "worst_stop")


def reject(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that are not predicted to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*shared.value)
        for batch in released(batches):
            for part in pieces(batch, text):
                yield part.filter(pa.array([own.score(t or "")[0] < 0.5 for t in part.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
