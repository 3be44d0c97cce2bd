"""Class-based language model against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrain.llm import brown

VERBS, NOUNS = ("sees", "likes", "finds", "Takes"), ("cat", "dog", "tree", "house", "x" * 40)


def corpus():
    texts = []
    for i in range(160):
        pick = lambda k, of: of[(i * 7 + k * 3 + i // 5) % len(of)]
        texts.append(" ".join(f"the {pick(k, NOUNS)} {pick(k + 1, VERBS)}\ta {pick(k + 2, NOUNS)} ." for k in range(1 + i % 4)) + f" rare{i // 2}")
    return texts + [None, "", "  \n", "never seen words", "the\xa0cat", "a " * 3000]


def table(spark, texts):
    rows = [(i, t, "x", 1.0, "y") for i, t in enumerate(texts)] + [(None, "the dog", None, None, None), (0, texts[0], "x", 1.0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n double, key string")


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2


def split(text):
    return [w.lower() for w in (text or "").encode().split()]


def plain_counts(rows):
    counts = Counter()
    for key, text in rows:
        if not held(key):
            counts.update([*split(text), "end"])
    return counts


@pytest.fixture(scope="module")
def scored(spark):
    docs = table(spark, corpus())
    rows = docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    trained, counts = brown.train(rows.filter(~brown.held_out(F.col("key"))), n_classes=6)
    return [(r.doc_id, r.text) for r in docs.collect()], trained, counts, brown.score(rows, trained, counts).collect(), rows


def test_base_scores(spark, scored):
    rows, _, _, got, _ = scored
    counts = plain_counts(rows)
    total, v = counts.total(), len(counts)
    assert len(got) == len(rows)
    texts = {}
    for key, text in rows:
        texts[key] = text
    for r in got:
        own = [*split(texts[r.key]), "end"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + v + 1)) for w in own), rel_tol=1e-9)
    by_query = {(r.doc_id, r.held_out) for r in brown.perplexities(table(spark, corpus())).collect()}
    assert by_query == {(key, held(key)) for key, _ in rows}


def test_scores_and_sums_to_one(scored):
    rows, trained, _, got, _ = scored
    counts, vocab = plain_counts(rows), trained.vocab
    keys = {w: brown.tokens(w.decode())[0] for w in counts if w != "end"}
    number = vocab.numbers()
    assert 0 < vocab.tail < len(counts)
    total = counts.total() + len(counts) + 1

    def p(before, word):
        c, i = counts[word], vocab.end if word == "end" else number.get(keys.get(word), vocab.tail)
        own, base = trained.transition[before, trained.classes[i]], (c + 1) / total
        emission = trained.emission[i] * (c + 1 if i == vocab.tail else 1)
        return trained.classes[i], brown.MIX * own * emission + (1 - brown.MIX) * base

    for before in range(len(trained.transition)):
        assert math.isclose(sum(p(before, w)[1] for w in [*counts, b"no such word"]), 1, rel_tol=1e-9)
    texts = dict(rows)
    for r in got:
        before, score = trained.classes[vocab.end], 0.0
        for w in [*split(texts[r.key]), "end"]:
            before, own = p(before, w)
            score += math.log10(own)
        assert math.isclose(r.score, score, rel_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-score / r.n_tokens), rel_tol=1e-6)


def test_classes_help_on_held_out_rows(scored):
    _, _, _, got, _ = scored
    own = [r for r in got if held(r.key)]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_bigrams_and_exchange(spark, scored, monkeypatch):
    rows, trained, _, _, docs = scored
    vocab, number = trained.vocab, trained.vocab.numbers()
    want, size = Counter(), trained.vocab.end + 1
    for key, text in rows:
        if not held(key):
            ids = [vocab.end, *(number.get(k, vocab.tail) for k in brown.tokens(text)), vocab.end]
            for a, b in zip(ids, ids[1:], strict=False):
                want[(a * 2) * size + b] += 1
                want[(b * 2 + 1) * size + a] += 1
    monkeypatch.setattr(brown, "FLUSH_PAIRS", 200)
    packed = brown.bigrams(docs.filter(~brown.held_out(F.col("key"))), vocab)
    got = Counter()
    for r in packed.collect():
        for k, n in zip(*(x.tolist() for x in brown._unpack(r.keys, r.n)), strict=True):
            assert k not in got
            got[k] += n
    assert got == want
    found = [brown.exchange(packed, vocab, 6, rounds) for rounds in (0, 2, 8)]
    for classes, transitions in found:
        plain = np.zeros((8, 8), int)
        for key, n in want.items():
            word, other = key // size, key % size
            plain[classes[word // 2], classes[other]] += n * (word % 2 == 0)
        assert (plain == transitions).all()
    first, second, third = (brown.likelihood(t) for _, t in found)
    assert first < second <= third


def test_gains_are_differences_of_likelihood():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 9, 400)
    tokens[-1] = tokens[0]
    of = rng.integers(0, 4, 9)

    def table(of):
        out = np.zeros((4, 4))
        np.add.at(out, (of[tokens[:-1]], of[tokens[1:]]), 1)
        return out

    def likelihood(of):
        f, x = brown._xlogx, table(of)
        return f(x).sum() - f(x.sum(axis=1)).sum() - f(x.sum(axis=0)).sum()

    after, before, alone = np.zeros((9, 4)), np.zeros((9, 4)), np.zeros(9)
    for a, b in zip(tokens, tokens[1:], strict=False):
        if a == b:
            alone[a] += 1
        else:
            after[a, of[b]] += 1
            before[b, of[a]] += 1
    gain = brown.gains(table(of), of, after, before, alone)
    for w in range(9):
        for c in range(4):
            moved = of.copy()
            moved[w] = c
            assert math.isclose(gain[w, c] - gain[w, of[w]], likelihood(moved) - likelihood(of), abs_tol=1e-6)


def test_odd_tables(spark):
    docs = table(spark, corpus()[:12])
    assert brown.perplexities(docs.filter("false")).count() == 0
    only = docs.filter(brown.held_out(F.col("doc_id")))
    for r in brown.perplexities(only).collect():
        assert (r.held_out, r.n_known, r.train_tokens, r.base_score) == (True, 0, 0, 0.0) and math.isfinite(r.score)
    assert only.count()
    blank = spark.createDataFrame([(i, None) for i in range(9)], "doc_id long, text string")
    assert {(r.n_tokens, r.n_known > 0) for r in brown.perplexities(blank).collect()} == {(1, True)}


def test_words_below_the_share_have_classes_too(spark, monkeypatch):
    monkeypatch.setattr(brown, "LEAST_SHARE", 0.02)
    docs = table(spark, corpus())
    rows = docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    trained, known = brown.train(rows.filter(~brown.held_out(F.col("key"))), n_classes=6)
    vocab, number = trained.vocab, trained.vocab.numbers()
    counts = plain_counts([(r.key, r.text) for r in rows.collect()])
    rest = {bytes(r.word): (r.n, r["class"]) for r in known.collect()}
    assert 0 < vocab.tail and sum(n >= 2 for n, _ in rest.values()) > 20
    assert all((own < 6) == (n >= 2) for n, own in rest.values())
    texts = [(r.key, [brown.tokens(w.decode())[0] for w in split(r.text)]) for r in rows.collect()]

    def place(word):
        return trained.classes[vocab.end if word == "end" else number[word]] if word == "end" or word in number else rest.get(word, (0, trained.classes[vocab.tail]))[1]

    def p(before, word, c):
        own = trained.emission[vocab.end if word == "end" else number[word]] if word == "end" or word in number else None
        if own is None:
            own = c / trained.held[place(word)] if place(word) < 6 else (c + 1) * trained.emission[vocab.tail]
        return brown.MIX * trained.transition[before, place(word)] * own + (1 - brown.MIX) * (c + 1) / (counts.total() + len(counts) + 1)

    plain = np.zeros((8, 8))
    for key, words in texts:
        if not held(key):
            of = [trained.classes[vocab.end], *map(place, [*words, "end"])]
            np.add.at(plain, (of[:-1], of[1:]), 1)
    prior = (trained.held + 1) / (counts.total() + 8)
    assert np.allclose(trained.transition, (plain + brown.PRIOR * prior) / (plain.sum(axis=1, keepdims=True) + brown.PRIOR), rtol=1e-12)
    seen = {"end": counts["end"]} | {brown.tokens(w.decode())[0]: n for w, n in counts.items() if w != "end"}
    for before in range(8):
        assert math.isclose(sum(p(before, w, seen.get(w, 0)) for w in [*seen, b"no such word"]), 1, rel_tol=1e-9)
    of = dict(texts)
    for r in brown.score(rows, trained, known).collect():
        before, score = trained.classes[vocab.end], 0.0
        for w in [*of[r.key], "end"]:
            score += math.log10(p(before, w, seen.get(w, 0)))
            before = place(w)
        assert math.isclose(r.score, score, rel_tol=1e-9)
        assert r.n_known == sum(w in seen for w in [*of[r.key], "end"])
