"""Fill-in-the-middle and periodic runs against plain versions."""

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracegrain.llm import fill_middle, periodic_runs

TEXTS = [None, "", " ", "a", "naïve 東京 👩‍👩‍👧 \x85 end", "<P>x<S>y<M>z", "has <M> inside", "<" * 9 + "S>" * 3, "line\nline\r\n\ttab  ", "ab<c" * 5000, "é" * 70_000]


def table(spark, texts, more=()):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(None, "no id here", None, None, None), (0, texts[0], "x", 1, "y"), *more]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, n long, runs string")


def plain_fill(key, text):
    n, digest = len(text), hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fill_middle(spark):
    texts = TEXTS + [f"text number {i} with some <words> and ünïts" for i in range(60)]
    got = fill_middle.digests(table(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        text = ("no id here" if r.doc_id is None else texts[r.doc_id]) or ""
        form, prefix, middle, output = plain_fill(r.doc_id, text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (
            len(text), form, prefix, middle, sha(output), sha(text))


def test_fill_middle_keeps_other_columns_when_restoring(spark):
    out = fill_middle.restore(fill_middle.transform(table(spark, TEXTS)))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert {r.doc_id: r.restored for r in out.collect() if r.doc_id is not None} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert fill_middle.digests(table(spark, TEXTS).filter("false")).count() == 0


def plain_runs(words):
    """All (start, length, period): every stretch of one period that no neighbour extends, of the least period that it has."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in best.items())


def plain_kept(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 12), st.integers(1, 9))
def test_runs_match_plain_search(words, period, times):
    for own in (words, words[:period] * times + words, words + (words[:period] * 4 + [3]) * 4, [0] * len(words)):
        found = periodic_runs.runs(np.array([*own, -1]))
        assert [tuple(r) for r in found.tolist()] == plain_runs(own)


def test_long_runs_take_few_steps():
    words = np.array([7] * 300_000 + ([0] * 6 + [1]) * 40_000 + list(range(2, 50_002)) * 4)
    found = periodic_runs.runs(words)
    assert [0, 300_000, 1] in found.tolist() and [300_000, 280_000, 7] in found.tolist() and [580_000, 200_000, 50_000] in found.tolist()
    assert len(found) == 3 + 40_000  # and six equal words in a row, each time


def plain_planted(key, words):
    h = zlib.crc32(("" if key is None else str(key)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def test_find_and_digests(spark):
    texts = TEXTS + ["x " * 40 + "a\xa0b   c", "one two " * 9, "A a " * 9] + [" ".join(f"w{i}_{j}" for j in range(i)) for i in range(120)]
    docs = table(spark, texts)
    got = periodic_runs.digests(docs).collect()
    assert len(got) == len(texts) + 2
    planted = 0
    for r in got:
        text = ("no id here" if r.doc_id is None else texts[r.doc_id]) or ""
        words = plain_planted(r.doc_id, text.encode().split())
        own = plain_runs(words) if len(words) < 3000 else []
        planted += bool(own)
        best = min(own, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(own), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if own else None)
        assert r.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in own))
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(plain_kept(words, own))).hexdigest()
    assert planted > 8
    found = {r.doc_id: r for r in periodic_runs.find(docs).collect()}
    assert found[len(TEXTS)].runs[0].asDict() == {"start": 0, "length": 40, "period": 1} and found[len(TEXTS)].collapsed == "x a\xa0b   c"
    assert periodic_runs.digests(docs.filter("false")).count() == 0
