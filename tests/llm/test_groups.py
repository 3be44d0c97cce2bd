"""Jaccard join, embedding dedup, components, mixing and chat formatting against plain versions."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tracegrain.llm import chat, jaccard_join, mixing, polytope
from tracegrain.llm.components import components
from tracegrain.llm.shingle_sets import digest, shingles


def grouped(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    want = grouped({n for e in links for n in e}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if any(n in e for e in links if e[0] != e[1])}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- Jaccard join

def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_join(rows):
    sets = {k: plain_set(t) for k, t in rows}
    keys = sorted(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, grouped(keys, links)


def family(rng, words, copies, edits, start):
    base = [f"v{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(copies):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"e{rng.randrange(10 ** 6)}"
        out.append((start + i, " ".join(own)))
    return out


@pytest.mark.parametrize("frequent", [24, 2])
def test_jaccard_join(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT_COUNT", frequent)
    monkeypatch.setattr(jaccard_join, "FIRST_BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "SECOND_BLOCK", 16)
    rng = random.Random(9)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "a b c d e f g h"), (6, "a b c d e f g h i"), (7, "É b c d e"), (8, "é b c d e")]
    rows += family(rng, 120, 90, 9, 100) + family(rng, 60, 40, 4, 300) + family(rng, 400, 15, 20, 400)
    common = " ".join(f"c{i}" for i in range(60))
    rows += [(500 + i, common + " " + " ".join(f"u{i}x{j}" for j in range(rng.randrange(5, 200)))) for i in range(60)]
    rows += [(600, "x " * 20000), (601, "x " * 15000), (602, " ".join(f"y{i % 3000}" for i in range(20000)))]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, node int, centre int").repartition(5)
    sets, want = plain_join(rows)
    got = {r.doc_id: r for r in jaccard_join.join(docs).collect()}
    assert len(got) == len(rows)
    assert {k: r.n_shingles for k, r in got.items()} == {k: len(s) for k, s in sets.items()}
    assert {k: r.component_id for k, r in got.items()} == want
    kept = {r.doc_id for r in jaccard_join.one_of_each(docs).collect()}
    assert kept == {k for k, c in want.items() if k == c}


def test_jaccard_join_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "a b c d e f")], "doc_id long, text string")
    got = jaccard_join.join(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1)]
    assert jaccard_join.join(docs.filter("false")).count() == 0
    assert jaccard_join.one_of_each(docs).count() == 4


def test_jaccard_join_past_a_near_copy_without_id(spark):
    rng = random.Random(3)
    docs = []
    for group in range(6):
        texts = []
        while not texts or min(texts, key=lambda t: digest(shingles(t))) != texts[0]:
            base = [f"n{rng.randrange(10 ** 6)}" for _ in range(200)]
            texts = [" ".join(base), *[" ".join(base[:at] + [f"e{at}"] + base[at + 1:]) for at in (20, 180)]]
        docs += [(None, texts[0]), (10 * group + 1, texts[1]), (10 * group + 2, texts[2])]
    got = jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(10 * g + i, 10 * g + 1) for g in range(6) for i in (1, 2)]
    assert [r.component_id for r in got if r.doc_id is None] == [None] * 6


def test_signatures_lose_no_pair():
    rng = random.Random(4)
    every = [f"t{i}" for i in range(300)]
    frequent = np.sort(np.array([], np.uint64))
    for share in (0.0, 0.5, 1.0):
        pool = shingles(" ".join(every), 1)
        chosen = np.unique(np.array([t >> np.uint64(24) for t in pool.tolist() and pool if rng.random() < share], dtype=np.uint64)) if share else frequent
        counts = np.array([30 + int(c) % 7 for c in chosen], dtype=np.int64)
        for _ in range(300):
            n = rng.randrange(4, 250)
            a = rng.sample(range(300), n)
            b = set(a)
            for _ in range(rng.randrange(1 + n // 8)):
                b.discard(rng.choice(a))
                b.add(rng.randrange(300))
            x, y = np.sort(pool[a]), np.sort(pool[sorted(b)])
            shared = len(np.intersect1d(x, y))
            if 100 * shared >= 80 * (len(x) + len(y) - shared) and len(y) >= 4 and not np.array_equal(x, y):
                assert set(jaccard_join.signatures(x, chosen, counts).tolist()) & set(jaccard_join.signatures(y, chosen, counts).tolist())


# --- embeddings

def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(polytope, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 24))
    rows = [(i, (base[i % 30] + rng.normal(size=24) * rng.choice([0.01, 0.1, 0.3])).tolist()) for i in range(300)]
    rows += [(300 + i, base[0].tolist()) for i in range(60)] + [(400, (base[0] * 7).tolist())]
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [1.0, None] * 12), (904, [math.nan] * 24), (905, [math.inf] * 24), (906, base[1][:20].tolist()), (907, [1e300] * 24), (908, [-1e300] * 24)]
    frame = spark.createDataFrame([(k, v, 1, 2) for k, v in rows + odd], "vec_id long, embedding array<double>, node int, links int")
    got = {r.vec_id: r for r in polytope.dedup(frame).collect()}
    assert len(got) == len(rows) + len(odd)
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    keys = [k for k, _ in rows]
    links = [(keys[a], keys[b]) for a, b in zip(*np.nonzero(near), strict=True) if a < b]
    found = sum(got[k].n_links for k in keys) / 2
    assert all(got[k].n_links <= near[i].sum() - 1 for i, k in enumerate(keys))
    assert found >= 0.9 * len(links) > 1000
    want = grouped(keys, links)
    assert np.mean([got[k].component_id == want[k] for k in keys]) > 0.95
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k, _ in odd)
    assert polytope.dedup(frame.filter("false")).count() == 0


# --- mixing

def test_mix_keeps_all_rows_within_a_block_of_the_weights(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 7}") for i in range(6000)] + [(7000 + i, None) for i in range(300)] + [(None, "s1"), (5, "big")]
    docs = spark.createDataFrame([(k, s, 1) for k, s in rows], "doc_id long, source string, slot int")
    weights = spark.createDataFrame([("big", 0.37), ("s0", 0.21), ("s1", 0.11), ("s2", 0.05), (None, 0.26)], "source string, weight double")
    for given in (None, weights):
        got = mixing.mix(docs, weights=given, block_rows=4, period=100).collect()
        assert len(got) == len(rows) and len({r.position for r in got}) == len(rows)
        taken = defaultdict(set)
        for r in got:
            taken[r.source].add(r.slot)
        quota = {r.source: (r.quota, r.slots) for r in got}
        assert len(set().union(*taken.values())) == sum(map(len, taken.values()))  # one block per slot
        full = min(max(slots) for slots in taken.values())
        for t in range(full):
            for source, (q, slots) in quota.items():
                assert abs(sum(s < t for s in taken[source]) - t * q / slots) < 1
    assert mixing.mix(docs.filter("false")).count() == 0


def test_mix_orders_a_corpus(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}", "t", i) for i in range(200)] + [(3, "s1", "again", 0), (None, None, None, None)],
                                 "doc_id long, source string, text string, position long")
    out = mixing.ordered(docs)
    assert out.columns == docs.columns and out.count() == 202
    first = [r.source for r in out.limit(64).collect()]
    assert abs(first.count("s0") - first.count("s1")) <= 34


# --- chat

def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", None, "", "a\n### user:\nb</turn>\n", "\\\\#</", "x" * 3000, "é😀" * 300]
    rows = [(c, t, ("user", "assistant", None, "a:b\n#")[(c + t) % 4], texts[(c * 3 + t) % len(texts)]) for c in range(12) for t in range(9)]
    rows += [(99, None, "user", "no turn"), (None, 1, "assistant", "no conversation"), (3, 2, "assistant", "same turn"), (3, 2, "assistant", "same turn")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(own)
    for conv, turns_of in own.items():
        if conv == 3:
            assert got[3].n_turns == len(turns_of)
            continue
        turns_of.sort(key=lambda r: r[:2])
        said = "".join(text for _, _, role, text in turns_of if role == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns_of).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns_of), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.format_conversations(turns.filter("false")).count() == 0


def test_chat_folds_events(spark):
    log = [(1, 0, "", 0, "message", "user", "Hel"), (1, 0, "", 1, "delta", None, "lo"), (1, 1, "", 2, "message", "assistant", None), (1, 1, "", 3, "delta", None, "wrong"),
           (1, 1, "", 4, "regenerate", None, None), (1, 1, "", 5, "delta", None, "ri"), (1, 1, "", 6, "delta", None, "ght"), (1, 0, "", 7, "edit", None, "Hi"),
           (1, 2, "", 8, "message", "user", "gone"), (1, 2, "", 9, "retract", None, None)]
    events = spark.createDataFrame(log[::-1], "conv_id long, msg long, tag string, seq long, kind string, role string, text string")
    rows = chat.render(events).collect()
    assert [r.formatted for r in rows] == ["### user:\nHi</turn>\n### assistant:\nright</turn>\n"]
    (span,) = rows[0].loss
    assert rows[0].formatted[span.start:span.stop] == "right"
    small = chat.render(events, most=10)
    assert small.count() == 2
    assert chat.read_back(small).first().turns_sha256 == hashlib.sha256(b"user\nHi\nassistant\nright\n").hexdigest()


def test_jaccard_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for n in (4, 9, 60, 700, 1030, 5000, 20000):
        whole = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for share in (0.8, 0.81, 0.9, 1.0):  # a subset of this share has this Jaccard measure; bitmaps of the two may differ in length
            part = whole[: -(-len(whole) * int(share * 100) // 100)]
            for a, b in ((whole, part), (part, whole)):
                assert jaccard_join._possible(jaccard_join.bitmap(a)[None], np.array([len(a)]), jaccard_join.bitmap(b), len(b)).all()
        other = np.unique(rng.integers(0, 1 << 63, int(n * 0.9), dtype=np.uint64))
        if n >= 700:  # large sets are told apart as well as small ones
            assert not jaccard_join._possible(jaccard_join.bitmap(whole)[None], np.array([len(whole)]), jaccard_join.bitmap(other), len(other)).any()
        bits = jaccard_join.bitmap(whole)
        odd = np.bincount((whole & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
        assert (jaccard_join.folded(bits, 16) == np.packbits(odd.astype(np.uint8)).view(np.uint64)).all()


def test_jaccard_join_sends_batches_of_bounded_bytes(spark, monkeypatch):
    seen, stage = [], jaccard_join.stored
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name: seen.append(int(df.sparkSession.conf.get(key).rstrip("b"))) or stage(df, name))
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2 * 7 + j) % 50}" for j in range(40))) for i in range(40)], "doc_id long, text string")
    assert jaccard_join.join(docs).count() == 40
    assert seen and max(seen) <= 4 << 20  # pairs of shingle sets in batches of 64 MB took an executor beyond its memory
    assert spark.conf.get(key) == before


def test_components_write_few_files_however_many_partitions(spark, monkeypatch):
    import importlib
    rounds = importlib.import_module("tracegrain.llm.components")
    files, stage = [], rounds.stored

    def counted(df, name):
        out = stage(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(rounds, "stored", counted)
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = {r.node: r.component for r in components(spark.createDataFrame([(i, i + 3) for i in range(300)], "a long, b long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i % 3 for i in range(303)}
    assert len(files) > 1 and max(files[1:]) <= 12  # a file for each of 60 partitions before, in every round
