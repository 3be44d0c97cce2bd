"""Fingerprints, license scan, line chunks and toxicity against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import regex

from tracegrain.llm import licenses, line_chunks, spotsigs, toxicity

SCHEMA = "doc_id long, text string, words string, label string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "w", "l") for i, t in rows], SCHEMA)


# --- fingerprints

def spots(text):
    words, common = regex.findall(r"[\p{L}\p{N}]+", text.lower()), set(spotsigs.COMMON_WORDS)
    chain = [(w, words[i - 1] if i else "the") for i, w in enumerate(words) if w not in common]
    found = {(before, w, chain[i + 1][0] if i + 1 < len(chain) else None) for i, (w, before) in enumerate(chain) if before in common}
    return found or ({text} if text else set())


def jaccard(a, b):
    return float(a == b) if not a or not b else len(a & b) / len(a | b)


def test_fingerprints_of_edited_texts(spark):
    base = "The quick fox and the lazy dog went to a river with the old cat from a far town"
    texts = [(5, base), (1, None), (2, ""), (3, "the of and"), (4, base), (9, "ß für die Straße und der Weg"), (7, "!!!"), (8, base + " x" * 4000)]
    got = {r.doc_id: r for r in spotsigs.compare_edited(table(spark, texts)).collect()}
    rows = sorted((i, t or "") for i, t in texts)
    assert len(got) == len(rows)
    for at, (key, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        edited, row = text[:len(text) - half] + following[:half], got[key]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.near_edited == pytest.approx(jaccard(spots(text), spots(edited)))
        assert row.near_next == pytest.approx(jaccard(spots(text), spots(following)))
    assert got[4].fingerprint == got[5].fingerprint != ""
    assert got[2].fingerprint == "" and got[7].fingerprint != ""


def test_fingerprints_cover_texts_without_common_words(spark):
    rng = random.Random(14)
    body = lambda: [f"kod{rng.randrange(10 ** 6)}" for _ in range(60)]
    one, two = body(), body()
    edited = one[:30] + ["other"] + one[31:]
    texts = [" ".join(["shared", "heading", *words]) for words in (one, two, edited)]
    got = {r.doc_id: set(r.signatures) for r in spotsigs.fingerprints(table(spark, list(enumerate(texts)))).collect()}
    assert all(len(s) > 8 for s in got.values())
    assert jaccard(got[0], got[1]) < 0.2 and 0.6 < jaccard(got[0], got[2]) <= 1


def test_fingerprints_without_rows_or_ids(spark):
    assert spotsigs.compare_edited(table(spark, [(1, "a b")]).filter("false")).count() == 0
    assert spotsigs.compare_edited(table(spark, [(None, "a"), (None, "b"), (1, "c"), (1, "c")])).count() == 4


def test_near_pairs_finds_all(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for family in range(6):
        base = [rng.choice(["the", "of", "a"]) if i % 3 == 0 else rng.choice(vocabulary) for i in range(120)]
        for copy in range(5):
            words = list(base)
            for _ in range(copy * 2):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(words)))
    docs.append((len(docs), docs[0][1]))
    prints = spotsigs.fingerprints(table(spark, docs))
    pairs, members = spotsigs.near_pairs(prints)
    sets = {i: spots(t) for i, t in docs[:-1]}
    wanted = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    assert {tuple(sorted((r.a, r.b))) for r in pairs.collect()} == wanted and wanted
    assert {r.doc_id: r.rep for r in members.collect()}[len(docs) - 1] == 0


# --- licenses

def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for label, phrase in licenses.BASE_PHRASES:
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i:i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    texts = [None, "", "mit", "Under the MIT License.", "under-the mit_license under the MIT licence", "UNDER THE MIT LICENSE " * 300,
             "Apache License, Version 2.0 and CC BY-NC 4.0; under the mit license", "cc by nc cc by nc by nc", "ünder the mit license", "Under the mit licenseK",
             "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met:",
             "permission granted to copy", "İ under the mit licenſe"]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    got = licenses.scan(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for row in got:
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == plain_scan(texts[row.doc_id]), row
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) and 0 <= row.score <= 1
    labels = {r.doc_id: r.labels for r in got}
    assert labels[10] == "bsd" and labels[11] == "" and labels[6] == "apache-2,cc-by-nc,mit"
    assert licenses.scan(table(spark, rows).filter("false")).count() == 0


# --- line chunks

def plain_dedup(rows):
    first, out = {}, {}
    for key, text in sorted((k, t) for k, t in rows if t is not None):
        for start, _, end, removable in line_chunks.chunks(text):
            if removable:
                first.setdefault(text[start:end], (key, start))
    for key, text in rows:
        if text is None:
            out[key] = None
            continue
        kept, gone = "", False
        for start, stop, end, removable in line_chunks.chunks(text):
            gone = removable and first[text[start:end]] != (key, start)
            kept += "" if gone else text[start:stop]
        out[key] = kept[:-1] if gone and kept.endswith("\n") else kept
    return out


def test_line_dedup(spark):
    rng = random.Random(1)
    line = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    passage = "\n".join(line(14) for _ in range(12))
    long_line = line(60)
    rows = [(0, None), (1, ""), (2, "\n\n\n"), (3, "short\nlines"), (4, "short\nlines")]
    rows += [(10 + i, "\n".join([line(8) for _ in range(rng.randrange(5))] + [passage] + [line(9) for _ in range(rng.randrange(5))])) for i in range(20)]
    rows += [(40 + i, f"{line(5)}\n{long_line}\n{line(6)}") for i in range(3)] + [(50, passage), (51, passage), (52, "same line here\n" * 400)]
    got = {r.doc_id: r.text for r in line_chunks.line_dedup(table(spark, rows)).collect()}
    assert got == plain_dedup(rows)
    assert sum(long_line in (t or "") for t in got.values()) == 1
    inner = passage.split("\n")[6]
    assert sum((t or "").count(inner) for t in got.values()) == 1


def plain_runs(rows, least):
    """Every run of lines, by brute force; one that begins inside its own first place goes from that place's end on."""
    def spans(text):
        lines, at = text.split("\n"), [0]
        for line in lines:
            at.append(at[-1] + len(line) + 1)
        words = [len(line.split()) for line in lines]
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(words[i:j + 1]) >= least:
                    yield i, j, text[at[i]:at[j + 1] - 1]

    first, out = {}, {}
    for key, text in sorted(rows):
        for i, _, run in spans(text):
            first.setdefault(run, (key, i))
    for key, text in rows:
        gone = set()
        for i, j, run in spans(text):
            first_key, at = first[run]
            if (first_key, at) != (key, i):
                gone.update(range(max(i, at + j - i + 1) if first_key == key else i, j + 1))
        lines = text.split("\n")
        out[key] = "\n".join(line for x, line in enumerate(lines) if x not in gone)
    return out


def test_line_dedup_removes_whole_runs_between_other_lines(spark, monkeypatch):
    monkeypatch.setattr(line_chunks, "chunks", lambda text: iter(()))
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    passages = [[line(rng.choice([0, 1, 9, 17, 26, 40, 49, 55])) for _ in range(rng.randrange(1, 9))] for _ in range(12)]
    rows = []
    for key in range(60):
        lines = [line(rng.randrange(1, 20)) for _ in range(rng.randrange(3))]
        for _ in range(rng.randrange(1, 4)):
            own = rng.choice(passages)
            a = rng.randrange(len(own))
            lines += own[a:] if rng.random() < 0.3 else own
            lines += [line(rng.randrange(1, 20)) for _ in range(rng.randrange(3))]
        rows.append((key, "\n".join(lines)))
    rows.append((70, "same line here\n" * 40))
    got = {r.doc_id: r.text for r in line_chunks.line_dedup(table(spark, rows), run_words=50).collect()}
    want = plain_runs(rows, 50)
    worded = lambda texts: {k: [x for x in t.split("\n") if x] for k, t in texts.items()}
    assert worded(got) == worded(want)


def test_line_dedup_leaves_no_part_of_a_repeated_passage(spark):
    rng = random.Random(7)
    line = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    for lines in (2, 3, 5, 10):
        passage = [line(30) for _ in range(lines)]
        rows = [(i, "\n".join([line(8), *passage, line(9)])) for i in range(20)]
        got = {r.doc_id: r.text for r in line_chunks.line_dedup(table(spark, rows), run_words=line_chunks.RUN_WORDS).collect()}
        assert got[0] == rows[0][1]
        assert all(got[i].split("\n") == [t.split("\n")[0], t.split("\n")[-1]] for i, t in rows[1:])


def test_line_dedup_keeps_other_columns_and_repeated_rows(spark):
    text = "\n".join(f"some words of line {i} of many" for i in range(8))
    docs = spark.createDataFrame([(1, text, "start", 3, 9), (1, text, "start", 3, 9), (2, text, "stop", 4, 9), (None, None, None, None, None)],
                                 "doc_id long, text string, hash string, key int, n_chars long")
    done = line_chunks.without_repeats(docs)
    assert done.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r.hash) for r in done.collect() if r.doc_id) == [(1, text, "start")] * 2
    assert line_chunks.without_repeats(docs.filter("false")).count() == 0


def test_boundaries_resist_shifts():
    lines = [f"line {i} with some words" for i in range(200)]
    cut = {("\n".join(lines))[a:e] for a, _, e, _ in line_chunks.chunks("\n".join(lines))}
    moved = "\n".join(["new first line"] + lines)
    assert len(cut - {moved[a:e] for a, _, e, _ in line_chunks.chunks(moved)}) <= 2


# --- toxicity

def test_toxicity_learns_held_out_labels_and_sentences(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(1200):
        sentences = [" ".join(f"ok{rng.randrange(300)}" for _ in range(8)) for _ in range(rng.randrange(1, 9))]
        toxic = rng.random() < 0.3
        if toxic:
            sentences[rng.randrange(len(sentences))] += f" badword{rng.randrange(60)}"
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    docs += [(5000, None), (5001, ""), (5002, "x " * 50000)]
    frame = table(spark, docs)
    got = {r.doc_id: r for r in toxicity.predict(frame, spark.createDataFrame(labels + [(None, 1), (7000, None)], "doc_id long, toxic int")).collect()}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i].predicted == dict(labels)[i] for i in held) / len(held) > 0.97
    text = dict(docs)
    found = [i for i in held if dict(labels)[i] and got[i].predicted]
    assert all("badword" in text[i][got[i].worst_start:got[i].worst_stop] for i in found)
    kept = {r.doc_id for r in toxicity.reject(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def test_toxicity_of_long_clean_texts():
    rng = random.Random(12)
    plain = lambda: " ".join(f"ok{rng.randrange(300)}" for _ in range(8))
    texts, labels = [], []
    for i in range(900):
        own = [plain() + (" current" if rng.random() < 0.05 else "") for _ in range(rng.randrange(1, 30))]
        if i % 3 == 0:
            own[rng.randrange(len(own))] += " curse"
        texts.append(". ".join(own))
        labels.append(int(i % 3 == 0))
    scorer = toxicity.Scorer(*toxicity.fit(texts, labels))
    long = [plain() + (" current" if i % 20 == 0 else "") for i in range(50_000)]
    assert scorer["curse"] > scorer["current"] > 0
    assert scorer.score(". ".join(long))[0] < 0.5 and scorer.score(". ".join([plain()] * 50_000))[0] < 0.5
    long[49_000] += " curse"
    text = ". ".join(long)
    score, a, b = scorer.score(text)
    assert score >= 0.5 and "curse" in text[a:b]


def test_noisy_or_against_plain_sums():
    weights, leak = {f: 1.5 for f in toxicity.features("vile")} | {toxicity.features("mild")[0]: 2.0}, -4.0
    scorer = toxicity.Scorer(weights, leak)

    def plain(text):
        g = lambda z: math.log1p(math.exp(toxicity.BIAS + z)) - math.log1p(math.exp(toxicity.BIAS))
        stays = 1 - 1 / (1 + math.exp(-leak))
        for sentence in re.split(r"[.!?\n]", text.lower()):
            z = sum(weights.get(f, 0.0) for w in set(re.findall(r"\w+", sentence)) for f in toxicity.features(w))
            stays *= math.exp(-g(z) ** 2)
        return 1 - stays

    near, far = "mild word. " * 8 + "plain words here. " * 400, ("mild word. " + "plain words here. " * 50) * 8
    for text in ("", "Vile. mild mild!", "a mild day\nof vile things? yes", near, far):
        assert math.isclose(scorer.score(text)[0], plain(text), rel_tol=1e-9)
    assert math.isclose(scorer.score(near)[0], scorer.score(far)[0], rel_tol=1e-9)  # where evidence stands does not matter


def test_slopes_of_the_loss():
    rng = np.random.default_rng(8)
    weights, leak, y = rng.random(6) * 3, -3.0, np.array([1, 0, 1, 0])
    doc_of = np.array([0, 0, 1, 2, 2, 2, 3])
    sentence_of, feature_at = rng.integers(0, 7, 25), rng.integers(0, 6, 25)

    def plain(w, leak):
        loss = 0.0
        for d, label in enumerate(y):
            stays = 1 - 1 / (1 + math.exp(-leak))
            for s in np.flatnonzero(doc_of == d):
                z = w[feature_at[sentence_of == s]].sum()
                stays *= math.exp(-(math.log1p(math.exp(toxicity.BIAS + z)) - math.log1p(math.exp(toxicity.BIAS))) ** 2)
            loss -= math.log(1 - stays if label else stays)
        return loss / len(y) + 0.01 / 2 * (w ** 2).sum()

    loss, slopes, slope_leak = toxicity.loss_and_slopes(weights, leak, feature_at, sentence_of, doc_of, y, 0.01)
    assert math.isclose(loss, plain(weights, leak), rel_tol=1e-9)
    step = 1e-6
    for i, slope in enumerate(slopes):
        moved = weights.copy()
        moved[i] += step
        assert math.isclose(slope, (plain(moved, leak) - loss) / step, rel_tol=1e-3, abs_tol=1e-5)
    assert math.isclose(slope_leak, (plain(weights, leak + step) - loss) / step, rel_tol=1e-3, abs_tol=1e-5)


def test_toxicity_learns_from_long_texts(spark):
    rng = random.Random(13)
    plain = " ".join(f"ok{i % 300}" for i in range(3000))
    docs = [(i, f"{plain} {rng.random()}." + " foulword now." * (i % 2)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    weights, _ = toxicity.train(table(spark, docs), labels)
    assert all(len(t) > 12_000 for _, t in docs) and weights[toxicity.features("foulword")[0]] > 0
    assert toxicity.train(table(spark, docs), labels, chars=20_000)[0] == {}  # one text fits: one kind of label


def test_toxicity_without_labels(spark):
    frame = table(spark, [(1, "a. b"), (1, "a. b"), (None, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.predict(frame, none).collect()
    assert len(got) == 3 and all(r.predicted == 0 for r in got)
    assert toxicity.predict(frame.filter("false"), none).count() == 0


def test_line_dedup_keeps_the_first_place_of_a_repeat_that_overlaps_it(spark):
    line = "thirteen equal words " * 6 + "end"
    texts = {1: "\n".join([line] * 10), 2: "\n".join(["own words"] + [line] * 3 + ["last one"]), 3: "\n".join([line] * 5)}
    got = {r.doc_id: r.text for r in line_chunks.line_dedup(table(spark, list(texts.items())), run_words=line_chunks.RUN_WORDS).collect()}
    assert got[1] == "\n".join([line] * 3)  # 57 words: the shortest run
    assert got[2] == "own words\nlast one" and got[3] == ""


def test_line_dedup_compares_bytes_where_hashes_agree(spark, monkeypatch):
    a, b = "\n".join(f"first text line {i} of words" for i in range(12)), "\n".join(f"other text line {i} of words" for i in range(12))
    monkeypatch.setattr(line_chunks, "_span_hash", lambda content: len(content).to_bytes(16, "little"))
    got = {r.doc_id: (r.text, r.removed_chars) for r in line_chunks.line_dedup(table(spark, [(1, a), (2, b), (3, a)]), run_words=line_chunks.RUN_WORDS).collect()}
    assert got[1] == (a, 0) and got[2] == (b, 0)

