"""The pipeline against its stages' plain meaning, on a small corpus."""

import base64
import random

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tracegrain.llm import mixing
from tracegrain.session import stored

from .test_groups import plain_join


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("corpus"))
    line = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage = "\n".join(line(15) for _ in range(10))
    docs = [(i, "\n".join(line(12) for _ in range(rng.randrange(2, 9)))) for i in range(400)]
    docs += [(1000 + i, docs[i][1]) for i in range(20)]  # exact copies
    docs += [(1100 + i, " ".join(docs[i][1].replace("\n", " ").split()[:-1])) for i in range(20, 40)]  # near copies
    docs += [(1200 + i, f"{line(10)}\n{passage}\n{line(11)}") for i in range(15)]
    toxic = [(2000 + i, f"{line(9)}. vile{i % 9} {line(4)}. {line(9)}") for i in range(300)]
    docs += toxic + [(3000, None), (3001, "")]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), "extra") for i, t in docs],
                          "doc_id long, text string, lang string, source string, n_chars long, node string").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i >= 2000)) for i, _ in docs if i < 3000 and (i >= 2000 or i < 400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), name)
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    clean = {r.doc_id for r in seen["toxicity"]}
    assert all(i < 2000 or i >= 3000 for i in clean) and len(clean) == 457
    lines = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert all("\n" not in lines.get(i, "") for i in range(1000, 1020))  # at most a single line, which is no chunk to remove
    assert set(range(400)) <= set(lines)
    assert {3000, 3001} <= set(lines)
    _, groups = plain_join([(i, t) for i, t in lines.items()])
    kept = {r.doc_id for r in seen["jaccard_join"]}
    assert kept == {i for i, c in groups.items() if i == c}
    assert {r.doc_id for r in seen["source_mix"]} == kept == {r.doc_id for r in seen["byte_bpe"]}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: r.n_tokens for r in seen["byte_bpe"]} == {i: len(library.encode_ordinary(lines[i] or "")) for i in kept}
    assert sorted(corpus_pipeline.run(spark, folder).collect()) == sorted(seen["byte_bpe"])


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_the_mix_decides_positions(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 300").withColumn("source", F.expr("if(doc_id % 10 < 7, 'a', 'b')"))
    own = {r.doc_id: r.position for r in corpus_pipeline.encode(spark, docs, folder).collect()}
    assert own == {r.doc_id: r.position for r in mixing.mix(docs).collect()} and len(own) == docs.count()
    plain = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda rows: plain(rows, exponent=-3.0))
    assert {r.doc_id: r.position for r in corpus_pipeline.encode(spark, docs, folder).collect()} != own
