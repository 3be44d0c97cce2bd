"""Byte-level BPE and token counts against the tokenizer libraries."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracegrain.llm import bpe, pretokens, token_counts

TEXTS = [None, "", " ", "a", "The cat's  sat\n\n on 12 mats!", "naïve café — 東京 ١٢٣", "<|endoftext|> x <|endoftext|>", "x" * 3000, " \t\n" * 50,
         "՘ new letters ꟒\U00010ec5", "a b\x85c\xa0d", "😀👩‍👩‍👧", "It'S they'LL we've", "ab" * 700 + " " * 40]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(bpe.RANK_FILE), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def table(spark, texts):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(None, "no id", None, None), (0, texts[0], "x", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens double")


def test_encode_and_decode(spark, library):
    got = bpe.digests(table(spark, TEXTS)).collect()
    assert len(got) == len(TEXTS) + 2
    texts = dict(enumerate(TEXTS)) | {None: "no id"}
    for row in got:
        text = texts[row.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_decode_reads_what_encode_wrote(spark):
    docs = table(spark, TEXTS[4:6])
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {0: TEXTS[4], 1: TEXTS[5], None: "no id"}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_split_and_merge_match_the_library(library, text):
    own = bpe.codec(public_tokenizers.path(bpe.RANK_FILE))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()
    assert "".join(pretokens.split(text)) == text


def test_merge_prefers_the_leftmost_of_equal_ranks():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"aab": 3}
    assert bpe.merge(b"aaab", ranks) == [2, 0, 1] or bpe.merge(b"aaab", ranks) == [0, 3]
    assert bpe.merge(b"aaa", ranks) == [2, 0]
    assert bpe.merge(b"", ranks) == []


def test_empty_table(spark):
    none = table(spark, TEXTS).filter("false")
    assert bpe.digests(none).count() == 0
    assert token_counts.over_limit(none).count() == 0


@pytest.mark.parametrize("table_size", [1, 500])
def test_token_counts(spark, table_size):
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER_FILE))
    docs = table(spark, TEXTS)
    texts = dict(enumerate(TEXTS)) | {None: "no id"}
    got = token_counts.count_tokens(docs, table_size=table_size).collect()
    assert len(got) == len(TEXTS) + 2
    for row in got:
        text = texts[row.doc_id] or ""
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))


def test_over_limit(spark):
    docs = spark.createDataFrame([(1, "word " * 1024), (2, "word " * 900)], "doc_id long, text string")
    assert {r.doc_id: r.over_limit for r in token_counts.over_limit(docs).collect()} == {1: True, 2: False}
