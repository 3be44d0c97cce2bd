"""Byte-level BPE encoding and decoding (operator 2).

A segment tree over the byte positions of a pre-token holds, at each leaf, the merge rank of the token that starts there
with its right neighbour; an inner node holds the smaller rank of its children.  The root gives the next merge, a descent
that prefers the left child finds its leftmost place, and the merge changes three leaves: the pair itself, the pair before it
and the pair that disappears.  A pre-token of n bytes takes O(n log n), also when it is 100,000 bytes long.

Pre-tokens are encoded independently, so rows are the unit of work: one narrow Arrow pass, no shuffle, no state beyond a
bounded cache of short pre-tokens in each Python worker, which a lost worker rebuilds.

Defined results: a null or empty text has no tokens and decodes to no bytes.  Repeated rows give repeated results; other
columns of the input are not read.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces, released
from .pretokens import split

RANK_FILE = "byte_bpe_50k.tiktoken"
CACHE_ENTRIES = 150_000
CACHE_CHARS = 64
_NO_PAIR = 1 << 60


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 0:
        return []
    size = 1 << (n - 1).bit_length()
    rank_of = ranks.get
    tree = [_NO_PAIR] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = rank_of(piece[i:i + 2], _NO_PAIR)
    for k in range(size - 1, 0, -1):
        low, other = tree[2 * k], tree[2 * k + 1]
        tree[k] = low if low <= other else other

    end = list(range(1, n + 1))  # the token that starts at i covers piece[i:end[i]]
    before = list(range(-1, n))  # start of the token that ends where the one at i starts
    best = tree[1]
    while best != _NO_PAIR:
        k = 1
        while k < size:  # the left child first: of equal ranks the leftmost pair is merged
            k *= 2
            if tree[k] != best:
                k += 1
        left = k - size
        right = end[left]
        stop = end[left] = end[right]
        before[stop] = left
        changes = [(right, _NO_PAIR), (left, rank_of(piece[left:end[stop]], _NO_PAIR) if stop < n else _NO_PAIR)]
        if left:
            changes.append((before[left], rank_of(piece[before[left]:stop], _NO_PAIR)))
        for leaf, low in changes:
            k = size + leaf
            if tree[k] == low:
                continue
            tree[k] = low
            while k > 1:
                other = tree[k ^ 1]
                if other < low:
                    low = other
                k >>= 1
                if tree[k] == low:
                    break
                tree[k] = low
        best = tree[1]
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at:end[at]]])
        at = end[at]
    return ids


class Codec(dict):
    """Packed ids (little-endian, 32 bits each) by pre-token: a cache that fills itself.

    It holds two generations of at most CACHE_ENTRIES pre-tokens; a full young one becomes the old one, whose entries return
    when they are asked for again.
    """

    def __init__(self, rank_file: str):
        super().__init__()
        with open(rank_file, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.old: dict[str, bytes] = {}

    def __missing__(self, pretoken: str) -> bytes:
        packed = self.old.get(pretoken)
        if packed is None:
            packed = array("I", merge(pretoken.encode("utf-8"), self.ranks))
            if sys.byteorder == "big":
                packed.byteswap()
            packed = packed.tobytes()
        if len(pretoken) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[pretoken] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def codec(rank_file: str) -> Codec:
    """One codec per Python worker."""
    return Codec(rank_file)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", rank_file: str | None = None, decode: bool = False) -> DataFrame:
    """`key`, `ids` (binary: little-endian unsigned 32-bit token ids) and, with `decode`, `decoded` (the bytes those ids stand for)."""
    path = rank_file or public_tokenizers.path(RANK_FILE)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.BinaryType())]
    if decode:
        fields.append(T.StructField("decoded", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in released(batches):
            for part in pieces(batch, "text"):
                packed = [own.encode(t) for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array(packed, pa.binary())]
                if decode:
                    columns.append(pa.array(map(own.decode, packed), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", rank_file: str | None = None) -> DataFrame:
    """`key` and `decoded` (binary) of packed ids; null ids decode to no bytes."""
    path = rank_file or public_tokenizers.path(RANK_FILE)
    rows = encoded.select(F.col(key), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in released(batches):
            for part in pieces(batch, "ids"):
                texts = [own.decode(p) for p in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], names=[key, "decoded"])

    return rows.mapInArrow(run, T.StructType([T.StructField(key, encoded.schema[key].dataType), T.StructField("decoded", T.BinaryType())]))


def digests(docs: DataFrame, rank_file: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, and the digests of its ids and of what they decode to."""
    coded = encode(docs, rank_file=rank_file, decode=True)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
