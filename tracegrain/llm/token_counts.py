"""Token counts by a two-tier lookup (operator 5).

Tier one is a table of the corpus's most frequent words with their token counts.  One pass over all documents feeds a frequent-items
sketch (`approx_top_k`) whose size is a parameter: sketches, never pre-tokens, are merged across tasks.  The table
(at most `table_size` entries) goes to the workers with the task.  Tier two is a bounded cache in each Python worker for
everything else, filled by the tokenizer library itself.  The table only saves work; counts do not depend on it.

Texts in Latin scripts are cut by explicit character classes, others by the library's own pre-tokenizer, whose Unicode tables
are older than Python's.  The strings of special tokens inside a text count as one token each, which is the library's default.

Defined results: a null or empty text has no bytes and no tokens.  Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .arrow import pieces
from .pretokens import is_latin, split_latin

TOKENIZER_FILE = "byte_bpe_50k.json"
LIMIT = 1024
TABLE_SIZE = 20_000
SKETCH_ITEMS = 60_000
MERGE_WIDTH = 64
CACHE_ENTRIES = 400_000
CACHE_CHARS = 64


class Lengths(dict):
    """Token count by pre-token: the table of frequent ones for good, and a cache of others in two bounded generations."""

    def __init__(self, tokenizer_file: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.frequent: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def seed(self, words: list[str], counts: list[int]) -> None:
        self.frequent = dict(zip(words, counts, strict=True))
        self.old = {}
        self.clear()
        self.update(self.frequent)

    def __missing__(self, pretoken: str) -> int:
        n = self.old.get(pretoken)
        if n is None:
            n = len(self.tokenizer.encode(pretoken, add_special_tokens=False).ids)
        if len(pretoken) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES + len(self.frequent):
                self.old = dict(self)
                self.clear()
                self.update(self.frequent)
            self[pretoken] = n
        return n

    def pretokens(self, text: str) -> list[str]:
        if is_latin(text):
            return split_latin(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.pretokens(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self[p] for part in parts for p in self.pretokens(part))


@lru_cache(maxsize=2)
def lengths(tokenizer_file: str) -> Lengths:
    """One lookup per Python worker."""
    return Lengths(tokenizer_file)


def frequent_words(docs: DataFrame, text: str = "text", table_size: int = TABLE_SIZE, sketch_items: int = SKETCH_ITEMS) -> list[str]:
    """The most frequent blank-separated words of all texts, by one bounded sketch per task, merged in two steps; at most `table_size`."""
    words = docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), " ")).alias("w")).filter(F.length("w").between(1, CACHE_CHARS))
    parts = words.groupBy((F.spark_partition_id() % MERGE_WIDTH).alias("part")).agg(F.expr(f"approx_top_k_accumulate(w, {sketch_items})").alias("s"))
    # grouped by a column that is always true, which gives no row, and no sketch to read, for an empty table
    whole = parts.groupBy((F.col("part") >= 0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {sketch_items})").alias("s"))
    top = whole.select(F.expr(f"approx_top_k_estimate(s, {table_size})").alias("top")).collect()
    return [row["item"] for row in top[0]["top"]] if top else []


def frequent_lengths(words: list[str], tokenizer_file: str) -> tuple[list[str], list[int]]:
    """Pre-tokens of the frequent words, with and without the blank before them, and their token counts."""
    own = lengths(tokenizer_file)
    found = sorted({p for w in words for form in (w, " " + w) if own.special is None or not own.special.search(form) for p in own.pretokens(form)})
    coded = own.tokenizer.encode_batch(found, add_special_tokens=False)
    return found, [len(c.ids) for c in coded]


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_file: str | None = None,
                 table_size: int = TABLE_SIZE) -> DataFrame:
    """`key`, `n_bytes` (UTF-8) and `n_tokens` of every row."""
    path = tokenizer_file or public_tokenizers.path(TOKENIZER_FILE)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(frequent_words(docs, text, table_size), path))
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lengths(path)
        words, counts = table.value
        if len(own.frequent) != len(words) or any(w not in own.frequent for w in words):
            own.seed(words, counts)
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                     pa.array(map(own.count, texts), pa.int64())], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def over_limit(docs: DataFrame, limit: int = LIMIT, tokenizer_file: str | None = None) -> DataFrame:
    """Counts per document and whether they exceed `limit`."""
    return count_tokens(docs, tokenizer_file=tokenizer_file).withColumn("over_limit", F.col("n_tokens") > limit)
