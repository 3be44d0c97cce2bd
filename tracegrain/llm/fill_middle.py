"""Fill-in-the-middle transformation of texts (operator 11), a pipeline of pyarrow.compute over batches.

Every text is cut into code points, which become a list array over the text's own buffer; flattened, each unit knows its
parent and its ordinal, two cut points per text give it a role (prefix, middle, suffix), units are filtered by role and rebuilt
into lists, and binary_join makes the three pieces, which are joined with the marks of the text's form.

* plain: the text as it is (no cuts, or the text holds a mark, so that a reader could not tell its own from the text's)
* psm: `<P>`prefix`<S>`suffix`<M>`middle
* spm: `<S>`suffix`<P>`prefix`<M>`middle

`restore` rebuilds the text from output and form alone.  A mark begins with `<`, ends with `>` and holds neither inside, so none arises
where a piece meets a mark, and the first of each kind is the one that was set.

Rows are independent: two narrow Arrow passes, no shuffle, batches of at most a few megabytes of text or a single text.

Defined results: a null or empty text is plain and empty; its cuts are null.  A null id draws its numbers as the empty string.
Repeated rows give repeated results; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_SHARE = 10
SPM_SHARE = 20
SEED = 1
_MARK = "<[PSM]>"


def draws(key: Column, seed: int = SEED, count: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers of a row: 8-digit groups of the hex sha256 of `seed:key`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def units(texts: pa.Array) -> pa.ListArray:
    """The code points of each text, as lists over the bytes of the texts."""
    texts = pa.concat_arrays([texts])  # a slice of its own, offsets from its buffer
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset:]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    starts = np.flatnonzero((raw[offsets[0]:] & 0xC0) != 0x80).astype(np.int32) + offsets[0]
    values = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, offsets[-1]).astype(np.int32)), data if data is not None else pa.py_buffer(b""))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offsets).astype(np.int32)), values)


def cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Prefix, middle and suffix of each text, which end after `first`, `second` and all of its units."""
    lists = units(texts)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begins = pa.array(np.asarray(lists.offsets)[:-1].astype(np.int64))
    ordinal = pc.subtract(pa.array(np.arange(len(flat), dtype=np.int64)), pc.take(begins, parent))
    after_first = pc.greater_equal(ordinal, pc.take(first, parent))
    after_second = pc.greater_equal(ordinal, pc.take(second, parent))

    def joined(role: pa.Array) -> pa.Array:
        own = np.bincount(np.asarray(pc.filter(parent, role)), minlength=len(texts))
        bounds = pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(bounds, pc.filter(flat, role)), "")

    return joined(pc.invert(after_first)), joined(pc.and_(after_first, pc.invert(after_second))), joined(after_second)


def _chosen(n: pa.Array, h: list[pa.Array], has_mark: pa.Array, plain_share: int, spm_share: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Form, and the two cut points in order."""
    cuts = [pa.array(np.asarray(x) % (np.asarray(n) + 1)) for x in h[:2]]
    percent = [pa.array(np.asarray(x) % 100) for x in h[2:]]
    plain = pc.or_(pc.or_(pc.equal(n, 0), has_mark), pc.greater_equal(percent[0], 100 - plain_share))
    form = pc.if_else(plain, "plain", pc.if_else(pc.less(percent[1], spm_share), "spm", "psm"))
    return form, pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """`key`, `n` (code points), `form`, `prefix_chars`, `middle_chars` and `output` of every row."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col(key), seed), 1)])
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, texts, *h = part.columns
                n = pc.utf8_length(texts).cast(pa.int64())
                form, first, second = _chosen(n, h, pc.match_substring_regex(texts, _MARK), plain_share, spm_share)
                plain = pc.equal(form, "plain")
                prefix, middle, suffix = cut(texts, first, second)
                psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
                spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
                output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, "spm"), spm, psm))
                none = pa.scalar(None, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, n, form, pc.if_else(plain, none, first), pc.if_else(plain, none, pc.subtract(second, first)), output], names=schema.names)

    return rows.mapInArrow(run, schema)


def _halves(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    """What stands before the first `mark`, and what follows it."""
    halves = pc.split_pattern(texts, mark, max_splits=1)
    return pc.list_element(halves, 0), pc.list_element(halves, 1)


def rebuilt(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts from outputs and forms."""
    def inside(name: str) -> pa.Array:  # without the mark at the beginning
        return pc.utf8_slice_codeunits(pc.filter(output, pc.equal(form, name)), start=len(PREFIX))

    prefix, rest = _halves(inside("psm"), SUFFIX)
    suffix, middle = _halves(rest, MIDDLE)
    psm = pc.binary_join_element_wise(prefix, middle, suffix, "")
    suffix, rest = _halves(inside("spm"), PREFIX)
    prefix, middle = _halves(rest, MIDDLE)
    spm = pc.binary_join_element_wise(prefix, middle, suffix, "")
    out = pc.replace_with_mask(output, pc.equal(form, "psm"), psm)
    return pc.replace_with_mask(out, pc.equal(form, "spm"), spm)


def restore(outputs: DataFrame) -> DataFrame:
    """The rows of `outputs` (form, output and any columns) with `restored`, the text that each output was made from."""
    schema = T.StructType([f for f in outputs.schema.fields if f.name != "restored"] + [T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "output"):
                text = rebuilt(part.column("output"), part.column("form"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in schema.names[:-1]), text], names=schema.names)

    return outputs.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, and the digests of the output and of the text rebuilt from it."""
    return restore(transform(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))
