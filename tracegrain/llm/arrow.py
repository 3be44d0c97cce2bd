"""Arrow batches in Python tasks, cut so that no batch of results holds more than a few megabytes of text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

BATCH_BYTES = 4 << 20


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; afterwards the worker, which lives on for other tasks, gives back the memory that Arrow holds for reuse."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()


def pieces(batch: pa.RecordBatch, text_column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of `batch` whose texts take `most` bytes or hold a single row."""
    column = batch.column(batch.schema.get_field_index(text_column))
    start, held = 0, 0
    for i, text in enumerate(column):
        size = 64 + (len(text.as_buffer()) if text.is_valid else 0)
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)
