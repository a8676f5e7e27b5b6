"""Working through (doc_id, text) Arrow batches within bounded memory."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: UTF-8 bytes that go to a tokenizer at once.
CHUNK_BYTES = 1 << 20


def texts(batch: pa.RecordBatch) -> list[str]:
    """The batch's texts; null is empty."""
    return [t or "" for t in batch.column("text").to_pylist()]


def byte_lengths(batch: pa.RecordBatch) -> list[int]:
    import pyarrow.compute as pc

    return [n or 0 for n in pc.binary_length(batch.column("text")).to_pylist()]


def balanced(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges [i, j) of about `most` bytes each; a larger item stands alone."""
    i = total = 0
    for j, n in enumerate(sizes):
        if j > i and total + n > most:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)


def give_back() -> None:
    """Free memory of this worker goes back to the system: idle workers of earlier stages share the executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow by `run`, after which each task gives its memory back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def by_group(df: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """applyInArrow by `run` to groups of bounded size, after each of which memory is given back."""

    def group(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return df.groupBy(*keys).applyInArrow(group, schema)
