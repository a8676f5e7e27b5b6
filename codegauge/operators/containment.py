"""Containment joins of spans: which spans of a file, or of any other group, lie inside which others."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge.operators.shared import HOT, checkpointed

#: Slices that the spans of a hot group are dealt to, by their starts.
SLICES = 64


def swept(rows: Iterator[tuple[int, int, int, int]]) -> Iterator[tuple[int, int]]:
    """(outer id, inner id) of sorted rows (start, whether outer, end, id); of equal starts inner spans come first.

    Open outer spans are kept by their ends. Those that have ended are dropped from the front, and those that end no earlier than an inner span
    are the tail of the list, so the time is that of sorting and of the pairs found.
    """
    opened: list[tuple[int, int]] = []
    for start, outer, end, number in rows:
        del opened[: bisect_left(opened, (start,))]
        if outer:
            insort(opened, (end, number))
        else:
            for _, container in opened[bisect_left(opened, (end,)) :]:
                yield container, number


def within(outer: DataFrame, inner: DataFrame, keys: list[str], start: str = "start", end: str = "end", number: str = "id") -> DataFrame:
    """keys, outer_id, inner_id: for each outer span the inner spans of its group that begin after its start and end no later than it.

    outer, inner: keys, start, end, and a number (long) each. Spans meet in one sweep over a group's starts, sorted by Spark. A group
    with more than 1 / HOT of all inner spans is swept in slices of about as many inner spans each; an outer span goes to the slices that it reaches.
    Nulls in start, end or the keys match nothing, and spans that end before they start contain nothing and are in nothing. The pairs are
    the result; nothing larger is made on the way.
    """
    names = [f"_k{i}" for i in range(len(keys))]

    def spans(df: DataFrame, is_outer: int) -> DataFrame:
        rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"), F.col(number).cast("long").alias("_i"), F.lit(is_outer).alias("_o"))
        cond = F.col("_e") >= F.col("_s")
        for n in names:
            cond = cond & F.col(n).isNotNull()
        return rows.where(cond)

    a, b = spans(outer, 1), spans(inner, 0)
    total = b.count()
    hot = checkpointed(b.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(SLICES, total // HOT)).select(*names))  # fewer than HOT rows
    quantiles = F.percentile_approx("_s", [i / SLICES for i in range(1, SLICES)], 10_000)
    cuts = checkpointed(b.join(F.broadcast(hot), names, "left_semi").groupBy(*names).agg(quantiles.alias("_cuts")))

    def slice_of(at: Column) -> Column:
        return F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < at)))

    a, b = (df.join(F.broadcast(cuts), names, "left") for df in (a, b))
    a = a.withColumn("_slice", F.explode(F.sequence(slice_of(F.col("_s")), slice_of(F.col("_e")))))
    both = a.unionByName(b.withColumn("_slice", slice_of(F.col("_s"))))
    group = [*names, "_slice"]
    both = both.select(*group, "_s", "_o", "_e", "_i").repartition(*group).sortWithinPartitions(*group, "_s", "_o")
    schema = both.select(*names).schema
    for c in ("outer_id", "inner_id"):
        schema = schema.add(c, "long")
    return both.mapInArrow(_sweeper(len(names)), schema).select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), "outer_id", "inner_id")


def _sweeper(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def rows():
            for b in batches:
                if not kinds:
                    kinds.extend(b.schema.types[:width])
                    kinds.extend([pa.int64()] * 2)
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [*(f"_k{i}" for i in range(width)), "outer_id", "inner_id"])

        out: list[tuple] = []
        for key, group in groupby(rows(), key=lambda r: r[: width + 1]):
            for pair in swept(r[width + 1 :] for r in group):
                out.append((*key[:width], *pair))
                if len(out) >= 50_000:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return run
