"""Token ids as packed matrices: best-fit-decreasing packing with a segment tree over capacities.

1. Documents are tokenised (byte-level BPE by ranks), an end id after each, and written to the shared folder.
2. Whole windows of long documents are rows of their own, and what is left of each document is dealt by a hash of the doc_id to shards
   of about `SHARD_TOKENS` ids. So a document is split losslessly: its pieces, by start, give back all its ids.
3. In a shard pieces go by decreasing length into the fullest row that has room for them. A segment tree that counts rows by free
   capacity finds it in the logarithm of the window's size.
4. A row holds its ids, padded; the cumulative lengths of its segments, from 0; and positions that restart at 0 with each segment.
   `matrices` stacks rows into blocks, which are written; `rows_of` takes them apart again.

Nulls and odd input: a null text is empty and has the end id only; a null doc_id is passed on; repeated rows are packed each; equal lengths
go by (doc_id, ids); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.llm.arrow_text import by_group, in_arrow, texts
from codegauge.llm.common import read_table, scratch, tune, written

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The id after each document and the padding: the first that the ranks leave free.
END = 50256
WINDOW = 2048
SHARD_TOKENS = 1 << 20
#: Rows of a matrix.
BLOCK = 256
#: Rows of whole windows are numbered from here; a shard's from shard * 2^32.
WHOLE = 1 << 62
IDS = np.dtype("<u2")

_ROW = "sequence_id long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids binary, positions binary"
_ROW_KINDS = {"sequence_id": pa.int64(), "doc_ids": pa.list_(pa.int64()), "starts": pa.list_(pa.int64()), "cu_seqlens": pa.list_(pa.int32()), "ids": pa.binary(), "positions": pa.binary()}
_MATRIX = "n_rows int, sequence_ids array<long>, ids binary, positions binary, cu_seqlens array<array<int>>, doc_ids array<array<long>>, starts array<array<long>>"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenised(docs: DataFrame, path: str = RANKS, end: int = END) -> DataFrame:
    """doc_id, ids (little-endian, the end id last) and n of each row."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            ids = [np.array([*encode(t), end], IDS) for t in texts(b)]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": pa.array([x.tobytes() for x in ids], pa.binary()), "n": pa.array([len(x) for x in ids], pa.int64())})

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary, n long")


class Capacities:
    """A segment tree over capacities 0 to size that holds rows by their free capacity."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, row: int, capacity: int) -> None:
        self.rows[capacity].append(row)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row of the smallest capacity that is at least `need`, taken out, and that capacity."""
        i = need + self.leaves
        while not self.count[i]:  # up, to the first subtree on the right that holds a row
            while i & 1:
                i >>= 1
                if not i:
                    return None
            if i == 0:
                return None
            i += 1
        while i < self.leaves:  # down, leftmost
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._change(capacity, -1)
        return self.rows[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Rows of item numbers. lengths: in decreasing order, none over the window."""
    free, rows = Capacities(window), []
    for item, n in enumerate(lengths):
        found = free.take(n)
        if found is None:
            found = len(rows), window
            rows.append([])
        row, capacity = found
        rows[row].append(item)
        free.add(row, capacity - n)
    return rows


def _row(pieces: list[np.ndarray], window: int, pad: int) -> tuple[list[int], bytes, bytes]:
    """Cumulative lengths, padded ids and positions of a row."""
    n = [len(p) for p in pieces]
    used = sum(n)
    ids = np.full(window, pad, IDS)
    ids[:used] = np.concatenate(pieces)
    at = [0, *np.cumsum(n).tolist()]
    positions = np.arange(window) - np.repeat([*at[:-1], used], [*n, window - used])
    return at, ids.tobytes(), positions.astype(IDS).tobytes()


def sequences(docs: DataFrame, path: str = RANKS, end: int = END, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row for each packed sequence: sequence_id, doc_ids and starts of its segments, cu_seqlens, ids and positions (16-bit)."""
    tokens = written(tokenised(docs, path, end), "output-tokens")
    total = tokens.agg(F.coalesce(F.sum(F.col("n") % window), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_tokens))
    wide = IDS.itemsize

    def table(rows: list[tuple], make=pa.table):
        return make({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(_ROW_KINDS.items())})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, x, m in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "n")), strict=True):
                ids = np.frombuffer(x, IDS)
                rows += [(0, [d], [k], *_row([ids[k : k + window]], window, end)) for k in range(0, m - m % window, window)]
                if len(rows) >= BLOCK:
                    yield table(rows, pa.record_batch)
                    rows = []
            yield table(rows, pa.record_batch)

    def shard(group: pa.Table) -> pa.Table:
        order = sorted(zip(*(group.column(c).to_pylist() for c in ("ids", "doc_id", "n")), strict=True), key=lambda r: (-len(r[0]), r[1] is None, r[1] or 0, r[0]))
        pieces = [np.frombuffer(x, IDS) for x, _, _ in order]
        base = group.column("shard")[0].as_py() << 32
        rows = []
        for s, items in enumerate(best_fit_decreasing([len(p) for p in pieces], window)):
            rows.append((base + s, [order[i][1] for i in items], [order[i][2] - len(pieces[i]) for i in items], *_row([pieces[i] for i in items], window, end)))
        return table(rows)

    full = in_arrow(tokens.where(F.col("n") >= window), whole, _ROW).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(WHOLE))
    rest = tokens.where(F.col("n") % window > 0).select("doc_id", "n", F.expr(f"substring(ids, cast((n - n % {window}) * {wide} + 1 as int))").alias("ids"), F.pmod(F.xxhash64("doc_id", "ids", F.monotonically_increasing_id()), F.lit(shards)).alias("shard"))
    return full.unionByName(by_group(rest, ["shard"], shard, _ROW))


def matrices(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """n_rows, ids and positions (n_rows x window, 16-bit), and for each row its sequence_id, cu_seqlens, doc_ids and starts, of each block of rows; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, block):
                part = b.slice(i, block)
                yield pa.record_batch(
                    {
                        "n_rows": pa.array([part.num_rows], pa.int32()),
                        "sequence_ids": pa.array([part.column("sequence_id").to_pylist()], pa.list_(pa.int64())),
                        "ids": pa.array([b"".join(part.column("ids").to_pylist())], pa.binary()),
                        "positions": pa.array([b"".join(part.column("positions").to_pylist())], pa.binary()),
                    }
                    | {c: pa.array([part.column(c).to_pylist()], pa.list_(_ROW_KINDS[c])) for c in ("cu_seqlens", "doc_ids", "starts")}
                )

    return in_arrow(rows, run, _MATRIX)


def rows_of(blocks: DataFrame) -> DataFrame:
    """The rows of matrices, as `sequences` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, positions = (np.frombuffer(r[c], IDS).reshape(r["n_rows"], -1) for c in ("ids", "positions"))
                rows = [(r["sequence_ids"][k], r["doc_ids"][k], r["starts"][k], r["cu_seqlens"][k], ids[k].tobytes(), positions[k].tobytes()) for k in range(r["n_rows"])]
                yield pa.record_batch({c: pa.array([x[i] for x in rows], t) for i, (c, t) in enumerate(_ROW_KINDS.items())})

    return in_arrow(blocks, run, _ROW)


def digests(blocks: DataFrame) -> DataFrame:
    """The rows of matrices, with CRC-32s in the place of ids and positions."""
    crc = [F.crc32(c).alias(f"{c}_crc32") for c in ("ids", "positions")]
    return rows_of(blocks).select("sequence_id", "doc_ids", "starts", "cu_seqlens", F.element_at("cu_seqlens", -1).alias("n_tokens"), *crc)


def write_matrices(docs: DataFrame, path: str, **options) -> None:
    """The packed corpus as a table of matrices."""
    matrices(sequences(docs, **options)).write.option("compression", "zstd").parquet(path)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each packed sequence with its documents, and digests of its ids and positions, taken from the matrices that were written."""
    at = scratch(spark, "output-matrices")
    write_matrices(read_table(spark, sf_dir, "documents"), at)
    return digests(spark.read.schema(_MATRIX).parquet(at))
