"""Exact top-k search by pivot-table elimination.

1. Pivots are chosen farthest first from a sample of `PIVOT_SAMPLE` vectors; they change the cost alone.
2. The pivot table: each row's distances to all pivots are computed once and written beside its vector, in order of the nearest
   pivot within each file. The origin is a pivot too, its distances are the norms.
3. For a query q and a vector v the largest difference of their distances to a pivot is a lower bound of their distance, so
   (|q|^2 + |v|^2 - bound^2) / 2 is an upper bound of their inner product. A query skips a block of vectors whose distances' ranges
   give too low a bound, evaluates the others in the order of their bounds, and stops once the next bound is below its k-th score.
4. The k-th score is carried from block to block. It starts with that of a first search over one row of `SEED` of the table.

The queries are a stated set. They are met in parts of bounded bytes, one after the other: a part is broadcast and meets all vectors where
they lie; a partition gives its k best for each query that reach the first search's k-th score, which are written, and at last merged by
a window of k rows for each partition.

Scores are exact: products of vectors with ordinary components are sums of whole numbers below 2^53; components beyond that (`tame`)
have no place in the pivot table and are evaluated in whole numbers of any size, against every query. Ranks go by exact scores; a score
that doesn't fit a long is reported as the nearest long.

Nulls and odd input: vectors that are null, are empty, hold a null or non-finite component, or have no id take no part;
vectors of different lengths are not compared; every row is a candidate but the query's own row, so rows that share a vec_id
are candidates each, also of one another, and queries each; equal scores go to the smaller vec_id; fewer candidates than k give all
of them; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegauge.llm.arrow_text import in_arrow
from codegauge.llm.common import read_table, remove, scratch, tune, written

K = 5
PIVOTS = 32
#: Vectors from which the pivots are chosen.
PIVOT_SAMPLE = 2048
#: One row of so many takes part in the first search.
SEED = 64
#: Bytes of the queries that are broadcast at once, with their distances.
QUERY_BYTES = 32 << 20
#: Queries and vectors that meet at once, and candidates that a query evaluates first.
QUERY_BLOCK, VECTOR_BLOCK, STEP = 64, 4096, 64
#: Components are multiplied by this and rounded down.
SCALE = 256
LEAST, MOST = -(2**63), 2**63 - 1

_FOUND = "query_row long, query_id long, vec_id long, score long, beyond binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the components as doubles, of each row that takes part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fit = F.coalesce(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)), F.lit(False)) & (F.size("v") > 0)
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(fit & F.col("vec_id").isNotNull())


def tame(v: np.ndarray) -> np.ndarray:
    """Rows whose products and squared distances are exact as doubles, with room for the rounding of the bounds."""
    return np.abs(v).max(1) < np.sqrt(2.0**48 / v.shape[1]) / SCALE


def whole(v: np.ndarray) -> list[int]:
    """A vector in whole numbers of any size."""
    return [int(np.floor(x * SCALE)) if abs(x) < 2.0**900 else int(x) * SCALE for x in v.tolist()]


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """The origin, and others farthest first."""
    at = [np.zeros(sample.shape[1])]
    far = np.full(len(sample), np.inf)
    while len(sample) and len(at) < n:
        far = np.minimum(far, ((sample - at[-1]) ** 2).sum(1))
        if far.max() <= 0:
            break
        at.append(sample[int(far.argmax())])
    return np.array(at)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """A row of distances to all pivots for each vector."""
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Rows:
    """Vectors of one length: row numbers, ids, whole-numbered components, distances to the pivots."""

    row: np.ndarray
    vec_id: np.ndarray
    x: np.ndarray
    d: np.ndarray

    def __len__(self) -> int:
        return len(self.row)

    def part(self, at) -> Rows:
        return Rows(self.row[at], self.vec_id[at], self.x[at], self.d[at])


class Best:
    """The k best of one query: (-score, vec_id) in order, and the score that a candidate must reach."""

    def __init__(self, k: int, least: float = -np.inf):
        self.k, self.least, self.rows = k, least, []

    def add(self, scores, ids) -> None:
        self.rows = sorted([*self.rows, *((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if int(s) >= self.least)])[: self.k]
        if len(self.rows) == self.k:
            self.least = max(self.least, -self.rows[-1][0])

    @property
    def reach(self) -> float:
        """The least score as a double, for scores of tame vectors, which are far smaller than the limits here."""
        return float(min(max(self.least, -1e300), 1e300))


def meet(q: Rows, x: Rows, best: list[Best], counter: list | None = None) -> None:
    """Offer each query's candidates among x, in order of their bounds until none can be among its best. Both: tame, of one length."""
    nq, nx = (q.x**2).sum(1), (x.x**2).sum(1)
    low, high = x.d.min(0), x.d.max(0)
    far = np.maximum(np.maximum(low - q.d, q.d - high).max(1), 0)  # of the whole block
    nearest = np.maximum(far - 1e-6, 0)
    hopeful = (nq + nx.max() - nearest**2) / 2 + 1 >= [b.reach for b in best]
    for begin in range(0, len(q), QUERY_BLOCK):
        some = np.flatnonzero(hopeful[begin : begin + QUERY_BLOCK]) + begin
        if not len(some):
            continue
        low = np.zeros((len(some), len(x)))
        gap = np.empty_like(low)
        for p in range(x.d.shape[1]):
            np.subtract(q.d[some, p, None], x.d[None, :, p], out=gap)
            np.maximum(low, np.abs(gap, out=gap), out=low)
        low = np.maximum(low - 1e-6, 0)  # rounding of the roots
        bounds = (nq[some, None] + nx[None] - low**2) / 2 + 1  # and of the squares
        for i, bound in zip(some, bounds, strict=True):
            _in_order(q, i, x, bound, best[i], counter)


def _in_order(q: Rows, i: int, x: Rows, bound: np.ndarray, best: Best, counter: list | None) -> None:
    bound[x.row == q.row[i]] = -np.inf
    left = np.flatnonzero(bound >= best.reach)
    step = STEP
    while len(left):
        if step < len(left) and 2 * len(left) > step:
            first = np.argpartition(-bound[left], step - 1)[:step]
            now = left[first]
        else:
            now = left
        s = x.x @ q.x[i] if 2 * len(now) > len(x) else x.x[now] @ q.x[i]
        s = s[now] if len(s) == len(x) and len(now) != len(x) else s
        if counter is not None:
            counter[0] += len(now)
        able = s >= best.reach
        if able.any():
            s, ids = s[able], x.vec_id[now][able]
            top = np.lexsort((ids, -s))[: best.k]
            best.add(s[top], ids[top])
        if len(now) == len(left):
            break
        rest = np.ones(len(left), bool)
        rest[first] = False
        left = left[rest]
        left = left[bound[left] >= best.reach]
        step *= 4


def meet_any(q: list[int], x: list[int]) -> int:
    return sum(a * b for a, b in zip(q, x, strict=True))


def _beyond(score: int) -> bytes | None:
    """The order of scores that don't fit a long."""
    if LEAST < score < MOST:
        return None
    return (score if score > 0 else (1 << 2400) + score).to_bytes(304, "big")


def table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """The pivot table: row, vec_id, v, d (distances; null for vectors without a place) and near."""
    rows = usable(vectors).withColumn("row", F.monotonically_increasing_id())
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, near = [None] * b.num_rows, np.zeros(b.num_rows)
            flat, at = _flat(b.column("v"))
            size = np.diff(at)
            for n in np.unique(size):
                mine = np.flatnonzero(size == n)
                v = flat[at[mine][:, None] + np.arange(n)]
                mine, v = mine[tame(v)], v[tame(v)]
                if not len(mine):
                    continue
                far = distances(np.floor(v * SCALE), shared.value.get(int(n), np.zeros((1, n))))
                inner = far[:, 1:] if far.shape[1] > 1 else far
                near[mine] = inner.argmin(1) + 1 - 1 / (2 + inner.min(1))
                for i, row in zip(mine, far, strict=True):
                    d[i] = row
            yield pa.record_batch({"row": b.column("row"), "vec_id": b.column("vec_id"), "v": b.column("v"), "d": pa.array(d, pa.list_(pa.float64())), "near": pa.array(near, pa.float64())})

    made = in_arrow(rows.select("row", "vec_id", "v"), run, "row long, vec_id long, v array<double>, d array<double>, near double")
    return made.sortWithinPartitions(F.size("v"), "near")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each list begins (one more than lists)."""
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)))


def by_length(part: pa.RecordBatch | pa.Table) -> tuple[dict[int, Rows], list[tuple[int, int, np.ndarray]]]:
    """Tame rows by their length, and (row, vec_id, components) of the others."""
    part = part.combine_chunks().to_batches() if isinstance(part, pa.Table) else [part]
    tame_, wild = {}, []
    for b in part:
        v, at = _flat(b.column("v"))
        d, to = _flat(b.column("d"))
        row, ids = b.column("row").to_numpy(), b.column("vec_id").to_numpy()
        size, has = np.diff(at), np.diff(to) > 0
        wild += [(int(row[i]), int(ids[i]), v[at[i] : at[i + 1]]) for i in np.flatnonzero(~has)]
        for n in np.unique(size[has]):
            mine = np.flatnonzero(has & (size == n))
            x = v[at[mine][:, None] + np.arange(n)]
            y = d[to[mine][:, None] + np.arange(to[mine[0] + 1] - to[mine[0]])]
            tame_.setdefault(int(n), []).append(Rows(row[mine], ids[mine], np.floor(x * SCALE), y))
    return {n: r[0] if len(r) == 1 else Rows(*(np.concatenate([getattr(p, f) for p in r]) for f in ("row", "vec_id", "x", "d"))) for n, r in tame_.items()}, wild


def _search(vectors: DataFrame, part: pa.Table, least: dict[int, int], k: int) -> DataFrame:
    """The k best of each partition of vectors for each query of the part that reach its least score."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((part, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, least = shared.value
        queries, odd = by_length(part)
        best = {int(r): Best(k, least.get(int(r), -np.inf)) for q in queries.values() for r in q.row} | {r: Best(k, least.get(r, -np.inf)) for r, _, _ in odd}
        name = {int(r): int(i) for q in queries.values() for r, i in zip(q.row, q.vec_id, strict=True)} | {r: i for r, i, _ in odd}
        mine = {n: [best[int(r)] for r in q.row] for n, q in queries.items()}
        any_query = [(r, whole(v)) for r, _, v in odd]
        for b in batches:
            for i in range(0, b.num_rows, VECTOR_BLOCK):
                x, wild = by_length(b.slice(i, VECTOR_BLOCK))
                for n, rows in x.items():
                    if n in queries:
                        meet(queries[n], rows, mine[n])
                # what has no place in the table meets all
                for r, q in any_query:
                    for rows in (x[len(q)],) if len(q) in x else ():
                        for row, vec, v in zip(rows.row, rows.vec_id, rows.x, strict=True):
                            if row != r:
                                best[r].add([meet_any(q, [int(c) for c in v])], [vec])
                for row, vec, v in wild:
                    v = whole(v)
                    for r, q in any_query:
                        if len(q) == len(v) and row != r:
                            best[r].add([meet_any(q, v)], [vec])
                    if len(v) in queries:
                        for to, q in zip(mine[len(v)], queries[len(v)].x, strict=True):
                            to.add([meet_any([int(c) for c in q], v)], [vec])
        out = [(r, name[r], i, -s) for r, b in best.items() for s, i in b.rows]
        cols = [[r[0] for r in out], [r[1] for r in out], [r[2] for r in out], [min(MOST, max(LEAST, r[3])) for r in out]]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in cols] + [pa.array([_beyond(r[3]) for r in out], pa.binary())], [c.split()[0] for c in _FOUND.split(", ")])

    return in_arrow(vectors.select("row", "vec_id", "v", "d"), run, _FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row where is_query (a condition on vec_id) holds."""
    spark = vectors.sparkSession
    tune(spark)
    sample = [np.array(r.v) for r in usable(vectors).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOT_SAMPLE).collect()]
    sample = [v for v in sample if tame(v[None])[0]]
    rows = written(table(vectors, {n: choose_pivots(np.floor(np.array([v for v in sample if len(v) == n]) * SCALE)) for n in {len(v) for v in sample}}), "topk-vectors")
    seed = written(rows.where(F.pmod(F.xxhash64("row"), F.lit(SEED)) == 0), "topk-seed")
    queries = written(rows.where(is_query).select("row", "vec_id", "v", "d"), "topk-queries")
    size = queries.agg(F.coalesce(F.sum(8 * (F.size("v") + PIVOTS + 2)), F.lit(0))).first()[0]
    parts = -(-size // QUERY_BYTES)
    at = scratch(spark, "topk-found")
    for n in range(parts):
        part = queries.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == n).orderBy("row").toArrow()
        first = _merged(_search(seed, part, {}, k), k).where((F.col("rank") == k) & F.col("beyond").isNull()).select("query_row", "score").collect()
        _search(rows, part, {r.query_row: r.score for r in first}, k).write.mode("append").parquet(at)
    out = spark.read.schema(_FOUND).parquet(at) if parts else spark.createDataFrame([], _FOUND)
    for done in (rows, seed, queries):
        remove(spark, done.at)
    return _merged(out, k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
