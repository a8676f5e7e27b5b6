"""Ranked lexical search: MaxScore over the shards of an inverted index.

1. Documents are indexed where they are read, without a shuffle: a task cuts its rows into shards of about `SHARD_TERMS` terms. A shard's
   postings are one row of the index in the shared folder: terms, and for each a list of the shard's documents and occurrences.
2. The number of documents and terms, and the documents that hold each term of a query, are sums over the shards.
3. Queries go in blocks of about `BLOCK_TERMS` terms; a block is sent to all tasks, each of which scans its shards. In a shard a query's lists are
   ordered by their upper bounds, the largest score that a posting adds. The lists whose bounds together don't reach the query's k-th best score
   so far are non-essential: documents come from the other lists only. Then non-essential lists are probed, the largest bound first, for the documents
   that can still qualify by the bounds of the lists that are left. A task keeps k documents a query over all its shards.
4. The tasks' best documents meet in one shuffle; a limit before it leaves k of each query and task.

Scores are whole numbers: a term's weight w is floor(1000 * ln((2N + 2) / (2 df + 1))), m of a document of n terms is 75 + (25 n N) div L, and an
occurrence tf adds w * ((10^9 tf) div (1000 tf + 12 m)) for each time the query has the term.

Nulls and odd input: null texts have no terms and are found by nothing; queries without terms, or whose terms are in no document, have no result; each row
of the queries has results of its own, also where ids repeat; each row of the documents is a document; equal scores go to the smaller doc_id, null last;
empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegauge.llm.arrow_text import in_arrow
from codegauge.llm.common import read_table, tune, written

#: Terms of a shard, about; a longer document is a shard of its own.
SHARD_TERMS = 1 << 21
#: Distinct (query, term) pairs of a block of queries, about; a query's terms stay together.
BLOCK_TERMS = 1 << 19
#: Up to this many distinct terms of queries the index holds only these; of more, all terms.
VOCABULARY = 1 << 19
#: Bytes of a text that are cut into terms at once.
PART = 1 << 20
TOP = 20

#: Bytes that belong to terms, A-Z lower-cased; the others become spaces. Every byte of a character beyond ASCII belongs to one.
_FOLD = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else c + 32 if chr(c).isupper() and c < 0x80 else 0x20 for c in range(256))


def terms(text: str) -> Counter:
    """Terms of a whole text and their occurrences."""
    folded = text.encode().translate(_FOLD)
    out: Counter = Counter()
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PART)
        end = len(folded) if end < 0 else end
        out.update(folded[at:end].split())
        at = end
    return out


def query_terms(items: DataFrame, key: str = "item_id") -> DataFrame:
    """query (a number of each row), the key as `item`, term and times, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = terms(t or "")
                yield pa.record_batch({"query": pa.array([q] * len(found), pa.int64()), "item": pa.array([i] * len(found), pa.int64()), "term": pa.array(list(found), pa.binary()), "times": pa.array(list(found.values()), pa.int64())})

    # the numbers are written before they are used twice
    rows = written(items.select(F.monotonically_increasing_id().alias("query"), F.col(key).cast("long").alias("item"), F.col("text")), "search-items")
    return written(in_arrow(rows, run, "query long, item long, term binary, times long"), "search-queries")


_INDEX = "doc_ids array<long>, lengths array<long>, terms array<binary>, ends array<long>, docs binary, tfs binary, dfs array<long>"
_INDEX_KINDS = {
    "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "terms": pa.list_(pa.binary()), "ends": pa.list_(pa.int64()), "docs": pa.binary(), "tfs": pa.binary(), "dfs": pa.list_(pa.int64()),
}


class Shard:
    """Postings of some documents, gathered one document after the other."""

    def __init__(self, vocabulary: set[bytes] | None):
        self.vocabulary = vocabulary
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.number: dict[bytes, int] = {}
        self.docs, self.at, self.tfs = array("I"), array("I"), array("I")  # a text has fewer than 2^32 bytes
        self.size = 0

    def add(self, doc_id: int | None, found: Counter) -> None:
        n = found.total()
        if not n:
            return
        doc = len(self.doc_ids)
        self.doc_ids.append(doc_id)
        self.lengths.append(n)
        self.size += n
        for t in found if self.vocabulary is None else found.keys() & self.vocabulary:
            self.docs.append(doc)
            self.at.append(self.number.setdefault(t, len(self.number)))
            self.tfs.append(found[t])

    def batch(self) -> pa.RecordBatch:
        """One row: documents by id, null last, and lists by term; a list's documents ascend and are kept as steps."""
        order = np.array(sorted(range(len(self.doc_ids)), key=lambda i: (self.doc_ids[i] is None, self.doc_ids[i] or 0)), np.int64)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        doc, at, tf = (np.array(x, np.uint32) for x in (self.docs, self.at, self.tfs))
        doc = place[doc]
        by = np.lexsort((doc, at))
        doc, tf = doc[by], tf[by]
        dfs = np.bincount(at, minlength=len(self.number))
        ends = np.cumsum(dfs)
        steps = np.diff(doc, prepend=0)
        steps[ends - dfs] = doc[ends - dfs]  # each list begins anew
        row = [[self.doc_ids[i] for i in order], [self.lengths[i] for i in order], list(self.number), ends.tolist(), steps.astype("<u4").tobytes(), tf.astype("<u4").tobytes(), dfs.tolist()]
        return pa.record_batch({c: pa.array([v], t) for (c, t), v in zip(_INDEX_KINDS.items(), row, strict=True)})


def index(docs: DataFrame, vocabulary: set[bytes] | None = None) -> DataFrame:
    """One row for each shard, as a written table. vocabulary: the only terms that are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(shared.value)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for i, d in enumerate(ids):
                t = texts[i].as_py()
                if t:
                    shard.add(d, terms(t))
                if shard.size >= SHARD_TERMS:
                    yield shard.batch()
                    shard = Shard(shared.value)
        if shard.size:
            yield shard.batch()

    return written(in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, _INDEX), "search-index")


class Lists:
    """A shard's lists with the scores that their postings add."""

    def __init__(self, row: dict, weights: dict[bytes, int], documents: int, total: int):
        self.doc_ids = row["doc_ids"]
        ends = np.array(row["ends"], np.int64)
        starts = ends - np.array(row["dfs"], np.int64)
        m = np.array([75 + 25 * n * documents // total for n in row["lengths"]], np.int64)
        steps, tf = np.frombuffer(row["docs"], "<u4").astype(np.int64), np.frombuffer(row["tfs"], "<u4").astype(np.int64)
        self.docs: dict[bytes, np.ndarray] = {}
        self.adds: dict[bytes, np.ndarray] = {}
        self.bound: dict[bytes, int] = {}
        for t, a, b in zip(row["terms"], starts, ends, strict=True):
            w = weights.get(t, 0)
            if w:
                docs = np.cumsum(steps[a:b])
                adds = w * (1_000_000_000 * tf[a:b] // (1000 * tf[a:b] + 12 * m[docs]))
                self.docs[t], self.adds[t], self.bound[t] = docs, adds, int(adds.max())

    def search(self, query: list[tuple[bytes, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places in the shard) and scores that may be among the k best; least: the score that a document must reach, at least 1.

        Documents' places ascend with their ids, so that of equal scores the earlier one is kept.
        """
        lists = sorted(((self.bound[t] * times, t, times) for t, times in query if t in self.bound), key=lambda x: x[:2])
        bounds = np.cumsum([b for b, _, _ in lists])
        if not len(lists) or bounds[-1] < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        essential = int(np.searchsorted(bounds, least))  # lists before it don't reach `least` together
        every = np.zeros(len(self.doc_ids), np.int64)
        for _, t, times in lists[essential:]:
            every[self.docs[t]] += self.adds[t] * times
        docs = np.flatnonzero(every)
        scores = every[docs]
        for i in range(essential - 1, -1, -1):
            least = max(least, _kth(scores, k))
            keep = scores + bounds[i] >= least
            docs, scores = docs[keep], scores[keep]
            _, t, times = lists[i]
            at = np.searchsorted(self.docs[t], docs)
            at[at == len(self.docs[t])] = 0
            scores = scores + np.where(self.docs[t][at] == docs, self.adds[t][at] * times, 0)
        keep = scores >= max(least, _kth(scores, k))
        return docs[keep], scores[keep]


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th best score, of fewer 1."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 1


class Best:
    """The k best documents of one query so far."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.rows: list[tuple[int, bool, int]] = []  # (-score, whether the id is null, id)

    def offer(self, doc_ids: list[int | None], docs: np.ndarray, scores: np.ndarray) -> None:
        if not len(docs):
            return
        if len(docs) > self.k:  # places ascend by id
            some = np.lexsort((docs, -scores))[: self.k]
            docs, scores = docs[some], scores[some]
        self.rows += [(-s, doc_ids[d] is None, doc_ids[d] or 0) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
        self.rows.sort()
        del self.rows[self.k :]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


def _block_results(shards: DataFrame, queries: list[tuple[int, int | None, list[tuple[bytes, int]]]], weights: dict[bytes, int], documents: int, total: int, k: int) -> DataFrame:
    shared = shards.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        best = [Best(k) for _ in asked]
        for b in batches:
            for i in range(b.num_rows):
                lists = Lists({c: b.column(c)[i].as_py() for c in _INDEX_KINDS}, weight, documents, total)
                for (_, _, query), found in zip(asked, best, strict=True):
                    found.offer(lists.doc_ids, *lists.search(query, k, found.least))
        rows = [(q, item, None if null else d, -s) for (q, item, _), found in zip(asked, best, strict=True) for s, null, d in found.rows]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.record_batch({c: pa.array(v, pa.int64()) for c, v in zip(("query", "item", "doc_id", "score"), cols, strict=True)})

    return in_arrow(shards, run, "query long, item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, key: str = "item_id", k: int = TOP) -> DataFrame:
    """key, rank, doc_id, score: the k best documents of each row of items."""
    spark = docs.sparkSession
    tune(spark)
    asked = query_terms(items, key)
    distinct = written(asked.select("term").distinct(), "search-vocabulary")
    few = distinct.count() <= VOCABULARY
    shards = index(docs, set(distinct.toArrow().column("term").to_pylist()) if few else None)
    documents, total = shards.agg(F.coalesce(F.sum(F.size("lengths")), F.lit(0)), F.coalesce(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")), F.lit(0))).first()
    held = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    weighed = written(asked.join(held, "term"), "search-weights")
    pairs = weighed.count()
    blocks = max(1, -(-pairs // BLOCK_TERMS))
    found = None
    for block in range(blocks):
        queries: dict[int, tuple[int, int | None, list[tuple[bytes, int]]]] = {}
        weights: dict[bytes, int] = {}
        rows = weighed.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "item", "term", "times", "df").toArrow()  # about BLOCK_TERMS rows
        for query, item, term, times, df in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            queries.setdefault(query, (query, item, []))[2].append((term, times))
            weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        some = written(_block_results(shards, [*queries.values()], weights, documents, total, k), "search-found")
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(key), "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(*(read_table(spark, sf_dir, t) for t in ("documents", "benchmark")))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, {_TERMS} AS term FROM d) GROUP BY ALL),
n AS (SELECT r, doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY ALL),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t CROSS JOIN c GROUP BY term),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, {_TERMS} AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)) GROUP BY ALL),
s AS (
  SELECT i, item_id, t.r, t.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n.n * docs) // total))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN n ON n.r = t.r CROSS JOIN c GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
