"""Merkle dataset manifest: an external-memory node store, and proofs read from it by coordinate.

1. Each row's leaf is hashed where the row is read, and only digests go on. Leaves are range-partitioned by (source, doc_id) and sorted: each
   partition is one sorted run in the shared folder. A leaf's number in the run and the sums of the runs' sizes give its position in its source's tree.
2. Levels are made from the level below, `STEP` at a time: nodes are dealt to blocks of 3^STEP consecutive positions and stream through a task
   in order; the nodes of all levels above go to Parquet, partitioned by level. Only the top of each block is read for the next levels.
3. The roots of the sources, in the sources' order, are the leaves of one more tree of the same kind.
4. Proofs are extracted from the top to the leaves: a block's rows, its inner nodes from the store, and the path above the block meet in one
   scan, sorted by (tree, block, level, position). What a task holds is one block's inner nodes and one path.

A digest H is the lowercase hex SHA-256 of the concatenated inputs, digests among them as hex text. A run of a level is three consecutive nodes, the
last one fewer.

Nulls and odd input: a null field is `-` in its leaf; null doc_ids come first in their source and aren't tampered with; the null source comes first;
rows with equal doc_ids go by leaf, and equal rows have a leaf each; a source of one row has its leaf as subroot; one source alone has its subroot as root; a
proof without siblings is the digest of nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.llm.arrow_text import in_arrow
from codegauge.llm.common import read_table, remove, scratch, tune, written

#: Nodes of a run.
WIDTH = 3
#: Levels that are made in one pass; a block has WIDTH ** STEP nodes of the lowest of them.
STEP = 6
BLOCK = WIDTH**STEP
#: Sizes of runs are broadcast up to this many rows, and joined by a shuffle beyond it.
BROADCAST_ROWS = 1 << 18
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(text: Column) -> Column:
    """The leaf of a row with this text, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(_field(F.col(c)) for c in FIELDS[:-1]), _field(text)), 256))


def tampered(text: Column) -> Column:
    """What a row's text becomes: without line feeds where 2 divides the doc_id's CRC-32."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest, seen (the digest of the row as it is met later) and row (a number that parts equal rows)."""
    t = F.col("text")
    rows = docs.select(*(F.col(c) for c in FIELDS))
    return rows.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), leaf_digest(t).alias("digest"), leaf_digest(tampered(t)).alias("seen"), F.monotonically_increasing_id().alias("row"))


def positions(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with tree, n and pos, as a written table: each group is a tree of n leaves, numbered from 0 by `order`. Trees are numbers in the groups' order.

    Rows are sorted once, by range; no row goes through a window. The table of run sizes has a row for each partition and group that meet.
    """
    spark = rows.sparkSession
    keys = [group, *order]
    run = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"seq": F.monotonically_increasing_id(), "part": F.spark_partition_id()})
    run = written(run, f"{name}-runs")
    sizes = run.groupBy(group, "part").agg(F.count(F.lit(1)).alias("size"), F.min("seq").alias("first"))
    by = f"PARTITION BY {group}"
    sizes = sizes.select(
        F.col(group).alias("_g"), F.col("part").alias("_p"), "first", F.expr(f"sum(size) OVER ({by} ORDER BY part) - size").alias("before"), F.expr(f"sum(size) OVER ({by})").alias("n"), F.expr(f"min(first) OVER ({by})").alias("tree")
    )
    sizes = written(sizes, f"{name}-sizes")
    near = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    out = run.join(near, (F.col("part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    out = written(out.withColumn("pos", F.col("seq") - F.col("first") + F.col("before")).drop("seq", "part", "_g", "_p", "first", "before"), f"{name}-leaves")
    for t in (run, sizes):
        remove(spark, t.at)
    return out


def count_at(n: int, level: int) -> int:
    """Nodes at a level of a tree of n leaves."""
    for _ in range(level):
        n = -(-n // WIDTH)
    return n


def _hash(parts: list[bytes]) -> bytes:
    return sha256(b"".join(p.hex().encode() for p in parts)).digest()


_NODES = "tree long, n long, level int, pos long, digest binary"
_NODE_KINDS = {"tree": pa.int64(), "n": pa.int64(), "level": pa.int32(), "pos": pa.int64(), "digest": pa.binary()}


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) of sorted batches; rows are read before the next key is asked for."""
    from itertools import groupby

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    yield from groupby(rows(), key=lambda r: r[: len(keys)])


def _raised(base: int):
    """Nodes of the levels base + 1 to base + STEP above the nodes of level base, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (tree, block), rows in _groups(batches, ("tree", "block")):
            nodes, n = [], 0
            for _, _, _, n, digest in rows:  # noqa: B007
                nodes.append(digest)
            at = block * BLOCK
            for k in range(1, STEP + 1):
                if count_at(n, base + k - 1) == 1:
                    break
                nodes = [_hash(nodes[i : i + WIDTH]) for i in range(0, len(nodes), WIDTH)]
                at //= WIDTH
                out += [(tree, n, base + k, at + i, d) for i, d in enumerate(nodes)]
            if len(out) > 20_000:
                yield _batch(out, _NODE_KINDS)
                out = []
        yield _batch(out, _NODE_KINDS)

    return run


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.record_batch({c: pa.array(v, t) for (c, t), v in zip(kinds.items(), cols, strict=True)})


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


class Store:
    """The nodes above the leaves of all trees: a folder of Parquet tables, one for each level."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.steps = spark, scratch(spark, name), 0

    def level(self, lowest: int, highest: int) -> DataFrame:
        rows = self.spark.read.schema(_NODES).option("basePath", self.at).parquet(self.at)
        return rows.where(F.col("level").between(lowest, highest))

    def build(self, trees: DataFrame) -> Store:
        """trees: tree, n, pos, digest of all leaves."""
        most = trees.agg(F.max("n")).first()[0] or 0
        base = 0
        while count_at(most, base) > 1:
            below = trees if base == 0 else self.level(base, base)
            below = below.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "digest")
            raised = in_arrow(_dealt(below, "pos"), _raised(base), _NODES)
            raised.write.mode("append").partitionBy("level").option("compression", "zstd").parquet(self.at)
            base += STEP
        self.steps = base // STEP
        return self

    def roots(self, trees: DataFrame) -> DataFrame:
        """tree and digest of the top of each tree."""
        lone = trees.where("n = 1").select("tree", "digest")
        if not self.steps:
            return lone
        every = self.level(1, self.steps * STEP)
        top = F.lit(1)
        for k in range(1, self.steps * STEP + 1):  # the level at which a tree of n leaves has one node
            top = F.when(F.col("n") > WIDTH ** (k - 1), k).otherwise(top)
        return lone.unionByName(every.where(F.col("level") == top).select("tree", "digest"))


# A path is bytes: for each level, from below, the place in the run, the run's size, and the siblings' digests.


def siblings(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place, siblings) of each level of a path."""
    at = 0
    while at < len(path):
        place, size = path[at], path[at + 1]
        yield place, [path[i : i + 32] for i in range(at + 2, at + 2 + 32 * (size - 1), 32)]
        at += 2 + 32 * (size - 1)


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and its path give."""
    for place, others in siblings(path):
        digest = _hash([*others[:place], digest, *others[place:]])
    return digest


def proof_digest(path: bytes) -> bytes:
    return _hash([s for _, others in siblings(path) for s in others])


def _step(level: list[bytes], first: int, pos: int) -> bytes:
    """The part of a path at a node: level holds consecutive nodes from position `first`."""
    i = (pos // WIDTH) * WIDTH - first
    run = level[i : i + WIDTH]
    return bytes([pos % WIDTH, len(run)]) + b"".join(run[: pos % WIDTH] + run[pos % WIDTH + 1 :])


def _merge(base: int, kinds: dict[str, pa.DataType], each):
    """Streams (tree, block, level, pos, n, digest, path, ...), levels descending: the path above a block, then its inner nodes, then its rows.

    `each(row, path)` gives the output row of a row of level `base`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, rows in _groups(batches, ("tree", "block")):
            above, inner, first, waits = b"", {}, {}, []

            def flush() -> None:
                """The waiting rows are one run of level base, so that their siblings are known."""
                parent, n = waits[0][3] // WIDTH, waits[0][4]
                if count_at(n, base) == 1:
                    out.extend(each(r, above) for r in waits)
                    return
                rest, k, p = [], base + 1, parent
                while k < base + STEP and count_at(n, k) > 1:
                    rest.append(_step(inner[k], first[k], p))
                    k, p = k + 1, p // WIDTH
                rest = b"".join([*rest, above])
                level = [r[5] for r in waits]
                out.extend(each(r, _step(level, parent * WIDTH, r[3]) + rest) for r in waits)

            for r in rows:
                level, pos, digest, path = r[2], r[3], r[5], r[6]
                if path is not None:
                    above = path
                elif level > base:
                    inner.setdefault(level, []).append(digest)
                    first.setdefault(level, pos)
                else:
                    if waits and pos // WIDTH != waits[0][3] // WIDTH:
                        flush()
                        waits.clear()
                    waits.append(r)
                    if len(out) > 5_000:
                        yield _batch(out, kinds)
                        out.clear()
            if waits:
                flush()
        yield _batch(out, kinds)

    return run


_PATHS = {"tree": pa.int64(), "pos": pa.int64(), "n": pa.int64(), "path": pa.binary()}


def _scan(rows: DataFrame, store: Store, tops: DataFrame, step: int, more: list[str]) -> DataFrame:
    """Rows of level step * STEP (tree, n, pos, digest, *more), the inner nodes above them and the paths of their blocks (tree, pos, path), for `_merge`."""
    base = step * STEP
    rest = [F.col(c) for c in more]
    parts = [rows.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), F.lit(base).alias("level"), "pos", "n", "digest", F.lit(None).cast("binary").alias("path"), *rest)]
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in more]
    if store.steps > step and STEP > 1:
        inner = store.level(base + 1, base + STEP - 1)
        parts.append(inner.select("tree", F.expr(f"pos div CAST(power({WIDTH}, {base + STEP} - level) AS BIGINT)").alias("block"), "level", "pos", "n", "digest", F.lit(None).cast("binary").alias("path"), *none))
    parts.append(tops.select("tree", F.col("pos").alias("block"), F.lit(base + STEP).alias("level"), "pos", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("digest"), "path", *none))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("level"), "pos")


def paths_to(store: Store, top: DataFrame) -> DataFrame:
    """tree, pos, path of the tops of the blocks of leaves. top: tree, path above each tree's root.

    From the highest levels down; a tree that ends below a step has its own path above as that of its only block there.
    """
    tops = top.select("tree", F.lit(0).cast("long").alias("pos"), "path")
    for step in range(store.steps - 1, 0, -1):
        base = step * STEP
        rows = store.level(base, base).select("tree", "n", "pos", "digest")
        got = in_arrow(_scan(rows, store, tops, step, []), _merge(base, _PATHS, lambda r, path: (r[0], r[3], r[4], path)), "tree long, pos long, n long, path binary")
        # trees without nodes at this level are lower: their path goes down as it is
        got = got.select("tree", "pos", "path")
        low = tops.join(rows.where("pos = 0").select("tree"), "tree", "left_anti")
        tops = written(got.unionByName(low), "merkle-paths")
    return tops


_PROVED = {
    "doc_id": pa.int64(), "leaf": pa.string(), "subroot": pa.string(), "root": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string(), "verified": pa.bool_(),
}


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row."""
    spark = docs.sparkSession
    tune(spark)
    first = written(leaves(docs), "merkle-hashed")
    trees = positions(first, "source", ["doc_id", "digest", "row"], "merkle")
    remove(spark, first.at)
    store = Store(spark, "merkle-nodes").build(trees)
    roots = written(store.roots(trees), "merkle-roots")
    # the tree of the sources' roots
    upper = positions(roots.select(F.lit(0).alias("all"), F.col("tree").alias("order"), "digest"), "all", ["order"], "merkle-upper")
    upper_store = Store(spark, "merkle-upper-nodes").build(upper)
    root = upper_store.roots(upper).first()
    root = bytes(root.digest) if root else b""
    top = written(_extract_upper(upper, upper_store), "merkle-top")

    def each(r: tuple, path: bytes) -> tuple:
        _, _, _, _, _, digest, _, doc_id, seen, subroot = r
        got = fold(seen, path)
        return doc_id, digest.hex(), subroot.hex(), root.hex(), proof_digest(path).hex(), got.hex(), got == root

    rows = trees.select("tree", "n", "pos", "digest", "doc_id", "seen")
    near = F.broadcast(roots) if roots.count() <= BROADCAST_ROWS else roots
    rows = rows.join(near.select("tree", F.col("digest").alias("subroot")), "tree")
    scan = _scan(rows, store, paths_to(store, top), 0, ["doc_id", "seen", "subroot"])
    return in_arrow(scan, _merge(0, _PROVED, each), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _extract_upper(upper: DataFrame, store: Store) -> DataFrame:
    """tree and path of each source's root in the tree of all sources."""
    none = upper.select("tree").distinct().select("tree", F.lit(b"").alias("path"))
    rows = upper.select("tree", "n", "pos", "digest", "order")
    scan = _scan(rows, store, paths_to(store, none), 0, ["order"])
    kinds = {"tree": pa.int64(), "path": pa.binary()}
    return in_arrow(scan, _merge(0, kinds, lambda r, path: (r[7], path)), "tree long, path binary")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read_table(spark, sf_dir, "documents"))


def _crc_table() -> list[int]:
    """CRC-32's table, from its polynomial."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        out.append(b)
    return out


def _sql_leaf(text: str) -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    return "sha256(" + " || ".join(field(c) for c in (*FIELDS[:-1], text)) + ")"


_CRC = (
    f"(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1])), 4294967295))"
)
OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_sql_leaf('text')} AS leaf, CASE WHEN coalesce({_CRC} % 2 = 0, false) THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf('text')} END AS seen FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS id FROM d),
t AS (
  SELECT tree, 0 AS level, pos, leaf AS h, n FROM l
  UNION ALL SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY tree, level, pos // 3, n),
r AS (SELECT tree AS pos, h FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, pos, h, (SELECT count(*) FROM r) AS n FROM r
  UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, pos // 3, n),
root AS (SELECT h AS root FROM u WHERE n = 1),
f AS (
  SELECT id, tree, 0 AS level, pos, seen AS h, '' AS proof, n FROM l
  UNION ALL SELECT f.id, f.tree, f.level + 1, f.pos // 3, sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.h ELSE t.h END, '' ORDER BY t.pos)), f.proof || string_agg(CASE WHEN t.pos = f.pos THEN '' ELSE t.h END, '' ORDER BY t.pos), (f.n + 2) // 3
  FROM f JOIN t ON t.tree = f.tree AND t.level = f.level AND t.pos // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY f.id, f.tree, f.level, f.pos, f.h, f.proof, f.n),
g AS (
  SELECT id, 0 AS level, tree AS pos, h, proof, (SELECT count(*) FROM r) AS n FROM f WHERE n = 1
  UNION ALL SELECT g.id, g.level + 1, g.pos // 3, sha256(string_agg(CASE WHEN u.pos = g.pos THEN g.h ELSE u.h END, '' ORDER BY u.pos)), g.proof || string_agg(CASE WHEN u.pos = g.pos THEN '' ELSE u.h END, '' ORDER BY u.pos), (g.n + 2) // 3
  FROM g JOIN u ON u.level = g.level AND u.pos // 3 = g.pos // 3 WHERE g.n > 1 GROUP BY g.id, g.level, g.pos, g.h, g.proof, g.n)
SELECT l.doc_id, l.leaf, r.h AS subroot, root.root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = root.root AS verified
FROM l JOIN r ON r.pos = l.tree JOIN g ON g.id = l.id AND g.n = 1 CROSS JOIN root
"""
