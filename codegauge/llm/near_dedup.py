"""MinHash near-dedup: universal hash minima in bands, signature verification, full-set confirmation, components.

1. One pass over whole texts gives each document's shingle set's size and digest, the hashes of its bands of minima and
   one byte of each minimum (the signature). Documents of equal sets form a class; its smallest doc_id stands for it.
2. In each band bucket the members are paired with the smallest one (a star, not all pairs). Pairs that pass the sizes and
   the signatures are confirmed on the full sets, which are made again from the texts of these documents only.
3. Components of the links, by large-star and small-star. Then, in buckets that still hold several components, the
   members of different components are compared in blocks: first by signatures, which tells the members that have a
   possible partner, then those members by full sets. Only members and links leave a block, never candidates, and blocks of one
   component never meet. So each pair that shares a bucket is either connected already or has been compared.

Bands and the signature threshold follow from the similarity asked for. At 0.8 (36 bands of 5 minima), two sets of just that
similarity share no bucket with probability 6e-7, and pass the signature threshold but for 3e-7; more similar ones are
missed still more rarely. A similarity for which no banding misses less than one in a million is refused.

Nulls and odd input: a text that is null or has no words has an empty set and links with nothing; a text with fewer words
than a shingle is one shingle; repeated rows get the same result each (a doc_id should have one text: where it has
several, each row goes by its own text, and those it stands for are taken as one document); a null doc_id links with nothing and is kept, its
component null; ties don't arise, as components go by the smallest doc_id; an empty table gives an empty result; columns
other than doc_id and text are not read, so names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.llm import vector_text as vt
from codegauge.llm.arrow_text import by_group, in_arrow, texts
from codegauge.llm.common import bitmap_of, except_keys, maybe_in, read_table, remove, spread_join, tune, written
from codegauge.llm.components import components

#: Words of a shingle, and the similarity in hundredths that links documents.
WORDS, PERCENT = 5, 80
#: Minima of a signature, and the most probable loss of a pair that is just similar enough.
MINIMA, LOSS = 180, 1e-6
#: Members of a bucket that form a block when signatures are compared; members, and shingles of theirs, when full sets are.
SIGNED_BLOCK, BLOCK, BLOCK_SHINGLES = 512, 512, 400_000

_SEEDS = np.random.default_rng(7).integers(0, 2**32, (2, MINIMA), np.uint64).astype(np.uint32)
_A, _B = _SEEDS[0] | np.uint32(1), _SEEDS[1]


def rows_of(percent: int) -> int:
    """Minima of a band: the most with which a pair of this similarity shares no band with probability LOSS at most."""
    p = percent / 100
    fit = [r for r in range(1, 11) if 0 < p <= 1 and (1 - p**r) ** (MINIMA // r) <= LOSS]
    if not fit:
        raise ValueError(f"similarity of {percent} in a hundred can't be found by {MINIMA} minima")
    return fit[-1]


def least_agreeing(percent: int) -> int:
    """Minima that agree at least in signatures of this similarity (five standard deviations below it)."""
    p = percent / 100
    return max(0, int(MINIMA * p - 5 * (MINIMA * p * (1 - p)) ** 0.5))


def shingle_sets(rows: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for i, j in vt.chunks([len(r) for r in rows]):
        buf, starts = vt.join([r.lower() for r in rows[i:j]])
        hashes, _, first = vt.words(buf, starts)
        whole = vt.shingles(hashes, k)  # also those that reach over a text's end, which are not taken
        for a, b in zip(first[:-1], first[1:], strict=True):
            out.append(np.unique(whole[a : b - k + 1] if b - a >= k else vt.shingles(hashes[a:b], k)))
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minima for each set, none of which is empty."""
    at = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=at[1:])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), len(_A)), np.uint32)
    for i, (a, b) in enumerate(zip(_A, _B, strict=True)):
        out[:, i] = np.minimum.reduceat(x * a + b, at)
    return out


def band_hashes(low: np.ndarray, rows: int) -> np.ndarray:
    bands = MINIMA // rows
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(low), bands)).copy()
    for r in range(rows):
        out = vt.mix(out * np.uint64(0x9E3779B97F4A7C15) + low[:, r : bands * rows : rows])
    return out.view(np.int64)


def sketches(docs: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (set size), digest, bands and signature of each row; the last three are null for an empty set."""
    per_band = rows_of(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [t.encode() for t in texts(b)]
            for i, j in vt.chunks([len(r) for r in rows]):
                sets = shingle_sets(rows[i:j], k)
                full = [s for s in sets if len(s)]
                low = minima(full) if full else np.zeros((0, MINIMA), np.uint32)
                bands, sigs = iter(band_hashes(low, per_band)), iter(low.astype(np.uint8))
                yield pa.record_batch(
                    {
                        "doc_id": b.column("doc_id").slice(i, j - i),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        "bands": pa.array([next(bands) if len(s) else None for s in sets], pa.list_(pa.int64())),
                        "sig": pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary()),
                    }
                )

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, digest binary, bands array<long>, sig binary")


def _signed(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that sizes and signatures allow."""
    for c in ("u", "v"):
        pairs = pairs.join(reps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")), c)
    pairs = pairs.where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent).select("u", "v", "sig_u", "sig_v")
    agree = least_agreeing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, t = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, MINIMA) for c in ("sig_u", "sig_v"))
            ok = pa.array((s == t).sum(1) >= agree)
            yield b.select(["u", "v"]).filter(ok)

    return in_arrow(pairs, run, "u long, v long").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets are similar enough. Only texts of these pairs are moved."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id"))
    rows = maybe_in(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], bitmap_of(ids, ["doc_id"])).where("_bm_hit").drop("_bm_hit")
    for c in ("u", "v"):
        pairs = pairs.join(rows.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")), c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = ([(t or "").encode() for t in b.column(c).to_pylist()] for c in ("text_u", "text_v"))
            ok = []
            for i, j in vt.chunks([len(x) + len(y) for x, y in zip(us, vs, strict=True)]):
                for x, y in zip(shingle_sets(us[i:j], k), shingle_sets(vs[i:j], k), strict=True):
                    ok.append(similar(x, y, percent))
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return in_arrow(pairs, run, "u long, v long").distinct()


def _dealt(members: DataFrame, most: int, most_shingles: int) -> DataFrame:
    """Members (h, component, rep, n, ...) of buckets, once for each pair (a, b) of blocks to compare; mine is the own block.

    A component that fills more than a quarter of a block in a bucket gets blocks of its own, which meet all blocks but those
    of the same component; the others are dealt whole to shared blocks, each of which meets itself too. So a bucket of one large
    component and few other members makes about as many rows as it has members.
    """
    by = members.groupBy("h", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    filled = F.greatest(F.col("m") / most, F.col("total") / most_shingles)
    shared = F.coalesce(F.ceil(F.sum(F.when(filled <= 0.25, filled))), F.lit(0)).cast("int")
    large = F.collect_list(F.when(filled > 0.25, F.struct("component", F.ceil(filled).cast("int").alias("parts"))))
    buckets = written(by.groupBy("h").agg(F.sum("m").alias("size"), shared.alias("shared"), large.alias("large")), "near-buckets")
    rows = spread_join(members, buckets, "h", "size")
    rows = rows.withColumn("parts", F.expr("try_element_at(filter(large, x -> x.component = component), 1).parts"))
    mine = "IF(parts IS NULL, pmod(xxhash64(component), greatest(shared, 1)), xxhash64(component, CAST(pmod(xxhash64(rep), parts) AS INT)))"
    in_shared = "IF(shared > 0, transform(sequence(0, greatest(shared, 1) - 1), s -> CAST(s AS BIGINT)), CAST(array() AS ARRAY<BIGINT>))"
    in_large = "flatten(transform(filter(large, x -> x.component != component), x -> transform(sequence(0, x.parts - 1), p -> xxhash64(x.component, p))))"
    rows = rows.withColumn("mine", F.expr(mine)).withColumn("with", F.explode(F.expr(f"concat({in_shared}, {in_large})")))
    rows = rows.withColumns({"a": F.least("mine", "with"), "b": F.greatest("mine", "with")})
    return rows.drop("size", "shared", "large", "parts", "with")


def _partners(table: pa.Table, size: np.ndarray, group: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a pair of blocks, the later ones of other groups that sizes and signatures allow, in the first bucket they share.

    group may change while the pairs are gone through.
    """
    mine, band, agree = table.column("mine").to_numpy(), table.column("band")[0].as_py(), least_agreeing(percent)
    bands = np.array(table.column("bands").to_pylist(), np.int64)
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, MINIMA)
    same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
    for i in range(len(mine) - 1):
        rest = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        if not same:
            rest = rest[mine[rest] != mine[i]]
        rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
        rest = rest[(sig[rest] == sig[i]).sum(1) >= agree]
        rest = rest[(bands[rest] == bands[i]).argmax(1) == band]
        if len(rest):
            yield i, rest


def _across(members: DataFrame, comp: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) between members of one bucket that belong to different components, confirmed block by block.

    Signatures are compared first, and only members with a possible partner are dealt again, with their texts, to blocks of
    bounded memory. There a pair is not compared once links found in the block connect its components.
    """
    seen = members.where("size > 2").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    seen = seen.withColumn("component", F.coalesce("component", "rep")).select("h", "band", "rep", "component", "n")
    mixed = seen.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo != hi")
    mixed = written(mixed.select("h", "m"), "near-mixed")
    seen = written(spread_join(seen, mixed, "h", "m").drop("m"), "near-seen")
    signed = reps.select(F.col("doc_id").alias("rep"), "bands", "sig")

    def possible(table: pa.Table) -> pa.Table:
        hit = np.zeros(len(table), bool)
        for i, rest in _partners(table, table.column("n").to_numpy(), table.column("component").to_numpy(), percent):
            hit[i] = hit[rest] = True
        return table.select(["h", "band", "rep", "component", "n"]).filter(pa.array(hit))

    few = by_group(_dealt(seen, SIGNED_BLOCK, 1 << 62).join(signed, "rep"), ["h", "a", "b"], possible, "h long, band int, rep long, component long, n long")
    few = written(few.distinct(), "near-possible")
    ids = bitmap_of(few.select(F.col("rep").alias("doc_id")), ["doc_id"])
    rows = maybe_in(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], ids).where("_bm_hit")
    dealt = _dealt(few, BLOCK, BLOCK_SHINGLES).join(signed, "rep").join(rows.select(F.col("doc_id").alias("rep"), "text"), "rep")

    def links(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        sets = shingle_sets([(t or "").encode() for t in table.column("text").to_pylist()], k)
        _, group = np.unique(table.column("component").to_numpy(), return_inverse=True)  # merged as links are found
        us, vs = [], []
        for i, rest in _partners(table, np.array([len(x) for x in sets]), group, percent):
            for r in rest:
                if group[r] != group[i] and similar(sets[i], sets[r], percent):
                    us.append(max(rep[i], rep[r]))
                    vs.append(min(rep[i], rep[r]))
                    group[group == group[r]] = group[i]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return by_group(dealt, ["h", "a", "b"], links, "u long, v long").where("u != v").distinct()


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs."""
    spark = docs.sparkSession
    tune(spark)
    sets = written(sketches(docs, k, percent), "near-sketches")
    known = sets.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    least = written(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")), "near-least")
    alone = sets.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("rep"))
    rows = written(alone.unionByName(spread_join(known.select("doc_id", "n", "digest"), least, "digest", "size").select("doc_id", "n", "rep")), "near-rows")
    reps = written(known.join(least.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["digest", "doc_id"]).select("doc_id", "n", "bands", "sig"), "near-reps")
    remove(spark, sets.at)

    bands = reps.select(F.col("doc_id").alias("rep"), "n", F.posexplode("bands").alias("band", "h"))
    stars = written(bands.groupBy("h").agg(F.min("rep").alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1"), "near-stars")
    members = written(spread_join(bands, stars, "h", "size").select("h", "band", "rep", "n", "c", "size"), "near-members")
    pairs = members.where("rep != c").select(F.col("rep").alias("u"), F.col("c").alias("v")).distinct()
    pairs = written(_signed(pairs, reps, percent), "near-pairs")
    links = written(_confirmed(pairs, docs, k, percent), "near-links")
    comp = written(components(links), "near-components")

    more = written(_across(members, comp, reps, docs, k, percent), "near-links")
    if not more.isEmpty():
        comp = written(components(links.unionByName(more)), "near-components")
    out = rows.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group of near duplicates, that of the smallest doc_id."""
    gone = near_duplicates(docs, k, percent).where("NOT kept").select("doc_id")
    return except_keys(docs, ["doc_id"], gone)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=2)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
u AS (SELECT doc_id, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.g) + len(y.g) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept FROM g LEFT JOIN c ON a = doc_id
"""
