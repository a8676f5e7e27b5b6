import random
import re

import pytest
from pyspark.sql import functions as F

from codegauge.llm import common
from codegauge.llm import components as cc
from codegauge.llm import near_dedup as op

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else ({tuple(w)} if w else set())


def brute(pairs, k, percent=80):
    """doc_id to (set size, component)."""
    items = [(i, shingles(t, k)) for i, t, _ in pairs]
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            (i, x), (j, y) = items[a], items[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return sorted(((i, len(s), find(i)) for i, s in items), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def variants(words, n=60, seed=3):
    """Groups of texts with some words changed, of all similarities, and chains of small changes."""
    rng = random.Random(seed)
    out, base = [], []
    for i in range(n):
        if i % 6 == 0:
            base = words(rng.choice([3, 40, 120]), seed=seed * 1000 + i)
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 9])):
            t[rng.randrange(len(t))] = f"new{rng.randrange(9999)}"
        if i % 3 == 0:
            base = t
        out.append((i + 1, " ".join(t), "en"))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_brute_force(docs, odd, words, k):
    pairs = [(i + 1000 if i is not None else None, t, lang) for i, t, lang in odd] + variants(words)
    assert got(op.near_duplicates(docs(pairs), k)) == brute(pairs, k)


def test_blocks_of_one_bucket(docs, words, monkeypatch):
    """Members of a hot bucket in several blocks: chains whose links don't touch the bucket's smallest member."""
    monkeypatch.setattr(op, "BLOCK", 4)
    monkeypatch.setattr(op, "SIGNED_BLOCK", 4)
    base = words(60, seed=9)
    pairs, t = [], list(base)
    for i in range(24):
        t = list(t)
        t[(7 * i) % 60] = f"x{i}"
        pairs.append((i, " ".join(t), "en"))
    assert got(op.near_duplicates(docs(pairs), 2)) == brute(pairs, 2)


def test_blocks_meet_linearly(spark):
    """A large component and few others: each pair of components meets once, and rows grow with the members, not their square."""
    members = [(1, 0, i, 0, 9) for i in range(5000)] + [(1, 0, 6000 + i, 6000 + i, 9) for i in range(3)] + [(2, 0, 1, 0, 9), (2, 0, 2, 2, 9)]
    rows = op._dealt(spark.createDataFrame(members, "h long, band int, rep long, component long, n long"), 512, 1 << 62).collect()
    large = [r for r in rows if r.h == 1 and r.component == 0]
    assert len(large) == 5000 and len(rows) < 5100
    meets = {}
    for r in rows:
        meets.setdefault((r.h, r.a, r.b), []).append(r)
    assert max(map(len, meets.values())) < 1024
    pairs = [(r.rep, s.rep) for g in meets.values() for r in g for s in g if r.h == 1 and r.component == 0 and s.rep == 6001]
    assert sorted(p[0] for p in pairs) == list(range(5000))


@pytest.mark.parametrize("percent", [60, 90])
def test_other_similarities(docs, words, percent):
    pairs = variants(words, seed=percent)
    assert got(op.near_duplicates(docs(pairs), 2, percent)) == brute(pairs, 2, percent)


def test_banding():
    assert [op.rows_of(p) for p in (60, 80, 90)] == [3, 5, 7] and op.least_agreeing(80) == 117
    with pytest.raises(ValueError):
        op.rows_of(5)


def test_kept_and_empty(docs, odd):
    empty = docs([])
    assert op.near_duplicates(empty).count() == 0 and op.keep_one(empty).columns == empty.columns
    rows = op.near_duplicates(docs(odd)).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    assert op.keep_one(docs(odd)).count() == sum(r.kept for r in rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    found = cc.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in found} == {x: find(x) for x in root} and len(found) == len(root)
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_rows_of_hot_groups(spark, monkeypatch, kind):
    """Rows meet their groups, hot or not, as by a plain join, and no join but those with the groups passes over all rows."""
    monkeypatch.setattr(common, "HOT", 16)
    rng = random.Random(4)
    keys = [rng.choice([1, 1, 1, 2, *range(3, 40)]) for _ in range(600)] + [None] * 5
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").withColumn("k", F.col("k").cast("string").cast(kind))
    groups = common.written(rows.where("i % 5 > 0 AND k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("m")), "test-groups")
    out = common.spread_join(rows, groups, "k", "m")
    assert sorted((bytes(r.k) if kind == "binary" else r.k, r.i, r.m) for r in out.collect()) == sorted((bytes(r.k) if kind == "binary" else r.k, r.i, r.m) for r in rows.join(groups, "k").collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Join Inner") == 2
