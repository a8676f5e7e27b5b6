import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from codegauge.llm import topk


def quantised(v):
    return [math.floor(256 * Fraction(c)) for c in v]


def brute(rows, k=5):
    """Sorted (query_id, rank, vec_id, score) of each row whose id is divisible by 50, against all other rows."""
    x = [(i, quantised(v)) for i, v, *_ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, (i, q) in enumerate(x):
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, y, strict=True)), j) for m, (j, y) in enumerate(x) if m != n and len(y) == len(q))
            out += [(i, r, j, min(topk.MOST, max(topk.LEAST, -t))) for r, (t, j) in enumerate(s[:k], 1)]
    return sorted(out)


def found(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, score string")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BYTES", 2000)
    monkeypatch.setattr(topk, "SEED", 4)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=8)], "x") for i in range(400)]
    rows += [(i, rows[7][1], "x") for i in range(400, 520)]  # one common vector: ties
    rows += [(700, None, ""), (750, [], ""), (800, [1.0, None] * 4, ""), (850, [float("nan")] * 8, ""), (900, [float("inf")] + [0.0] * 7, ""), (950, [0.5] * 3, ""), (951, [0.25] * 3, ""), (50, rows[50][1], ""), (None, rows[1][1], "")]
    assert found(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>, score string")
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_rows_of_one_id_are_candidates_each(spark):
    rows = [(0, [1.0, 0.0], ""), (1, [2.0, 0.0], ""), (1, [3.0, 0.0], ""), (0, [0.5, 1.0], "")]
    assert found(spark, rows) == brute(rows)
    assert (0, 1, 1, 3 * 65536) in found(spark, rows)


def test_very_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=4)], "") for i in range(120)]
    rows += [(200 + i, [float(np.float32(c * s)) for c in rng.normal(size=4)], "") for i, s in enumerate([1e8, 1e8, 1e8, 1e30, 1e30, 1e30, 2.0**33, 1e5, 1e4] * 6)]
    assert found(spark, rows) == brute(rows)
    wide = [(i, [float(c) for c in rng.normal(size=3) * 10.0 ** (i % 300)], "") for i in range(100)] + [(500, [1.7e308, 0.0, -1.0], ""), *((501 + i, [1.6e308, float(i), 1.0], "") for i in range(6))]
    assert found(spark, wide, "double") == brute(wide)


def rows_of(x, pivots):
    return topk.Rows(np.arange(len(x)), np.arange(len(x)), x, topk.distances(x, pivots))


def share(x, blocks):
    """The share of pairs that are evaluated, after a check of the results."""
    pivots = topk.choose_pivots(x[: topk.PIVOT_SAMPLE])
    rows, counter = rows_of(x, pivots), [0]
    q = np.arange(0, len(x), 50)
    queries, best = rows.part(q), [topk.Best(5) for _ in q]
    order = np.argsort(rows.d[:, 1:].argmin(1), kind="stable")
    for part in np.array_split(order, blocks):
        topk.meet(queries, rows.part(part), best, counter)
    for i, b in zip(q, best, strict=True):
        s = np.where(rows.vec_id == i, -np.inf, x @ x[i])
        assert [(-t, j) for t, j in b.rows] == [(int(s[j]), int(j)) for j in np.lexsort((rows.vec_id, -s))[:5]]
    return counter[0] / (len(q) * len(x))


def test_bounds_stop_the_search():
    """On vectors in clusters the bounds spare most evaluations, within blocks and by whole blocks."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 300
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 5)
    assert share(x, 1) < 0.3 and share(x, 16) < 0.3
    x = rng.normal(size=(2000, 64))
    assert share(np.floor(x / np.linalg.norm(x, axis=1)[:, None] * 256), 4) <= 1
