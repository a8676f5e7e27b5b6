"""Containment joins, repeats, bounded ranking and dealing of files, against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codegauge import code_queries
from codegauge.operators import containment, facts, repeats, shared
from codegauge.operators.ranking import ranked
from codegauge.sources import kotlin


@pytest.mark.parametrize("hot", [1024, 4])
def test_within_against_pairs(spark, monkeypatch, hot):
    """Nested, crossing, empty and equal spans; nulls; one group with a third of all, in slices too."""
    monkeypatch.setattr(containment, "HOT", hot)
    monkeypatch.setattr(containment, "SLICES", 8)
    rng = random.Random(hot)
    rows = [(rng.choice("aaabcdef"), i, s, s + rng.choice([0, 1, 5, 30, 90])) for i in range(400) for s in [rng.randrange(100)]]
    rows += [("a", 900 + i, 7, 9) for i in range(20)] + [("a", 990, None, 3), ("a", 991, 3, None), (None, 992, 1, 99), ("b", 993, 9, 2)]
    df = spark.createDataFrame(rows, "g string, id long, start long, end long")
    outer, inner = df.where("id % 3 = 0"), df.where("id % 2 = 0")
    got = sorted((r.g, r.outer_id, r.inner_id) for r in containment.within(outer, inner, ["g"]).collect())
    ok = [r for r in rows if None not in r and r[3] >= r[2]]
    want = sorted((o[0], o[1], i[1]) for o in ok if o[1] % 3 == 0 for i in ok if i[1] % 2 == 0 and i[0] == o[0] and i[2] > o[2] and i[3] <= o[3])
    assert got == want and len(got) > 500


def test_sweep_is_linear_in_spans():
    """A hundred thousand spans, none of which lies in another, or each in one."""
    n = 100_000
    assert not list(containment.swept((i, k % 2, i + 1, i) for k, i in enumerate(range(n))))
    nested = sorted((s, o, e, i) for i in range(n) for s, o, e in [(10 * i, 1, 10 * i + 9), (10 * i + 1, 0, 10 * i + 8)])
    assert len(list(containment.swept(iter(nested)))) == n


def test_nodes_and_containment(spark):
    source = "class A {\n  fun f(x: Int) {\n    if (x > 0) {\n      for (i in 0..x) { g(i) }\n    }\n  }\n  val y = 1\n}\nfun top() = h()\n"
    java = "class A { void f(int x) { if (x > 0) { while (x > 1) { g(x); } } } }"
    src = spark.createDataFrame([("k", "A.kt", "kotlin", source), ("j", "A.java", "java", java), ("bad", "B.kt", "kotlin", "fun f( {"), ("n", "C.kt", "kotlin", None)], "codebase string, path string, lang string, source string")
    nodes = shared.checkpointed(facts.nodes(src))
    pairs = facts.inside(nodes.where("kind IN ('class', 'function', 'method')"), nodes.where("kind IN ('decision', 'if', 'while')"))
    names = nodes.select("codebase", F.col("node_id").alias("outer_id"), "name")
    got = sorted((r.codebase, r.name) for r in pairs.join(names, ["codebase", "outer_id"]).collect())
    assert got == [("j", "A"), ("j", "A"), ("j", "f"), ("j", "f"), ("k", "A"), ("k", "A"), ("k", "f"), ("k", "f")]
    found = {(n[2], n[3]): n for n in kotlin.nodes(source)}
    assert found["function", "f"][1] == found["class", "A"][0] and found["function", "top"][1] == -1 and found["function", "f"][6:] == (2, 6)
    f = kotlin.File(source)
    inner = {(n[4], n[5]) for n in kotlin.nodes(source) if n[2] == "decision"}
    assert {s for span in f.functions for s in f.within(span, f.decisions)} == inner  # the operator's rule is the lexer's


def brute(rows, size):
    """Positions whose run of tokens occurs again: those inside maximal repeats of pairs; and matches with first occurrences."""
    again, first, links = set(), {}, {}
    for s, k, t in sorted(rows, key=lambda r: r[:2]):
        for p in range(len(t) - size + 1):
            for s2, k2, t2 in rows:
                for q in range(len(t2) - size + 1):
                    if s2 == s and (k2, q) != (k, p):
                        n = 0
                        while p + n < len(t) and q + n < len(t2) and t[p + n] == t2[q + n]:
                            n += 1
                        if n >= size:
                            again |= {(s, k, p + i) for i in range(n - size + 1)}
            at = first.setdefault((s, tuple(t[p : p + size])), (k, p))
            if at != (k, p):
                links[s, k, p] = at
    found = set()
    for (s, k, p), (k2, q) in links.items():
        if links.get((s, k, p - 1)) != (k2, q - 1):
            n = 0
            while links.get((s, k, p + n)) == (k2, q + n):
                n += 1
            found.add((s, k, p, n + size - 1, k2, q))
    return again, found


@pytest.mark.parametrize("seed, hot", [(1, 1024), (2, 8)])
def test_repeats_against_pairs(spark, monkeypatch, seed, hot):
    """Random sequences of few tokens, copies, a run of one token, an empty and a null one."""
    monkeypatch.setattr(shared, "HOT", hot)
    monkeypatch.setattr(shared, "LIGHT", hot)
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), f"f{i}", [rng.choice([1, 2, -(2**60)]) for _ in range(rng.randint(0, 25))]) for i in range(8)]
    rows += [("a", "copy", rows[0][2] + [9]), ("b", "run", [7] * 30), ("b", "none", [])]
    df = spark.createDataFrame([*rows, ("b", "null", None)], "scope string, path string, tokens array<long>")
    again, found = brute(rows, 3)
    assert {(r.scope, r.path, r.pos) for r in repeats.repeated(df, "scope", "path", size=3).collect()} == again
    assert {tuple(r) for r in repeats.matches(df, "scope", "path", 3).collect()} == found
    lines = df.withColumn("lines", F.transform("tokens", lambda x, i: (i / 2).cast("int")))
    got = {r.scope: r.covered for r in repeats.covered_lines(lines, "scope", "path", 3).collect()}
    assert got == {s: len({(k, (p + i) // 2) for t, k, p in again for i in range(3) if t == s}) for s in {t for t, _, _ in again}}


def test_ranked_keeps_k_rows_of_a_task(spark):
    rows = spark.range(50_000).selectExpr("IF(id % 3 = 0, 'hot', concat('g', id % 50)) AS g", "pmod(xxhash64(id), 1000) AS v", "id").repartition(6)
    best = ranked(rows, ["g"], [F.desc("v"), "id"], 5)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "ollect" not in plan
    by = {}
    for r in rows.collect():
        by.setdefault(r.g, []).append((-r.v, r.id))
    assert {(r.g, r["rank"], r.id) for r in best.collect()} == {(g, k, i) for g, m in by.items() for k, (_, i) in enumerate(sorted(m)[:5], 1)}


def test_files_are_dealt_by_bytes(spark):
    """One input split becomes as many tasks as cores at least; large files lie apart; all rows stay."""
    rows = [("c", f"S{i}.java", "java", f"class S{i} {{}}" + " " * (i % 700)) for i in range(400)] + [("c", f"L{i}.java", "java", "class L {}" + " " * 200_000) for i in range(5)] + [("c", "N.java", "java", None)]
    src = spark.createDataFrame(rows, "codebase string, path string, lang string, source string").coalesce(1)
    out = facts.dealt(src, 50_000, 100_000)
    tasks = sorted(facts.skew(out).collect(), key=lambda r: r.bytes)
    small = [r for r in tasks if r.bytes < 100_000]
    assert sum(r.files for r in tasks) == len(rows) and sorted(r.files for r in tasks if r.bytes >= 100_000) == [1] * 5
    assert len(small) >= 2 * spark.sparkContext.defaultParallelism and max(r.bytes for r in small) < 2 * min(r.bytes for r in small)
    assert facts.dealt(src.where("false")).count() == 0


@pytest.mark.parametrize("query, parser", [("code_smells", "extract"), ("nodes_within", "nodes")])
def test_one_content_is_parsed_once(spark, tmp_path, monkeypatch, query, parser):
    """Parts of equal shapes make equal files: many codebases, few contents, and the rows of each part by itself."""
    seen, parse = [], getattr(facts, parser)
    monkeypatch.setattr(facts, parser, lambda sources: seen.append(sources.count()) or parse(sources))
    same = 60 * 7 * 13 * 512  # keys that differ by it make the same shapes
    for folder, copies in (("one", 1), ("many", 20)):
        rows = [(k + same * c, f"b{k}", k + 3) for k in (1, 5, 44) for c in range(copies)]
        spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/{folder}/part.parquet")
    one, many = (code_queries.QUERIES[query](spark, f"{tmp_path}/{folder}").collect() for folder in ("one", "many"))
    assert seen[0] == seen[1] <= 6
    by = Counter(tuple(r)[1:] for r in one)
    assert one and Counter(tuple(r)[1:] for r in many) == Counter({k: 20 * n for k, n in by.items()})
    assert {r.codebase for r in one} < {r.codebase for r in many} and len(many) == 20 * len(one)


def test_by_content_of_odd_rows(spark):
    """Null codebases, sources and paths, and repeated rows: as without it."""
    rows = [("a", "A.java", "java", "class A {}"), ("a", "A.java", "java", "class A {}"), (None, "A.java", "java", "class A {}"), (None, "B.java", "java", None), ("b", "B.java", "java", ""), ("b", "A.kt", "kotlin", "class A"), ("c", "A.java", "java", "class {")]
    src = spark.createDataFrame(rows, "codebase string, path string, lang string, source string")
    plain = lambda df: Counter(str(r.asDict(recursive=True)) for r in df.collect())
    assert plain(facts.by_content(src, facts.extract)) == plain(facts.extract(src))
    assert facts.by_content(src.limit(0), facts.extract).count() == 0
