import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from codegauge.llm import merkle as op


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc, text):
    fields = [doc.doc_id, doc.source, doc.lang, doc.n_chars, text]
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def tree(nodes):
    """All levels, from the leaves."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def climb(levels, pos, digest):
    """The siblings on the way up, and what the digest gives at the top."""
    out = []
    for level in levels[:-1]:
        run = level[pos // 3 * 3 : pos // 3 * 3 + 3]
        out += run[: pos % 3] + run[pos % 3 + 1 :]
        digest = h(*run[: pos % 3], digest, *run[pos % 3 + 1 :])
        pos //= 3
    return out, digest


def brute(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r.source].append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = [], []
    for s in order:
        m = sorted(sources[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        members.append(m)
        trees.append(tree([leaf(r, r.text) for r in m]))
    top = tree([t[-1][0] for t in trees]) if trees else []
    out = Counter()
    for k, m in enumerate(members):
        for pos, r in enumerate(m):
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            seen = leaf(r, r.text.replace("\n", "") if changed and r.text is not None else r.text)
            a, got = climb(trees[k], pos, seen)
            b, got = climb(top, k, got)
            out[r.doc_id, trees[k][0][pos], trees[k][-1][0], top[-1][0], h(*a, *b), got, got == top[-1][0]] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in op.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_odd_rows(docs, odd):
    df = docs(odd)
    assert got(df) == brute(df.collect())


@pytest.mark.parametrize("step", [1, 2])
def test_several_steps(spark, docs, monkeypatch, step):
    """Sources of 0 to 130 rows and one of a third of all, so that trees end at all heights, also between steps."""
    monkeypatch.setattr(op, "STEP", step)
    monkeypatch.setattr(op, "BLOCK", 3**step)
    monkeypatch.setattr(op, "BROADCAST_ROWS", 5)
    rng = random.Random(step)
    sizes = [1, 2, 3, 4, 9, 10, 27, 28, 82, 130]
    rows = [(rng.randrange(10**6), f"a\n{i}" if i % 3 else "same", "en", f"s{k}ä" if k else None, 7, n) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, level int").repartition(5)
    assert got(df) == brute(df.collect())


@pytest.mark.parametrize("n", [0, 2])
def test_small(docs, n):
    df = docs([(i, "a\nb", "en") for i in range(n)])
    assert got(df) == brute(df.collect())


def test_hot_document(docs):
    """Equal rows, a third of all, have a leaf each."""
    df = docs([(7, "x\ny", "en")] * 40 + [(i, "z\n", "de") for i in range(80)])
    assert got(df) == brute(df.collect())


def test_proofs_are_read_from_the_store(spark, docs):
    """Without its stored nodes no tree of more than one run has proofs."""
    trees = op.positions(op.written(op.leaves(docs([(i, "t", "en") for i in range(30)])), "t"), "source", ["doc_id", "digest", "row"], "t")
    store = op.Store(spark, "t-nodes").build(trees)
    levels = {r.level: r.n for r in store.level(1, 9).groupBy("level").agg(op.F.count("pos").alias("n")).collect()}
    assert levels == {1: 10, 2: 4, 3: 2, 4: 1}
    assert sorted(p.rsplit("/", 1)[-1] for p in [f.rsplit("/", 1)[0] for f in store.level(1, 9).inputFiles()]) == sorted(f"level={k}" for k in levels)
