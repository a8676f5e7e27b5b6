import math
import random
import re
from collections import Counter

import pytest

from codegauge.llm import ranked_search as op

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id long, score double, term string"


def words_of(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=op.TOP):
    """docs: (doc_id, text); items: (item_id, text)."""
    found = [(d, Counter(words_of(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n, total = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for d, c in found:
            m = 75 + 25 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in words_of(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        for rank, (s, null, d) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if null else d, -s] += 1
    return out


def got(spark, df, items, **options):
    asked = spark.createDataFrame([(*i, 1, 0.5, "x") for i in items], ITEMS)
    return Counter(tuple(r) for r in op.search(df, asked, **options).select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture
def corpus(words):
    """Skewed words: some in nearly all documents, some in few; equal documents; a source of ties."""
    rng = random.Random(3)
    pool = sorted(set(words(300, seed=2)))
    pairs = [(i, " ".join(pool[int(rng.random() ** 3 * len(pool))] for _ in range(rng.randint(1, 40))), "en") for i in range(400)]
    return pairs + [(1000 + i, "Same WORDS here, same", "en") for i in range(60)] + [(5, "same words", "en")] * 30


@pytest.fixture
def items(corpus):
    rng = random.Random(4)
    return [(i, corpus[rng.randrange(400)][1] + (" same" if i % 3 else " SAME words same")) for i in range(12)] + [(1, "same"), (1, "same"), (None, "words here"), (50, None), (51, ""), (52, "nowhereatall"), (53, "...")]


@pytest.mark.parametrize("shard, block, vocabulary", [(1 << 21, 1 << 19, 1 << 19), (60, 40, 0)])
def test_brute_force(spark, docs, corpus, items, monkeypatch, shard, block, vocabulary):
    """Also with many small shards, several blocks of queries and an index of all terms."""
    monkeypatch.setattr(op, "SHARD_TERMS", shard)
    monkeypatch.setattr(op, "BLOCK_TERMS", block)
    monkeypatch.setattr(op, "VOCABULARY", vocabulary)
    assert got(spark, docs(corpus).repartition(3), items) == brute([p[:2] for p in corpus], items)


def test_odd_rows(spark, docs, odd):
    items = [(1, "The cat, the DOG"), (2, "ünï 漢字 word"), (3, odd[6][1])]
    assert got(spark, docs(odd), items) == brute([p[:2] for p in odd], items)


def test_empty(spark, docs):
    assert not got(spark, docs([]), [(1, "a")])
    assert not got(spark, docs([(1, "a", "en"), (2, None, None)]), [])


def test_long_text_is_cut_between_terms(monkeypatch):
    monkeypatch.setattr(op, "PART", 7)
    text = "Ab cé-9 " * 50 + "漢" * 30 + " end"
    assert {t.decode(): n for t, n in op.terms(text).items()} == Counter(words_of(text))


def test_lists_below_the_bound_give_no_documents():
    """A frequent term's list is only probed, and no list at all is read where the bounds don't reach the best."""

    class Probed(dict):
        def __getitem__(self, t):
            seen.append(t)
            return super().__getitem__(t)

    shard = op.Shard(None)
    for i in range(100):
        shard.add(i, Counter({b"often": 1} | ({b"rare": 1} if i % 50 == 7 else {})))
    row = {c: v[0].as_py() for c, v in zip(op._INDEX_KINDS, shard.batch().columns, strict=True)}
    lists = op.Lists(row, {b"often": 10, b"rare": 4000}, 100, 102)
    query = [(b"often", 1), (b"rare", 1)]
    every, scores = lists.search(query, 200, 1)
    assert len(every) == 100
    docs, best = lists.search(query, 2, lists.bound[b"often"] + 1)
    assert docs.tolist() == [7, 57] and best.tolist() == scores[[7, 57]].tolist()
    seen = []
    lists.docs = Probed(lists.docs)
    assert not len(lists.search(query, 2, sum(lists.bound.values()) + 1)[0]) and not seen
