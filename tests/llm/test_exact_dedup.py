import hashlib
import os
import re
from collections import Counter, defaultdict

import pytest

from codegauge.llm import exact_dedup as op


def brute(pairs):
    groups = defaultdict(list)
    for k, (i, t, _) in enumerate(pairs):
        t = t or ""
        n = re.sub("[\x20\x09-\x0d]", "", t)
        groups[n].append((-len(t), i is None, i or 0, k, i))
    out = []
    for n, members in groups.items():
        best = min(members, key=lambda m: m[:3])
        for m in members:
            out.append((m[4], best[4], len(members), hashlib.sha256(n.encode()).hexdigest()))
    return Counter(out), len(groups)


@pytest.mark.parametrize("chars", [64, 1])
def test_brute_force(docs, odd, chars):
    got = op.groups(docs(odd), chars).collect()
    want, n = brute(odd)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == n
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_hot_group(docs, monkeypatch):
    monkeypatch.setattr(op, "COPIES", 3)
    pairs = [(i, "a b" if i % 2 else "ab", "en") for i in range(50)] + [(i, f"t{i}", "en") for i in range(50, 60)]
    got = op.groups(docs(pairs)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(pairs)[0]


def test_empty_and_columns(docs, odd):
    empty = docs([])
    assert op.groups(empty).count() == 0 and op.keep_first(empty).columns == empty.columns
    kept = op.keep_first(docs(odd))
    assert kept.columns == empty.columns and kept.count() == brute(odd)[1]


def test_state_is_on_disk_and_has_no_watermark(spark, docs, odd):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    op.groups(docs(odd)).count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert "RocksDB" in op._STATE["spark.sql.streaming.stateStore.providerClass"]


def test_state_is_met_by_later_batches(docs, odd, monkeypatch):
    """Many micro-batches, each of one file: groups reach over them, and the result is that of one batch."""
    at = []
    monkeypatch.setattr(op, "scratch", lambda spark, name, f=op.scratch: at.append(f(spark, name)) or at[-1])
    monkeypatch.setattr(op, "BATCH_BYTES", "1")
    pairs = odd + [(100 + i, f"a  b{i % 5}" if i % 2 else f"ab{i % 5} ", "en") for i in range(60)]
    got = op.groups(docs(pairs).repartition(6)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(pairs)[0]
    batches = [n for n in os.listdir(next(a for a in at if "dedup-state" in a).removeprefix("file://") + "/commits") if n.isdigit()]
    assert len(batches) >= 3
