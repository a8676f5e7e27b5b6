import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codegauge.llm import token_output as op


def brute(lengths, window):
    """Best fit by looking at all rows."""
    free, rows = [], []
    for i, n in enumerate(lengths):
        fits = [(c, k) for k, c in enumerate(free) if c >= n]
        if fits:
            c = min(fits)[0]
            k = next(k for k in range(len(free)) if free[k] == c)
        else:
            k = len(free)
            free.append(window)
            rows.append([])
        rows[k].append(i)
        free[k] -= n
    return rows, free


@given(st.lists(st.integers(1, 37), max_size=80))
@settings(max_examples=200, deadline=None)
def test_best_fit_against_brute_force(lengths):
    lengths.sort(reverse=True)
    rows = op.best_fit_decreasing(lengths, 37)
    want, free = brute(lengths, 37)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert sorted(37 - sum(lengths[i] for i in r) for r in rows) == sorted(free)
    assert len(rows) == len(want)


def check(rows, wanted, window):
    got = {}
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == window and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] <= window
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            got.setdefault(d, []).append((s, ids[a:b].tolist()))
            assert positions[a:b].tolist() == list(range(b - a))
        rest = r.cu_seqlens[-1]
        assert (ids[rest:] == op.END).all() and positions[rest:].tolist() == list(range(window - rest))
    assert {d: [x for _, p in sorted(parts) for x in p] for d, parts in got.items()} == wanted


def test_round_trip(docs, odd):
    pairs = odd[:9] + [(i, "cat dog " * (i % 60), "en") for i in range(100, 300)]
    encode = op.encoding(op.RANKS).encode_ordinary
    wanted = {i: [*encode(t or ""), op.END] for i, t, _ in pairs}
    for window, shard in ((2048, 1 << 20), (64, 500)):
        rows = op.sequences(docs(pairs), window=window, shard_tokens=shard).collect()
        check(rows, wanted, window)
        assert len({r.sequence_id for r in rows}) == len(rows)
        assert sum(r.cu_seqlens[-1] for r in rows) > 0.9 * window * (len(rows) - 10)


def test_matrices(spark, docs, odd, tmp_path):
    op.write_matrices(docs(odd[:9]), str(tmp_path / "m"), window=128)
    blocks = spark.read.parquet(str(tmp_path / "m")).collect()
    rows = {r.sequence_id: r for r in op.sequences(docs(odd[:9]), window=128).collect()}
    assert sum(b.n_rows for b in blocks) == len(rows)
    for b in blocks:
        ids = np.frombuffer(b.ids, "<u2").reshape(b.n_rows, 128)
        assert all(c[0] == 0 for c in b.cu_seqlens) and ids.shape == np.frombuffer(b.positions, "<u2").reshape(b.n_rows, 128).shape
    stacked = sorted(zlib.crc32(np.frombuffer(b.ids, "<u2").reshape(b.n_rows, 128)[k].tobytes()) for b in blocks for k in range(b.n_rows))
    assert stacked == sorted(zlib.crc32(r.ids) for r in rows.values())
    back = {r.sequence_id: r for r in op.rows_of(spark.read.parquet(str(tmp_path / "m"))).collect()}
    assert {k: (sorted(map(str, r.doc_ids)), r.cu_seqlens[-1], bytes(r.positions)) for k, r in back.items()} == {k: (sorted(map(str, r.doc_ids)), r.cu_seqlens[-1], bytes(r.positions)) for k, r in rows.items()}
    plain = {k: (r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[-1], zlib.crc32(r.ids), zlib.crc32(r.positions)) for k, r in back.items()}
    assert {r.sequence_id: tuple(r)[1:] for r in op.digests(spark.read.parquet(str(tmp_path / "m"))).collect()} == plain
    encode = op.encoding(op.RANKS).encode_ordinary
    check(back.values(), {i: [*encode(t or ""), op.END] for i, t, _ in odd[:9]}, 128)


def test_query_reads_what_was_written(spark, docs, odd, tmp_path, monkeypatch):
    """The digests are those of the written matrices: of other matrices they differ."""
    docs(odd[:9]).write.parquet(str(tmp_path / "documents.parquet"))
    want = op.op6_token_output(spark, str(tmp_path)).collect()
    assert sum(r.n_tokens for r in want) == sum(r.cu_seqlens[-1] for r in op.sequences(docs(odd[:9])).collect())
    monkeypatch.setattr(op, "write_matrices", lambda d, path, f=op.write_matrices: f(d.where("doc_id = 1"), path))
    assert [r.doc_ids for r in op.op6_token_output(spark, str(tmp_path)).collect()] == [[1]]


def test_odd_rows(docs, odd):
    rows = op.sequences(docs(odd[7:])).collect()
    flat = [d for r in rows for d in r.doc_ids]
    assert flat.count(9) == 2 and flat.count(None) == 2
    assert op.sequences(docs([])).count() == 0 and op.matrices(op.sequences(docs([]))).count() == 0
