import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codegauge.llm import byte_bpe, packing, token_counts

TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'▁aéß<|>0½İıſœ’“—…€²\u0301\u00a0")), max_size=80)


@given(st.lists(TEXT, max_size=6), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_counts_of_split_texts(rows, most):
    sp, safe = token_counts.load(token_counts.MODEL)
    assert safe and token_counts.counts(token_counts.MODEL, rows, most) == [len(sp.encode(t)) for t in rows]


@pytest.fixture(scope="module")
def tiktoken_like():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(TEXT)
@settings(max_examples=100, deadline=None)
def test_byte_bpe_round_trip(tiktoken_like, text):
    c = byte_bpe.codec(byte_bpe.RANKS, public_tokenizers.PATTERN)
    ids = c.encode(text)
    assert ids == tiktoken_like.encode_ordinary(text) and c.decode(ids) == text.encode()


def test_every_token_comes_from_the_model_and_goes_back_through_its_pieces():
    """No match is looked up beside the model: each token of the vocabulary is what the model merges its bytes to."""
    tokens = byte_bpe.read_ranks(byte_bpe.RANKS)
    c = byte_bpe.Codec(byte_bpe.RANKS, public_tokenizers.PATTERN)
    assert all(c.sp.encode("".join(c.chars[b] for b in t)) == [i] and c.decode([i]) == t for i, t in enumerate(tokens))
    asked = []
    c.sp = type("Counted", (), {"encode": lambda self, s, f=c.sp.encode: asked.append(s) or f(s)})()
    assert len(c.encode("the the cat")) == 3 and asked == ["the", "\u0120the", "\u0120cat"]


@given(st.lists(TEXT, max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_encode_as_whole_texts(rows):
    w = packing.words(packing.TOKENIZER)
    want = [e.ids for e in w.tokenizer.encode_batch(rows, add_special_tokens=False)]
    assert [np.frombuffer(x, w.kind).tolist() for x in w.encode(rows)] == want


def test_count_tokens(docs, odd):
    sp, _ = token_counts.load(token_counts.MODEL)
    got = token_counts.count_tokens(docs(odd)).collect()
    want = [(i, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, _ in odd]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert token_counts.count_tokens(docs([])).count() == 0


def test_round_trip_table(docs, odd, tiktoken_like):
    got = byte_bpe.round_trip(docs(odd)).collect()
    want = []
    for i, t, _ in odd:
        ids = tiktoken_like.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    back = byte_bpe.decode_ids(byte_bpe.encode_ids(docs(odd))).collect()
    assert sorted((bytes(r.bytes) for r in back)) == sorted((t or "").encode() for _, t, _ in odd)
    assert byte_bpe.round_trip(docs([])).count() == 0


def test_packing(docs, odd):
    many = odd[:9] + [(i, f"text {i} of words " + "cat dog " * (i % 50), "en") for i in range(100, 400)]
    pieces = packing.packed(docs(many), shard_tokens=4000).collect()
    w = packing.words(packing.TOKENIZER)
    ids = {i: [*w.tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END] for i, t, _ in many}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert list(np.frombuffer(p.ids, "<u4")) == ids[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(ids[p.doc_id])
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        parts.sort()
        assert [s for s, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) == len(ids[d])
    for parts in by_sequence.values():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert total <= 2048 and total & (total - 1) == 0  # full, or a power of two
    assert {r.ids_crc32 for r in packing.digests(packing.packed(docs(odd[:1]))).collect()} == {zlib.crc32(np.array(ids[1], "<u4").tobytes())}
    assert packing.packed(docs([])).count() == 0


def test_repeated_rows_and_null_ids_are_packed(docs, odd):
    pieces = packing.packed(docs(odd[8:])).collect()
    assert sum(p.length for p in pieces if p.doc_id == 9) == 2 * [p.doc_tokens for p in pieces if p.doc_id == 9][0]
    assert any(p.doc_id is None for p in pieces)


def test_neighbours_share_terms():
    rng = np.random.default_rng(0)
    pieces = [np.concatenate([rng.integers(1000 * (k % 3), 1000 * (k % 3) + 50, 400), [1]]).astype("<u2") for k in range(30)]
    df = np.bincount(np.concatenate([np.unique(p) for p in pieces]), minlength=3000)
    rows = packing.pack(pieces, np.log1p((30 - df + 0.5) / (df + 0.5)), 401.0)
    first = rows[0]
    assert {k % 3 for k, _, _ in first} == {0} and sum(n for _, _, n in first) == 2048


def test_all_common_characters_encode_as_the_library_does():
    w = packing.words(packing.TOKENIZER)
    rows = [sep.join(map(chr, range(a, a + 40))) for a in range(0, 0x2200, 40) for sep in ("", " ")]
    want = [e.ids for e in w.tokenizer.encode_batch(rows, add_special_tokens=False)]
    assert [np.frombuffer(x, w.kind).tolist() for x in w.encode(rows)] == want
