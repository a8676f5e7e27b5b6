"""Lexical retrieval packing: a sharded BM25 inverted index gives each seed document its unused neighbours.

1. Documents are tokenised once, an end id is put after each, and the ids are written to the shared folder.
2. Document frequencies of all ids (a vector as long as the vocabulary) and the mean length come from all documents.
3. Whole windows of long documents are sequences of their own. What is left of each document, less than a window, is dealt
   by a hash of the doc_id to shards of about `SHARD_TOKENS` ids.
4. In a shard an inverted index holds BM25 weights. A seed's window is filled with its best unused neighbours in order of
   score; the last one is cut to fit and its rest is the next seed. Without scoring neighbours the next documents in order
   follow. So all windows of a shard are full but the last, which is cut into sequences of powers of two, without padding.

Tokens don't reach over the pieces of this vocabulary's pre-tokenisation, so texts are cut there and merged by a faster library; the
ids equal those that the vocabulary's own library gives (tested).

Nulls and odd input: a null text is empty and has the end id only; a null doc_id is passed on; repeated rows are packed each;
equal scores go to the smaller (doc_id, start); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.llm.arrow_text import by_group, in_arrow, texts
from codegauge.llm.byte_bpe import byte_characters
from codegauge.llm.common import read_table, tune, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 1
WINDOW = 2048
#: Ids of a shard's documents, about.
SHARD_TOKENS = 1 << 20
#: BM25's parameters.
K1, B = 1.2, 0.75
#: Distinct words of other than plain characters that a worker keeps.
CACHE = 20_000
#: Sequences of whole windows are numbered from here; a shard's from shard * 2^32.
WHOLE = 1 << 62


#: Characters that lower-casing and normalisation treat one by one: ASCII, Latin, common punctuation.
PLAIN = " \n!-~\u00a1-\u012f\u0132-\u0148\u014a-\u017e\u2010-\u2027\u2030-\u205e\u20ac"


class Words:
    """Ids, as bytes, of texts.

    Texts of plain characters are lower-cased and cut by the vocabulary's own pattern; the pieces, a mark behind each, are merged by a
    faster library for byte-level BPE, whose ranks are this vocabulary's ids: there the mark is the byte that ends a piece, and joining it to
    the last byte comes before all other merges. Words with other characters, or with the beginning of a special token, go to the
    vocabulary's own library. A vocabulary of another kind gets whole texts.
    """

    MARK = "\0"  # one byte, no plain character

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex

        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        self.size = len({*spec["model"]["vocab"], *(t["content"] for t in spec["added_tokens"])})
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.plain = re.compile(f"[{PLAIN}]*").fullmatch
        self.cut = None
        suffix, kinds = spec["model"].get("end_of_word_suffix"), [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        # Fixed value: the pattern of this kind of vocabulary, whose classes are spelled out below for plain characters.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if suffix and kinds == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first["pattern"].get("Regex") == pattern and first["behavior"] == "Removed" and first["invert"]:
            plain = [c for c in map(chr, range(0x21, 0x2100)) if re.fullmatch(f"[{PLAIN}]", c)]
            letters, digits = ("".join(re.escape(c) for c in plain if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}"))
            self.cut = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{digits}]|[^ \n{letters}{digits}]+").findall
            self.merges = self._merges(spec["model"]["vocab"], suffix, {t["content"] for t in spec["added_tokens"]})
        self.odd = lru_cache(maxsize=CACHE)(lambda w: self._bytes(self.batch([w], add_special_tokens=False)[0].ids))

    @cached_property
    def tokenizer(self):
        """The vocabulary's own library, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def batch(self, rows: list[str], **options):
        return getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)(rows, **options)

    def _merges(self, vocabulary: dict[str, int], suffix: str, special: set[str]):
        import tiktoken

        byte = {c: b for b, c in enumerate(byte_characters())}
        ranks = {}
        for token, i in vocabulary.items():
            if token not in special:
                body = token.removesuffix(suffix)
                ranks[bytes(map(byte.__getitem__, body)) + self.MARK.encode() * (body != token)] = i
        return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def _bytes(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def is_plain(self, text: str) -> bool:
        return self.plain(text) is not None and "<|" not in text

    def _plain(self, text: str) -> bytes:
        pieces = self.cut(text.lower())
        return self._bytes(self.merges.encode_ordinary(self.MARK.join(pieces) + self.MARK)) if pieces else b""

    def encode_one(self, text: str) -> bytes:
        if self.is_plain(text):
            return self._plain(text)
        out, run = [], []
        for w in text.replace("\n", " ").split(" "):
            if self.is_plain(w):
                run.append(w)
            else:
                out += [self._plain(" ".join(run)), self.odd(w)]
                run = []
        return b"".join([*out, self._plain(" ".join(run))])

    def encode(self, rows: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not self.cut:
            return [self._bytes(e.ids) for e in self.batch(rows, add_special_tokens=False)]
        return [self.encode_one(t) for t in rows]


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def tokenised(docs: DataFrame, path: str = TOKENIZER, end: int = END) -> DataFrame:
    """doc_id, ids (little-endian, the end id last) and n of each row."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(path)
        tail = np.array([end], w.kind).tobytes()
        for b in batches:
            ids = [x + tail for x in w.encode(texts(b))]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": pa.array(ids, pa.binary()), "n": pa.array([len(x) // w.kind.itemsize for x in ids], pa.int64())})

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary, n long")


def frequencies(tokens: DataFrame, size: int, kind: str) -> np.ndarray:
    """The number of documents that hold each id: one number for each id of the vocabulary, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("ids").to_pylist():
                seen = np.zeros(size, bool)
                seen[np.frombuffer(x, kind)] = True
                df += seen
        at = np.flatnonzero(df)
        yield pa.record_batch({"id": pa.array(at, pa.int64()), "df": pa.array(df[at], pa.int64())})

    out = np.zeros(size, np.int64)
    for r in in_arrow(tokens.select("ids"), run, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        out[r.id] = r.df
    return out


class Index:
    """BM25 over a shard's pieces."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float):
        size = len(idf)
        length = np.array([len(p) for p in pieces], np.float64)
        key = np.concatenate(pieces).astype(np.int64) + np.repeat(np.arange(len(pieces)), [len(p) for p in pieces]) * size
        key, tf = np.unique(key, return_counts=True)
        piece, term = key // size, key % size
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[piece] / mean))
        self.count = len(pieces)
        self.terms, self.row = term, np.searchsorted(piece, np.arange(len(pieces) + 1))
        by = np.argsort(term, kind="stable")
        self.piece, self.weight = piece[by], weight[by]
        self.at = np.searchsorted(term[by], np.arange(size + 1))

    def scores(self, i: int) -> np.ndarray:
        """Of all pieces for the terms of piece i."""
        t = self.terms[self.row[i] : self.row[i + 1]]
        begin, n = self.at[t], self.at[t + 1] - self.at[t]
        where = np.arange(n.sum()) + np.repeat(begin - np.append(0, np.cumsum(n)[:-1]), n)
        return np.bincount(self.piece[where], self.weight[where], self.count)


def _best(scores: np.ndarray, free: np.ndarray) -> Iterator[int]:
    """Free pieces by score, ties to the earlier; those without a common term follow in order."""
    at = np.flatnonzero(free)
    s = scores[at]
    if len(at) > 64:  # mostly a few fill the window
        few = np.flatnonzero(s >= np.partition(s, len(s) - 32)[len(s) - 32])
        yield from at[few[np.argsort(-s[few], kind="stable")]]
        done = np.zeros(len(at), bool)
        done[few] = True
        at, s = at[~done], s[~done]
    yield from at[np.argsort(-s, kind="stable")]


def pack(pieces: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, start in it, length); all are full but the last ones, whose lengths are powers of two."""
    index = Index(pieces, idf, mean)
    free = np.ones(len(pieces), bool)
    out, seed, at, nxt = [], -1, 0, 0
    while True:
        if seed < 0:
            while nxt < len(pieces) and not free[nxt]:
                nxt += 1
            if nxt == len(pieces):
                break
            seed, at = nxt, 0
            free[seed] = False
        row, space = [(seed, at, len(pieces[seed]) - at)], window - (len(pieces[seed]) - at)
        seed_of, seed = seed, -1
        if space and free.any():
            for k in _best(index.scores(seed_of), free):
                n = min(space, len(pieces[k]))
                free[k] = False
                row.append((int(k), 0, n))
                space -= n
                if n < len(pieces[k]):
                    seed, at = int(k), n
                if not space:
                    break
        if space:
            out += _powers(row, window - space)
        else:
            out.append(row)
    return out


def _powers(row: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The pieces of a row cut into sequences of powers of two, the longest first."""
    out, row = [], list(row)
    while total:
        left = size = 1 << (total.bit_length() - 1)
        part = []
        while left:
            k, at, n = row.pop(0)
            if n > left:
                row.insert(0, (k, at + left, n - left))
                n = left
            part.append((k, at, n))
            left -= n
        out.append(part)
        total -= size
    return out


_COLUMNS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, path: str = TOKENIZER, end: int = END, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    w = words(path)
    size, kind = w.size, w.kind.str
    tokens = written(tokenised(docs, path, end), "pack-tokens")
    n, total = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rest_total = tokens.agg(F.coalesce(F.sum(F.col("n") % window), F.lit(0))).first()[0]
    shards = max(1, -(-rest_total // shard_tokens))
    df = frequencies(tokens, size, kind)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    mean = total / max(1, n)
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, start, out, full = [], [], [], []
            for d, x, m in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "n")), strict=True):
                ids = np.frombuffer(x, kind)
                for k in range(0, m - m % window, window):
                    doc.append(d)
                    start.append(k)
                    out.append(ids[k : k + window].astype("<u4").tobytes())
                    full.append(m)
            yield pa.record_batch({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "ids": pa.array(out, pa.binary()), "doc_tokens": pa.array(full, pa.int64())})

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("n", "ascending"), ("ids", "ascending")])
        doc, n = table.column("doc_id").to_pylist(), table.column("n").to_pylist()
        pieces = [np.frombuffer(x, kind) for x in table.column("ids").to_pylist()]
        base = table.column("shard")[0].as_py() << 32
        rows = []
        for s, row in enumerate(pack(pieces, shared.value, mean, window)):
            offset = 0
            for k, at, m in row:
                rows.append((doc[k], n[k] - len(pieces[k]) + at, m, pieces[k][at : at + m].astype("<u4").tobytes(), n[k], base + s, offset))
                offset += m
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in _COLUMNS.split(", ")]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})

    wide = w.kind.itemsize
    full = in_arrow(tokens.where(F.col("n") >= window), whole, "doc_id long, start long, ids binary, doc_tokens long")
    full = full.select("doc_id", "start", F.lit(window).cast("long").alias("length"), "ids", "doc_tokens", (F.monotonically_increasing_id() + F.lit(WHOLE)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = tokens.where(F.col("n") % window > 0).select("doc_id", "n", F.expr(f"substring(ids, cast((n - n % {window}) * {wide} + 1 as int))").alias("ids"), F.pmod(F.xxhash64("doc_id", "ids", F.monotonically_increasing_id()), F.lit(shards)).alias("shard"))
    return full.unionByName(by_group(rest, ["shard"], shard, _COLUMNS))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(packed(read_table(spark, sf_dir, "documents")))
