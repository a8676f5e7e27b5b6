"""Byte-level BPE by a sentencepiece model that is written from a rank file.

The model is serialised here, field by field, as the library's public message: one piece for each token, its bytes
mapped to printable characters, its score the negative rank, so that the best merge is the lowest rank; identity
normalisation, no dummy prefix, spaces as they are. A text is cut by the pattern, each match is encoded separately by the model,
and ids are decoded from the model's pieces by the inverse mapping. Distinct matches are encoded once for each task while they fit into a cache of bounded size.

Nulls and odd input: a null text is empty (no ids); lone surrogates can't occur in Spark's strings; a null doc_id
is passed on; repeated rows are encoded each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.llm.arrow_text import in_arrow, texts
from codegauge.llm.common import read_table, tune

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Distinct matches that a worker keeps.
CACHE = 200_000
#: Characters of one match that are encoded at once without a cache entry.
LONG = 64


def byte_characters() -> list[str]:
    """A printable character for each byte: visible Latin-1 bytes stand for themselves, the others follow from U+0100."""
    out, n = [], 0
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(0x100 + n))
            n += 1
    return out


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, which must be gapless."""
    rows = [line.split() for line in open(path, "rb") if line.strip()]
    out = [b""] * len(rows)
    for token, rank in rows:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def serialise(tokens: list[bytes]) -> bytes:
    """The model of a vocabulary. Ids are ranks; the piece for unknown characters, which never occurs, comes last."""
    chars = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _message(1, _message(1, piece) + b"\x15" + struct.pack("<f", -float(rank)))
    out += _message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + _number(41, 2**64 - 1) + _number(42, 2**64 - 1) + _number(43, 2**64 - 1)
    normalizer = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(out + _message(2, trainer) + _message(3, normalizer))


class Codec(dict):
    """Ids of matches; missing ones are encoded."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        tokens = read_ranks(path)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.chars = byte_characters()
        self.find = regex.compile(pattern).findall
        self.names = [str(i) for i in range(len(tokens))]
        self.pieces = [self.sp.id_to_piece(i) for i in range(len(tokens))]
        self.back = {ord(c): chr(b) for b, c in enumerate(self.chars)}

    def __missing__(self, match: str) -> tuple[int, ...]:
        ids = tuple(self.sp.encode("".join(map(self.chars.__getitem__, match.encode()))))
        if len(match) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[match] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        """The model's pieces, their characters mapped back to bytes."""
        return "".join(map(self.pieces.__getitem__, ids)).translate(self.back).encode("latin-1")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_ids(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and the ids of each text."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": pa.array([c.encode(t) for t in texts(b)], pa.list_(pa.int32()))})

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and the bytes of each list of ids; a null list is empty."""
    tune(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            yield pa.record_batch({"doc_id": b.column("doc_id"), "bytes": pa.array([c.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())})

    return in_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both directions in one pass over the texts."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for t in texts(b):
                ids = c.encode(t)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": of_ids, "decoded_sha256": of_bytes})

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
