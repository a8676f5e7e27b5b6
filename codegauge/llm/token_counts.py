"""Token counts: texts are encoded in Arrow batches and only the lengths come back.

The batches that go to the library are balanced by bytes, not by rows, and a long text is split before a
space that follows another character. The split is safe if no piece of the vocabulary has a word mark after
another character (then no merge crosses that place) and if the model puts one mark before each input, which
stands for the dropped space; both are read from the model, and without them texts are not split.

Nulls and odd input: a null text counts as empty (0 tokens); a null doc_id is passed on; repeated rows are
counted each; an empty table gives an empty result; other columns are not read, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.llm.arrow_text import CHUNK_BYTES, balanced, byte_lengths, in_arrow, texts
from codegauge.llm.common import read_table, tune

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIMIT = 4096
MARK = "▁"


@lru_cache(maxsize=2)
def load(path: str):
    """The model, and whether texts may be split before a space."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    inner = any(MARK in p.lstrip(MARK) for p in pieces)
    as_is = sp.encode("a  b", out_type=str)[0].startswith(MARK) and "".join(sp.encode("a  b", out_type=str)) == f"{MARK}a{MARK * 2}b"
    return sp, as_is and not inner


def split(text: str, most: int = CHUNK_BYTES) -> list[str]:
    """Parts of a text of about `most` bytes of UTF-8. Each cut drops one space that follows another character."""
    data = text.encode()
    parts, at = [], 0
    while len(data) - at > most:
        cut = data.find(b" ", at + most)
        while cut > 0 and data[max(0, cut - 3) : cut].endswith((b" ", MARK.encode())):
            cut = data.find(b" ", cut + 1)
        if cut < 0 or cut + 1 >= len(data):
            break
        parts.append(data[at:cut].decode())
        at = cut + 1
    parts.append(data[at:].decode())
    return parts


def counts(path: str, rows: list[str], most: int = CHUNK_BYTES) -> list[int]:
    """Numbers of tokens of the texts."""
    sp, safe = load(path)
    owner, parts = [], []
    for i, text in enumerate(rows):
        for part in split(text, most) if safe and 4 * len(text) > most else [text]:
            owner.append(i)
            parts.append(part)
    out = [0] * len(rows)
    for i, j in balanced([len(p.encode()) for p in parts], most):
        for k, ids in zip(owner[i:j], sp.encode(parts[i:j], num_threads=1), strict=True):
            out[k] += len(ids)
    return out


def count_tokens(docs: DataFrame, path: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_bytes": pa.array(byte_lengths(b), pa.int64()), "n_tokens": pa.array(counts(path, texts(b)), pa.int64())})

    out = in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
