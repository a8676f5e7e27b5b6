"""Hierarchical language identification: the family first, then pairs of languages within it.

Features are the shares of hashed 2- and 3-byte grams of the lower-cased text, all but letters being spaces. Linear
support vector machines, one against the rest, choose the family; within it one-versus-one machines vote. They learn
from a bounded sample of labelled rows (`MAX_ROWS` in all, the same number of each language at most, dealt by a hash of
the doc_id). Prediction reads whole texts.

Nulls and odd input: a text that is null or has no letter is `und` with score 0; rows without label, text or doc_id are
not learned from; a null doc_id counts as not held out; without any label all is `und`; repeated rows get the same
prediction each; an empty table gives an empty result; other columns are not read, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegauge.llm import svm
from codegauge.llm.arrow_text import in_arrow, texts
from codegauge.llm.common import except_keys, read_table, tune
from codegauge.llm.exact_dedup import in_files, located
from codegauge.llm.vector_text import chunks, join

#: Labelled rows that the machines learn from, and the most of one language.
MAX_ROWS, MAX_EACH = 2000, 400
#: Cells of the hashed features.
CELLS = 8192
#: Features are shares of a text's grams times this.
SCALE = 50.0
UNKNOWN = "und"
#: Below this score the pipeline's stage rejects a document.
LEAST = 0.4
# Families of languages by ISO 639-1 code. Other codes form a family of their own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_LETTER = np.arange(256) >= 0x80
_LETTER[[*range(0x61, 0x7B)]] = True


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def _grams(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the 2- and 3-byte grams that start at each byte, and the texts' starts."""
    buf, starts = join([r.lower() for r in rows])
    b = np.where(_LETTER[buf], buf, 32).astype(np.uint32)
    b1, b2 = np.full_like(b, 32), np.full_like(b, 32)
    b1[:-1], b2[:-2] = b[1:], b[2:]
    ends = starts[1:] - 1  # the space behind each text; what follows it isn't the text's
    b1[ends] = b2[ends] = b2[ends[ends > 0] - 1] = 32
    two = ((b << np.uint32(8) | b1) * np.uint32(2654435761)) >> np.uint32(20)
    three = ((b << np.uint32(16) | b1 << np.uint32(8) | b2) * np.uint32(2246822519)) >> np.uint32(20)
    return two.astype(np.int64), three.astype(np.int64) + CELLS // 2, starts


def features(rows: list[bytes]) -> np.ndarray:
    """A row of shares for each text, and a last column of ones for the bias."""
    out = np.ones((len(rows), CELLS + 1), np.float32)
    for i, row in enumerate(rows):
        two, three, starts = _grams([row])
        n = max(1, starts[1])
        out[i, :-1] = (np.bincount(two, minlength=CELLS) + np.bincount(three, minlength=CELLS)) * (SCALE / n)
    return out


@dataclass
class Model:
    """weights: a row for each machine, its bias last. families: the machines of families; pairs: (a, b, row), a being the positive one."""

    langs: list[str]
    families: list[str]
    family_rows: list[int] = field(default_factory=list)
    pairs: list[tuple[str, str, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, CELLS + 1), np.float32))

    def margins(self, rows: list[bytes]) -> np.ndarray:
        """Of each machine (columns) for each text; texts of any length, in pieces of bounded memory."""
        out = np.zeros((len(rows), len(self.weights)))
        if not len(self.weights):
            return out
        for i, j in chunks([len(r) for r in rows]):
            two, three, starts = _grams(rows[i:j])
            for k, w in enumerate(self.weights):
                out[i:j, k] = np.add.reduceat(w[two] + w[three], starts[:-1])
            out[i:j] *= (SCALE / np.maximum(1, np.diff(starts)))[:, None]
        return out + self.weights[:, -1]

    def predict(self, rows: list[bytes]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(rows)
        m = self.margins(rows)
        sure = 1 / (1 + np.exp(np.clip(-4 * m, -50, 50)))
        if len(self.families) == 1:
            best, p = np.zeros(len(rows), int), np.ones(len(rows))
        elif len(self.families) == 2:  # one machine tells the two apart
            best, p = (m[:, 0] <= 0).astype(int), np.maximum(sure[:, 0], 1 - sure[:, 0])
        else:
            best = m[:, self.family_rows].argmax(1)
            p = sure[:, self.family_rows].max(1)
        inner = {f: ([x for x in self.langs if family(x) == f], [x for x in self.pairs if family(x[0]) == f]) for f in self.families}
        out = []
        for r in range(len(rows)):
            langs, pairs = inner[self.families[best[r]]]
            votes, score = dict.fromkeys(langs, 0.0), dict.fromkeys(langs, 1.0)
            for a, b, k in pairs:
                q = sure[r, k]
                votes[a if m[r, k] > 0 else b] += 1
                score[a], score[b] = min(score[a], q), min(score[b], 1 - q)
            lang = max(langs, key=lambda x: (votes[x], score[x], x))
            out.append((lang, float(p[r] * score[lang])))
        return out


def train(rows: list[tuple[str, str]]) -> Model:
    """A model of (text, language) rows."""
    langs = sorted({lang for _, lang in rows})
    families = sorted({family(x) for x in langs})
    model = Model(langs, families)
    if len(langs) < 2:
        return model
    x = features([t.encode() for t, _ in rows])
    y = np.array([lang for _, lang in rows])
    fam = np.array([family(lang) for lang in y])
    weights = []
    for f in families[: 1 if len(families) == 2 else None] if len(families) > 1 else []:
        model.family_rows.append(len(weights))
        weights.append(svm.fit(x, np.where(fam == f, 1.0, -1.0)))
    for i, a in enumerate(langs):
        for b in langs[i + 1 :]:
            if family(a) == family(b):
                model.pairs.append((a, b, len(weights)))
                weights.append(svm.fit(x, (y == a) * 1.0 - (y == b) * 1.0))
    model.weights = np.array(weights, np.float32)
    return model


def sample(docs: DataFrame, learn) -> list[tuple[str, str]]:
    """At most MAX_EACH labelled texts of a language and MAX_ROWS in all, by a hash of the doc_id; 2 MAX_ROWS where doc_ids repeat. Always the same rows."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    n = rows.select("lang").distinct().limit(MAX_ROWS).count()
    each = max(1, min(MAX_EACH, MAX_ROWS // max(1, n)))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    top = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= each).orderBy("_r", "lang", "doc_id").select("doc_id", "lang").limit(MAX_ROWS)
    ids = sorted({r.doc_id for r in top.collect()})
    got = docs.where(F.col("doc_id").isin(ids) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text").limit(2 * MAX_ROWS)
    return [(r.text, r.lang) for r in sorted(got.collect())]


def fit(docs: DataFrame) -> Model:
    """A model of the rows of docs that aren't held out."""
    return train(sample(docs, ~held_out()))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, model: Model, *keys: str) -> DataFrame:
    """keys (doc_id by default), lang_pred, score of each row."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)
    keys = keys or ("doc_id",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}").search
        for b in batches:
            rows = texts(b)
            got = shared.value.predict([t.encode() for t in rows])
            got = [g if letter(t) else (UNKNOWN, 0.0) for t, g in zip(rows, got, strict=True)]
            yield pa.record_batch({k: b.column(k) for k in keys} | {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())})

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return in_arrow(docs.select(*keys, "text"), run, f"{kinds}, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without those whose language isn't recognised: `und`, or a score below `least`. Its columns stay as they are."""
    docs = in_files(docs)
    found = identify(located(docs, "text"), fit(docs), "_file", "_row")
    gone = found.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)).select("_file", "_row")
    rows = located(docs, F.struct("*").alias("_row_of_docs"))
    return except_keys(rows, ["_file", "_row"], gone).select("_row_of_docs.*")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
