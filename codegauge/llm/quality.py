"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees on statistics give paths, each a conjunction of threshold conditions. A logistic model with a lasso
penalty weighs these rules, most get weight 0, and the rest are compiled into one Spark column expression over the statistics.
Statistics come from whole texts. Rules are learned from a bounded sample of labelled rows (`MAX_LABELLED`, by a hash of doc_id).

Nulls and odd input: a null text counts as empty and has a score like any other; rows with null labels are not learned from;
a null doc_id is never held out and never learned from; without labels the score is 0.5, with labels of one kind it is that
kind's share; repeated rows are scored each, repeated labels of a document count each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.llm import vector_text as vt
from codegauge.llm.arrow_text import in_arrow, texts
from codegauge.llm.common import read_table, tune

#: Labelled rows that are learned from, at most.
MAX_LABELLED = 8000
TREES, DEPTH, CUTS, SHRINK = 40, 3, 32, 0.3
#: Weight of the lasso penalty.
LASSO = 0.0005
THRESHOLD = 0.3

STATISTICS = (
    "log_bytes log_words mean_word log_longest_word upper letter digit space common_mark other_mark exclamation non_ascii "
    "distinct_words top_word distinct_pairs lines distinct_lines log_mean_line short_words long_words"
).split()

_CLASS = np.zeros(256, np.int64)
_CLASS[[*range(0x41, 0x5B)]] = 1
_CLASS[[*range(0x61, 0x7B)]] = 2
_CLASS[[*range(0x30, 0x3A)]] = 3
_CLASS[[0x20, *range(0x09, 0x0E)]] = 4
_CLASS[[*map(ord, ".,;:'\"-?()")]] = 5
_CLASS[ord("!")] = 6
_CLASS[0x80:] = 7


def statistics(rows: list[bytes]) -> np.ndarray:
    """A row of statistics for each text."""
    out = np.zeros((len(rows), len(STATISTICS)))
    for i, j in vt.chunks([len(r) for r in rows]):
        some = rows[i:j]
        buf, starts = vt.join(some)
        sizes = np.diff(starts) - 1
        kinds = np.bincount(_CLASS[buf] + 8 * np.repeat(np.arange(len(some)), sizes + 1), minlength=8 * len(some)).reshape(-1, 8).astype(float)
        kinds[:, 4] -= 1  # the space that parts the texts
        n = np.maximum(1, sizes)
        hashes, length, first = vt.words(buf, starts)
        pairs = vt.shingles(hashes, 2)
        for r, (text, a, b) in enumerate(zip(some, first[:-1], first[1:], strict=True)):
            k = max(1, b - a)
            size = length[a:b]
            _, times = np.unique(hashes[a:b], return_counts=True)
            lines = text.split(b"\n")
            upper, letters = kinds[r, 1], kinds[r, 1] + kinds[r, 2] + kinds[r, 7]
            out[i + r] = (
                np.log1p(sizes[r]), np.log1p(b - a), size.sum() / k, np.log1p(size.max(initial=0)), upper / max(1, letters), letters / n[r], kinds[r, 3] / n[r], kinds[r, 4] / n[r],
                kinds[r, 5] / n[r], kinds[r, 0] / n[r], kinds[r, 6] / n[r], kinds[r, 7] / n[r],
                len(times) / k, times.max(initial=0) / k, len(np.unique(pairs[a : max(a, b - 1)])) / max(1, k - 1), len(lines), len(set(lines)) / len(lines), np.log1p(sizes[r] / len(lines)),
                (size <= 2).sum() / k, (size >= 15).sum() / k,
            )
    return out


def with_statistics(docs: DataFrame, *keys: str) -> DataFrame:
    """keys (doc_id by default; numbers) and the statistics of each row."""
    tune(docs.sparkSession)
    keys = keys or ("doc_id",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics([t.encode() for t in texts(b)])
            yield pa.record_batch({k: b.column(k) for k in keys} | {c: pa.array(np.ascontiguousarray(x[:, n])) for n, c in enumerate(STATISTICS)})

    schema = ", ".join([f"{k} long" for k in keys] + [f"{c} double" for c in STATISTICS])
    return in_arrow(docs.select(*(F.col(k).cast("long") for k in keys), "text"), run, schema)


#: A rule: conditions (number of the statistic, whether above, threshold) that all hold.
Rule = tuple[tuple[int, bool, float], ...]


def tree_paths(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths to all nodes of boosted trees. x: statistics, y: 0 or 1."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])  # v > c[k] if its bin is above k
    rng = np.random.default_rng(1)
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}

    def grow(rows: np.ndarray, every: np.ndarray, path: Rule, depth: int) -> None:
        # splits are chosen on the sampled rows; every row takes its leaf's step
        g, h = grad[rows], hess[rows]
        if path:
            rules[tuple(sorted(path))] = None
        best = (1e-3, -1, -1)
        if depth < DEPTH and len(rows) >= 20:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f, c in enumerate(cuts):
                b = binned[f, rows]
                gs, hs = np.cumsum(np.bincount(b, g, len(c) + 1)), np.cumsum(np.bincount(b, h, len(c) + 1))
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - whole
                gain[(hs[:-1] < 1) | (hs[-1] - hs[:-1] < 1)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        _, f, k = best
        if f < 0:
            step[every] = SHRINK * g.sum() / (h.sum() + 1)
            return
        for above in (True, False):
            mine, all_mine = ((binned[f, r] > k) == above for r in (rows, every))
            grow(rows[mine], every[all_mine], (*path, (f, above, float(cuts[f][k]))), depth + 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        step = np.zeros(len(y))
        some = np.flatnonzero(rng.random(len(y)) < 0.5)
        grow(some, np.arange(len(y)), (), 0)
        margin = margin + step
    return list(rules)


def lasso(x: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = 300) -> np.ndarray:
    """Logistic weights and, last, the bias, by accelerated proximal steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = np.float32(4 * len(x) / float(v @ (x.T @ (x @ v))) / 1.05)
    w = z = np.zeros(x.shape[1], np.float32)
    t = 1.0
    for _ in range(steps):
        new = z - rate * (x.T @ (1 / (1 + np.exp(-(x @ z))) - y.astype(np.float32)) / np.float32(len(x)))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * np.float32(penalty), 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + np.float32((t - 1) / t2) * (new - w)
        w, t = new, t2
    return w


class Ensemble:
    """Weighted rules and a bias."""

    def __init__(self, rules: list[Rule], weights: list[float], bias: float):
        self.rules, self.weights, self.bias = rules, weights, bias

    def column(self) -> Column:
        """The score as an expression over the columns of STATISTICS."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            cond = F.lit(True)
            for f, above, cut in rule:
                c = F.col(STATISTICS[f])
                cond = cond & ((c > cut) if above else (c <= cut))
            total = total + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + holds(self.rules, x) @ np.array(self.weights)))) if self.rules else np.full(len(x), 1 / (1 + np.exp(-self.bias)))


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """1 where a rule (column) holds for a row."""
    out = np.ones((len(x), len(rules)), np.float32)
    for k, rule in enumerate(rules):
        for f, above, cut in rule:
            out[:, k] *= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


def learn(x: np.ndarray, y: np.ndarray) -> Ensemble:
    if not len(y):
        return Ensemble([], [], 0.0)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    if y.min() == y.max():
        return Ensemble([], [], float(np.log(share / (1 - share))))
    rules = tree_paths(x, y)
    w = lasso(holds(rules, x), y)
    some = np.flatnonzero(np.abs(w[:-1]) > 1e-6)
    return Ensemble([rules[i] for i in some], [float(w[i]) for i in some], float(w[-1]))


def held_out() -> Column:
    """Rows that are never learned from; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ensemble:
    """Rules for `label` (0 or 1) from MAX_LABELLED labelled rows at most that aren't held out, by a hash of the doc_id; twice as many where doc_ids repeat."""
    some = labels.where(~held_out() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("long").alias("_label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(MAX_LABELLED)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # MAX_LABELLED rows at most
    got = with_statistics(rows, "doc_id", "_label").orderBy("doc_id", "_label", *STATISTICS).limit(2 * MAX_LABELLED).toArrow()
    x = np.stack([got.column(c).to_numpy() for c in STATISTICS], 1) if got.num_rows else np.zeros((0, len(STATISTICS)))
    return learn(x, got.column("_label").to_numpy().astype(float))


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """doc_id and score of each row."""
    return with_statistics(docs).select("doc_id", model.column().alias("score"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
