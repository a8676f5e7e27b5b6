"""Quality gates: thresholds, as literals, beside each row of scores; nothing is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge.plans.score import SCORE
from codegauge.sources.config import DEFAULT_GATES


def _listed(gates: dict[str, dict[str, float]] | None, scope: str) -> Column:
    """An array of key and threshold of a scope of a gate file's content."""
    rows = [F.struct(F.lit(k).alias("key"), F.lit(float(v)).alias("threshold")) for k, v in (gates or DEFAULT_GATES).get(scope, {}).items()]
    return F.array(*rows).cast("array<struct<key:string,threshold:double>>")


def evaluate(scores: DataFrame, totals: DataFrame, gates: dict[str, dict[str, float]] | None = None, normalize_keys: bool = False) -> DataFrame:
    """codebase, scope, key, threshold, actual, passed of each gate that applies.

    scores: codebase, metric, score. totals: codebase and quality_score. gates: a gate file's content, or the default. Gates of metrics without a score are skipped; an overall gate
    without one passes. normalize_keys matches names in lower case with underscores for spaces too.
    """

    def key(c: Column) -> Column:
        return F.lower(F.replace(c, F.lit(" "), F.lit("_"))) if normalize_keys else c

    def judged(rows: DataFrame, actual: Column, passed: Column) -> DataFrame:
        return rows.select("codebase", "scope", "key", "threshold", actual.alias("actual"), passed.alias("passed"))

    of_metric = F.filter(_listed(gates, "metrics"), lambda g: key(g["key"]) == key(F.col("metric")))
    per_metric = scores.select("codebase", "score", F.lit("metrics").alias("scope"), F.inline(of_metric))
    per_metric = judged(per_metric, F.col("score"), F.col("score") >= F.col("threshold"))
    actual = F.when(F.col("key") == SCORE, F.col(SCORE))
    overall = totals.select("codebase", SCORE, F.lit("overall").alias("scope"), F.inline(_listed(gates, "overall")))
    overall = judged(overall, actual, F.coalesce(actual >= F.col("threshold"), F.lit(True)))
    return per_metric.unionByName(overall)


def verdicts(evaluated: DataFrame) -> DataFrame:
    """codebase, passed, n_passed, n_failed; all overall gates count as one."""
    once = evaluated.groupBy("codebase", "scope", F.when(F.col("scope") == "metrics", F.col("key")).alias("one")).agg(F.every("passed").alias("passed"))
    return once.groupBy("codebase").agg(F.every("passed").alias("passed"), F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"))


def lines(evaluated: DataFrame) -> DataFrame:
    """codebase and a line of text for each gate."""
    mark = F.when(F.col("passed"), "PASS").otherwise("FAIL")
    return evaluated.select("codebase", F.format_string("%s %s: %.3f (threshold %.3f)", mark, "key", F.coalesce("actual", F.lit(0.0)), "threshold").alias("line"))


def exit_code(score: float, passed: bool, min_score: float | None = None) -> int:
    """0, or 1 where the score is below min_score, which is looked at first, or a gate fails."""
    return int((min_score is not None and score < min_score) or not passed)
