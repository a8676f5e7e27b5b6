"""Facts kept by the content of files: a run parses what no run before it has parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from codegauge.operators import facts as facts_

#: What is replaced by a file's own path: facts that name their file.
_OWN = "\x00"
KEPT = f"digest string, {facts_.SCHEMA}"


def _kept(spark: SparkSession, at: str) -> DataFrame:
    try:
        return spark.read.schema(KEPT).parquet(at)
    except AnalysisException:  # the first run
        return spark.createDataFrame([], KEPT)


def digest() -> Column:
    """What a file's facts depend on: language, content, and of the path the name and whether it is of tests, which decide on smells of tests."""
    test = F.col("path").contains("/src/test/")
    return F.sha2(F.concat_ws("\x00", "lang", F.substring_index("path", "/", -1), test.cast("string"), F.coalesce("source", F.lit(""))), 256)


def refreshed(sources: DataFrame, at: str) -> tuple[DataFrame, int]:
    """The facts of all files of a source table, and how many distinct contents were parsed for them.

    Facts are kept in the table at `at` by the digest of the content; only contents that it doesn't hold are parsed, and each once, however many files have
    them. A file that has moved or was renamed within its kind keeps its facts; files that are gone have none, as the result is joined from the
    files at hand; their facts stay in the table until `swept`. A run that fails has added nothing, as the new facts are written by one commit.
    """
    spark = sources.sparkSession
    rows = sources.withColumn("digest", digest())
    done = _kept(spark, at).select("digest").distinct()
    new = rows.join(done, "digest", "left_anti")
    one = new.groupBy("digest").agg(F.min_by(F.struct("path", "lang", "source"), "path").alias("f")).select(F.col("digest").alias("codebase"), "f.path", "f.lang", "f.source")
    parsed = Observation()
    found = facts_.extract(one.observe(parsed, F.count(F.lit(1)).alias("n"))).withColumnRenamed("codebase", "digest")
    own = F.when(F.col("name") == F.col("path"), _OWN).otherwise(F.col("name"))
    kinds = [c.split()[0] for c in KEPT.split(", ")]
    found.withColumn("name", own).withColumns({"codebase": F.lit(None).cast("string"), "path": F.lit(None).cast("string")}).select(*kinds).write.mode("append").parquet(at)
    kept = _kept(spark, at)
    out = rows.select("codebase", "path", "digest").join(kept.drop("codebase", "path"), "digest")
    name = F.when(F.col("name") == _OWN, F.col("path")).otherwise(F.col("name"))
    return out.withColumn("name", name).select(*(c.split()[0] for c in facts_.SCHEMA.split(", "))), parsed.get["n"]


def swept(sources: DataFrame, at: str, to: str) -> None:
    """Writes to `to` what of the table at `at` the files of a source table still need."""
    needed = sources.select(digest().alias("digest")).distinct()
    _kept(sources.sparkSession, at).join(needed, "digest", "left_semi").write.parquet(to)
