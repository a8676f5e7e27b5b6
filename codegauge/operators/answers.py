"""Calls of services outside: each question is asked once, and its answer kept in a table that later runs read."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCHEMA = "digest string, answer string, asked_at timestamp"


def known(spark: SparkSession, at: str) -> DataFrame:
    """The answers kept so far, one for each digest; none if there is no table yet."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(at)
    except AnalysisException:  # no table yet
        rows = spark.createDataFrame([], SCHEMA)
    return rows.groupBy("digest").agg(F.min_by("answer", F.struct("asked_at", "answer")).alias("answer"))  # a retried task may have asked twice


def answered(
    questions: DataFrame, ask: Callable[[str], str | None], at: str, column: str = "question", tasks: int = 8, concurrent: int = 4, retries: int = 2, wait: float = 0.5, rate: float | None = None
) -> DataFrame:
    """questions with `answer`: by `ask`, or from the table at `at`, where all answers are kept by the SHA-256 of their question.

    Only what the table doesn't hold is asked, each question once however many rows have it; so a run after a failure asks for what is missing. At most tasks *
    concurrent calls are open at a time, and each task begins at most `rate` calls a second. A call that raises is tried `retries` times again, waiting
    twice as long each time. What still raises, and what gives None, has a null answer, isn't kept, and is asked for again by the next run. `ask` should have
    its own timeout. A null question has a null answer.
    """
    spark = questions.sparkSession
    rows = questions.withColumn("_digest", F.sha2(column, 256))
    missing = rows.where(F.col("_digest").isNotNull()).groupBy("_digest").agg(F.first(column).alias("_q")).join(known(spark, at).select(F.col("digest").alias("_digest")), "_digest", "left_anti")

    def once(question: str) -> str | None:
        for k in range(retries + 1):
            try:
                return ask(question)
            except Exception:  # whatever a client raises
                if k < retries:
                    time.sleep(wait * 2**k)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrent) as pool:
            for b in batches:
                pairs = iter(zip(b.column("_digest").to_pylist(), b.column("_q").to_pylist(), strict=True))
                while part := list(islice(pairs, concurrent)):
                    began = time.monotonic()
                    got = list(pool.map(once, [q for _, q in part]))
                    yield pa.record_batch({"digest": pa.array([d for d, _ in part], pa.string()), "answer": pa.array(got, pa.string())})
                    if rate:
                        time.sleep(max(0.0, len(part) / rate - (time.monotonic() - began)))

    new = missing.repartition(tasks, "_digest").mapInArrow(run, "digest string, answer string").where("answer IS NOT NULL").withColumn("asked_at", F.current_timestamp())
    new.write.mode("append").parquet(at)  # committed whole
    found = known(spark, at).withColumnRenamed("digest", "_digest")
    return rows.join(found, "_digest", "left").drop("_digest")
