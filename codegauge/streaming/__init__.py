"""Incremental facts: new files of a folder are parsed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codegauge.operators import facts as facts_
from codegauge.sources.files import wanted


def follow(spark: SparkSession, folder: str, schema: str = "codebase string, path string, lang string, source string") -> DataFrame:
    """A stream of source rows from Parquet files that arrive in a folder."""
    return wanted(spark.readStream.schema(schema).parquet(folder))


def keep_facts(sources: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Facts of a stream of sources, appended to a folder by the day's batch; each file is written exactly once for each arrival."""
    rows = facts_.extract(sources).withColumn("arrived", F.current_timestamp())
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(facts: DataFrame) -> DataFrame:
    """The facts of each file's last arrival."""
    last = facts.groupBy("codebase", "path").agg(F.max("arrived").alias("arrived"))
    return facts.join(last, ["codebase", "path", "arrived"])
