"""Exact dedup by a stateful stream whose keyed state, on disk, never expires.

A stream over the documents' digests keeps, for each digest, the identifier and the content locator
(file and row) of the document that stays, and the count of its copies. The state lies in RocksDB
stores, keyed and partitioned by digest, without watermark. It is then read back as a table. On hits,
that is digests of several rows, the full normalised texts are fetched by their locators and compared
with the text that stays; a digest shared by different texts is split by the texts themselves.

Everything is DataFrame and Structured Streaming code; no Python runs on executors.

Nulls and odd input: a null text counts as empty; a null doc_id sorts after all others; a repeated row
(same doc_id and text) is reported once for each row, and one row of the group stays, the one that lies first;
an empty table gives an empty result; columns other than doc_id and text are not read by `groups`,
so their names can't clash.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.llm.common import bitmap_of, except_keys, maybe_in, read_table, scratch, spread_join, written

#: White space that texts may differ in.
BLANK = r"[\x20\x09-\x0D]+"
#: Copies of one text that a task compares; larger groups are salted.
COPIES = 2000
#: Input of one micro-batch.
BATCH_BYTES = str(64 << 30)

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",  # stores of a stream that has ended are closed then
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store reserves some MB of disk
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_files(docs: DataFrame) -> DataFrame:
    """docs, whose rows have locators if they come straight from files; others are written first."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"]).schema  # noqa: B018  resolves now
        return docs
    except AnalysisException:
        return written(docs, "docs")


def located(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """columns of docs and its rows' locators `_file` and `_row`. docs: of `in_files`."""
    meta = docs.metadataColumn("_metadata")
    return docs.select(*columns, meta["file_path"].alias("_file"), meta["row_index"].alias("_row"))


def normalised(text="text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANK, "")


def digest_stream(spark: SparkSession, digests: DataFrame) -> DataFrame:
    """The final state: digest, best (the row that stays) and size. digests: a written table."""
    at = scratch(spark, "dedup-state")
    with _settings(spark, _STATE):
        stream = spark.readStream.schema(digests.schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(digests.at)
        state = stream.groupBy("digest").agg(F.min(_order()).alias("best"), F.count(F.lit(1)).alias("size"))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
        kept = spark.read.format("statestore").load(at)
        value = {f.name: f for f in kept.schema["value"].dataType.fields}
        best, size = list(value)[:2]
        return written(kept.select("key.digest", F.col(f"value.`{best}`").alias("best"), F.col(f"value.`{size}`").alias("size")), "dedup-groups")


def _order():
    """The longest text first, then the smallest doc_id, then the first row."""
    return F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "_file", "_row")


def groups(docs: DataFrame, digest_chars: int = 64) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, and the locators `_file`, `_row`.

    digest_chars: hex digits of SHA-256 that form the key; fewer make collisions, for tests.
    """
    spark = docs.sparkSession
    rows = located(in_files(docs), "doc_id", "text")
    sha = F.sha2(normalised(), 256)
    digests = written(
        rows.select("doc_id", "_file", "_row", F.length(F.coalesce("text", F.lit(""))).alias("n"), sha.alias("sha")).withColumn("digest", F.substring("sha", 1, digest_chars)),
        "dedup-digests",
    )
    if digests.isEmpty():
        empty = F.lit(None).cast(f"struct<n:int,no_id:boolean,doc_id:{digests.schema['doc_id'].dataType.simpleString()},_file:string,_row:bigint>")
        return _result(digests.withColumns({"best": empty, "size": F.lit(0).cast("long")}))
    state = digest_stream(spark, digests)
    labelled = written(spread_join(digests, state, "digest", "size"), "dedup-rows")
    bad = written(_differing(rows, labelled), "dedup-collisions")
    out = _result(labelled)
    if bad.isEmpty():
        return out
    split = labelled.join(bad, "digest", "left_semi").drop("best", "size")
    split = split.join(rows.select("_file", "_row", normalised().alias("norm")), ["_file", "_row"])
    best = split.groupBy("norm").agg(F.min(_order()).alias("best"), F.count(F.lit(1)).alias("size"))
    return _result(labelled.join(bad, "digest", "left_anti")).unionByName(_result(split.join(best, "norm")))


def _result(rows: DataFrame) -> DataFrame:
    kept = (F.col("best._file") == F.col("_file")) & (F.col("best._row") == F.col("_row"))
    return rows.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), "_file", "_row")


def _differing(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Digests under which a full text differs from the text that stays. Hot groups are salted."""
    hits = labelled.where("size > 1").select("_file", "_row", "digest", "size", F.col("best._file").alias("keep_file"), F.col("best._row").alias("keep_row"))
    near = maybe_in(rows.select("_file", "_row", "text"), ["_file", "_row"], bitmap_of(hits, ["_file", "_row"])).where("_bm_hit")
    texts = near.join(hits, ["_file", "_row"]).withColumn("norm", normalised())
    is_kept = (F.col("_file") == F.col("keep_file")) & (F.col("_row") == F.col("keep_row"))
    salts = F.ceil(F.col("size") / COPIES).cast("int")
    kept = texts.where(is_kept).select("digest", F.col("norm").alias("kept_norm"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    copies = texts.where(~is_kept).select("digest", "norm", F.pmod(F.xxhash64("_file", "_row"), salts).cast("int").alias("salt"))
    return copies.join(kept, ["digest", "salt"]).where("norm != kept_norm").select("digest").distinct()


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the copies that go; its columns stay as they are."""
    docs = in_files(docs)
    rows = located(docs, F.struct("*").alias("_row_of_docs"))
    gone = groups(docs).where("NOT kept").select("_file", "_row")
    return except_keys(rows, ["_file", "_row"], gone).select("_row_of_docs.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read_table(spark, sf_dir, "documents")).drop("_file", "_row")


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
