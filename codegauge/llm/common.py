"""Shared pieces of the corpus operators: reading, the shared folder, bounded membership filters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; with whole texts of ordinary length a batch is a few MB.
ARROW_ROWS = 1000
#: Bits of a membership bitmap. Its size is fixed (4 MB), whatever the input.
BITMAP_BITS = 1 << 25
_BUCKET = 32768
#: Groups that hold more than this part of all rows are joined by a broadcast; there are fewer than HOT.
HOT = 1024


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only if the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        got = spark.sparkContext.getCheckpointDir()
        if not got:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("/tmp/checkpoints/codegauge")
            got = spark.sparkContext.getCheckpointDir()
        at = got
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/codegauge/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, at `.at`: cuts the lineage and survives lost executors."""
    at = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.at = at
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows with groups (a written table, one row for each key; size: its number of rows) where a group may be hot.

    Groups with more than 1 / HOT of all rows, fewer than HOT, are broadcast, and their rows stay where they are. Their keys
    come to the driver as well, so that the other rows are told by a filter, not by one more join over all of them.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > total // HOT
    keys = [bytes(k) if isinstance(k, bytearray) else k for (k,) in groups.where(hot).select(key).toLocalIterator()]
    if not keys:
        return rows.join(groups, key)
    is_hot = F.col(key).isin(keys)
    of_hot = rows.where(is_hot).join(F.broadcast(groups.where(hot)), key)
    return of_hot.unionByName(rows.where(~is_hot).join(groups.where(~hot), key))


def _slot(keys: list, bits: int):
    return F.pmod(F.xxhash64(*keys), F.lit(bits)) + F.lit(1)


def bitmap_of(df: DataFrame, keys: list[str], bits: int = BITMAP_BITS) -> DataFrame:
    """One hash bit for each key of df: at most bits / 32768 rows of 4 KB."""
    p = df.select(_slot(keys, bits).alias("p"))
    return p.groupBy(F.expr("bitmap_bucket_number(p)").alias("_bm_bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("_bm_bits")
    )


def maybe_in(df: DataFrame, keys: list, bitmap: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """df with `_bm_hit`: false where the key surely isn't in the bitmap. No shuffle: the bitmap's size is fixed."""
    p = df.withColumn("_bm_p", _slot(keys, bits))
    p = p.withColumn("_bm_bucket", F.expr("bitmap_bucket_number(_bm_p)"))
    j = p.join(F.broadcast(bitmap), "_bm_bucket", "left")
    pos = F.expr("bitmap_bit_position(_bm_p)")
    byte = F.conv(F.hex(F.substring("_bm_bits", F.floor(pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_bm_p) % 8 as int))")) != 0
    return j.withColumn("_bm_hit", F.coalesce(hit, F.lit(False))).drop("_bm_p", "_bm_bucket", "_bm_bits")


def except_keys(df: DataFrame, keys: list[str], dropped: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """Rows of df whose keys are not in dropped; rows that surely aren't in it are not shuffled. Null keys are in nothing.

    The rows travel as one struct, so their columns' names can't clash with those used here.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(F.struct("*").alias("_all"), *(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)))
    gone = dropped.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)))
    seen = maybe_in(rows, names, bitmap_of(gone, names, bits), bits)
    sure = seen.where(~F.col("_bm_hit")).select("_all")
    rest = seen.where("_bm_hit").join(gone, names, "left_anti").select("_all")
    return sure.unionByName(rest).select("_all.*")
