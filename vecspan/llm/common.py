"""Helpers the text operators share: scratch tables, size-checked joins, running sums without a global sort."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspan.plans.prefix import join_ranks  # noqa: F401  (shared by the packing operators)

#: A table of at most this many rows (of a key and a few numbers) may be broadcast.
BROADCAST_ROWS = 200_000
#: Blocks of 2**15 bits (4 KB) that may be broadcast.
BROADCAST_BLOCKS = 4096


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; where that is unset a temporary one, in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}/vecspan-scratch"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until none is a column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared scratch folder, deleted when the driver's JVM ends."""
    path = f"{scratch_dir(spark)}/vecspan/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialize(df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back.

    Lineage is cut without depending on any executor staying alive.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join a large, possibly skewed table to a table with one row per key (inner, left or left_semi).

    The small side is counted first (both should be materialized tables). Within BROADCAST_ROWS it is broadcast.
    Beyond that only the hot keys' rows of it are, of which there are at most BROADCAST_ROWS as each has more than
    that share of the big side's rows; all other keys are joined by a shuffle of both sides.
    """
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    most = max(10_000, big.count() // BROADCAST_ROWS)
    hot = materialize(big.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key), "hot")
    rest = big.join(F.broadcast(hot), key, "left_anti").join(small, key, how)
    if hot.isEmpty():
        return rest
    near = big.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(small.join(F.broadcast(hot), key, "left_semi")), key, how)
    return rest.unionByName(near)


def keep_rows(big: DataFrame, rows: DataFrame, column: str = "row", blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """big's rows whose number in column (not negative, as of monotonically_increasing_id) is in rows, where it may be repeated; big stays where it is.

    A bit says whether a number is in rows, and 2**15 numbers in a row are a block of bits. Up to `blocks` blocks that have
    a row are broadcast; beyond, both sides are shuffled.
    """
    number = F.col(column).bitwiseAND(32767)
    bits = rows.groupBy(F.shiftright(column, 15).alias("block")).agg(F.bitmap_construct_agg(number).alias("bits"))
    bits = materialize(bits, "bits")
    if bits.count() > blocks:
        return big.join(rows.select(column).distinct(), column, "left_semi")
    (own,) = fresh_names(big, "block")
    byte = F.conv(F.hex(F.substring("bits", F.floor(number / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    held = big.withColumn(own, F.shiftright(column, 15)).join(F.broadcast(bits.withColumnRenamed("block", own)), own)
    return held.where(byte.bitwiseAND(F.pow(F.lit(2), number.bitwiseAND(7)).cast("long")) != 0).select(*big.columns)


def sqrt_buckets(n: int) -> int:
    """As many buckets as their mean size: both the bucket table and each bucket grow with the square root of n."""
    return max(1, math.isqrt(max(0, n - 1)) + 1)


def running_offset(df: DataFrame, group: list[str], bucket: str, order: list[str | Column], weight: Column, out: str) -> DataFrame:
    """Add `out`: the sum of weight over the earlier rows of the group, by bucket and then order.

    Only a bucket's rows are sorted in one task; buckets are joined by the running sum of their totals.
    """
    cells = df.groupBy(*group, bucket).agg(F.sum(weight).alias("_w"))
    across = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    cells = cells.withColumn("_before", F.sum("_w").over(across.orderBy(bucket)) - F.col("_w")).drop("_w")
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = df.join(cells, [*group, bucket])
    return joined.withColumn(out, (F.col("_before") + F.sum(weight).over(within) - weight).cast("long")).drop("_before")


def hash_bucket(hex_column: str, n: int) -> Column:
    """Bucket 0..n-1 by the first 32 bits of a hex digest; buckets follow the digest's order."""
    return F.floor(F.conv(F.substring(hex_column, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * F.lit(n)).cast("int")
