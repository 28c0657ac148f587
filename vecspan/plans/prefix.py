"""Running sums over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_bucket(df: DataFrame, key: str, buckets: int, out: str = "bucket") -> DataFrame:
    """Number ranges of key, in its order, by its approximate quantiles (at most `buckets` of them)."""
    probes = [k / buckets for k in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(key, probes, 0.5 / buckets))) if probes else []
    if not cuts:
        return df.withColumn(out, F.lit(0))
    return df.withColumn(out, sum(((F.col(key) > float(c)).cast("int") for c in cuts), F.lit(0)))


def running_sums(df: DataFrame, bucket: str, order: list[Column | str], sums: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """Add inclusive running sums in the order of bucket, then order: one window per bucket and one over bucket totals."""
    group = group or []
    cells = df.groupBy(*group, bucket).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    across = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = across.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*group, bucket, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.join(cells, [*group, bucket])
    return out.withColumns({n: F.col(f"_{n}") + F.sum(c).over(within) for n, c in sums.items()}).drop(*[f"_{n}" for n in sums])


def join_ranks(rows: DataFrame, ranges: DataFrame, group: str, cell: int = 50_000) -> DataFrame:
    """rows (group, rank, ...) with the columns of the range (group, lo, hi, ...) of the group that has lo <= rank < hi.

    Ranges of a group don't overlap; rows outside all of them are left out. Both sides are dealt by group and cells of
    ranks, sorted there, and each range is carried forward over its rows, so a task holds the rows and ranges of one
    cell and no side is broadcast.
    """
    there = [c for c in ranges.columns if c != group]
    width = F.lit(cell).cast("long")
    cells = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))
    ends = ranges.where("lo < hi").select(group, F.struct(*there).alias("range"), cells.alias("cell"))
    ends = ends.select(group, "cell", F.greatest("range.lo", F.col("cell") * width).alias("at"), F.lit(0).alias("kind"), "range", F.lit(None).cast(rows.select(F.struct("*").alias("x")).schema["x"].dataType).alias("row"))
    own = rows.select(group, F.floor(F.col("rank") / width).alias("cell"), F.col("rank").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(ends.schema["range"].dataType).alias("range"), F.struct("*").alias("row"))
    last = Window.partitionBy(group, "cell").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ends.unionByName(own).withColumn("range", F.last("range", ignorenulls=True).over(last)).where("kind = 1 and at < range.hi")
    return found.select("row.*", *[F.col(f"range.{c}").alias(c) for c in there])
