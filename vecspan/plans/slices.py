"""Ordered computations along time in slices, for groups of any size.

A group's rows are dealt into slices of time and each slice is worked through by itself. What a slice takes over from the
earlier ones (a sum, a maximum, the row before) is put together from one value a slice, so a recording that holds most
of all rows is spread over tasks like many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspan.plans.prefix import running_sums

#: Rows of a slice of the largest group, about.
SLICE_ROWS = 50_000
#: Columns that hold the group as one value, in which nulls are alike, and the number of the slice.
GROUP, SLICE = "_group", "_slice"


def slice_width(df: DataFrame, group: list[str | Column], time: str, rows: int = SLICE_ROWS) -> int | None:
    """The width at which the largest group has about `rows` rows in a slice; None if one slice will do."""
    spans = df.groupBy(F.struct(*group)).agg(F.count(time).alias("n"), (F.max(time) - F.min(time)).alias("span"))
    top = spans.orderBy(F.desc("n")).first()
    return max(1, int(float(top["span"]) * rows / top["n"])) if top and top["n"] > rows else None


def slice_at(time: Column, width: int | None) -> Column:
    return F.floor(time / F.lit(width)) if width else F.lit(0).cast("long")


def sliced(df: DataFrame, group: list[str | Column], time: str, columns: list[str | Column], rows: int = SLICE_ROWS, width: int | None = None) -> DataFrame:
    """GROUP, SLICE and the columns; slices are so wide (if no width is given) that the largest group has about `rows` rows in each.

    Rows without a time are left out.
    """
    df = df.where(F.col(time).isNotNull())
    place = slice_at(F.col(time), width or slice_width(df, group, time, rows))
    return df.select(F.struct(*group).alias(GROUP), *columns, place.alias(SLICE))


def sums(df: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """df with inclusive running sums of each group in the given order."""
    return running_sums(df, SLICE, order, values, [GROUP])


def max_before(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with the largest value of the group's rows before each row; null before the first."""
    cells = df.groupBy(GROUP, SLICE).agg(F.max(value).alias("_most"))
    earlier = Window.partitionBy(GROUP).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(GROUP, SLICE, F.max("_most").over(earlier).alias("_carry"))
    within = Window.partitionBy(GROUP, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(cells, [GROUP, SLICE]).withColumn(out, F.greatest("_carry", F.max(value).over(within))).drop("_carry")


def neighbours(df: DataFrame, order: list[str], values: list[str], before: str = "before", after: str = "after") -> DataFrame:
    """df with structs of the values of the row before and of the row after each row in its group; null at the ends."""
    place, own = F.struct(*order), F.struct(*values)
    cells = df.groupBy(GROUP, SLICE).agg(F.min_by(own, place).alias("_first"), F.max_by(own, place).alias("_last"))
    along = Window.partitionBy(GROUP).orderBy(SLICE)
    cells = cells.select(GROUP, SLICE, F.lag("_last").over(along).alias("_earlier"), F.lead("_first").over(along).alias("_later"))
    within = Window.partitionBy(GROUP, SLICE).orderBy(*order)
    both = df.join(cells, [GROUP, SLICE])
    both = both.withColumns({before: F.coalesce(F.lag(own).over(within), "_earlier"), after: F.coalesce(F.lead(own).over(within), "_later")})
    return both.drop("_earlier", "_later")


def next_of(df: DataFrame, order: list[str], flag: str, values: list[str], out: str) -> DataFrame:
    """df with a struct of the values of the next flagged row after each row in its group; null if none follows."""
    place, own = F.struct(*order), F.struct(*values)
    cells = df.groupBy(GROUP, SLICE).agg(F.min_by(F.when(F.col(flag), own), F.when(F.col(flag), place)).alias("_first"))
    later = Window.partitionBy(GROUP).orderBy(SLICE).rowsBetween(1, Window.unboundedFollowing)
    cells = cells.select(GROUP, SLICE, F.first("_first", ignorenulls=True).over(later).alias("_later"))
    within = Window.partitionBy(GROUP, SLICE).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    both = df.join(cells, [GROUP, SLICE])
    return both.withColumn(out, F.coalesce(F.first(F.when(F.col(flag), own), ignorenulls=True).over(within), "_later")).drop("_later")


def last_of(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with the last value that is not null up to each row in its group; null before the first."""
    cells = df.groupBy(GROUP, SLICE).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    earlier = Window.partitionBy(GROUP).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(GROUP, SLICE, F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    within = Window.partitionBy(GROUP, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(cells, [GROUP, SLICE]).withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(within), "_carry")).drop("_carry")
