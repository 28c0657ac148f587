"""Keyed tables and data directories: filters, joins, set operations, subsets, integrity repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspan.functions.vectors import hashed_unit


def keep_keys(df: DataFrame, keys: DataFrame, on: str | list[str], exclude: bool = False) -> DataFrame:
    """rows whose key is (or, with exclude, is not) in the list."""
    on = [on] if isinstance(on, str) else on
    return df.join(keys.select(*on).distinct(), on, "left_anti" if exclude else "left_semi")


def longer_than(df: DataFrame, durations: DataFrame, key: str, limit: float = 5.0) -> DataFrame:
    """rows with a duration strictly over the limit; rows without a duration are dropped."""
    return df.join(durations.where(F.col("dur") > limit).select(key).distinct(), key, "left_semi")


def at_least(df: DataFrame, group: str, n: int) -> DataFrame:
    """rows of groups with at least n rows."""
    big = df.groupBy(group).count().where(F.col("count") >= n).select(group)
    return df.join(big, group, "left_semi")


def bands(df: DataFrame, group: str, value: str = "dur", low: float = 2.0, mid: float = 6.0) -> DataFrame:
    """band short (low < value < mid) or long (value > mid), of groups that have both."""
    banded = df.withColumn("band", F.when((F.col(value) > low) & (F.col(value) < mid), "short").when(F.col(value) > mid, "long")).where("band is not null")
    both = banded.groupBy(group).agg(F.countDistinct("band").alias("n")).where("n = 2").select(group)
    return banded.join(both, group, "left_semi")


def encode(df: DataFrame, column: str, out: str = "label") -> DataFrame:
    """Index, from 0, of the value among the sorted distinct values; null is -1. The value table is joined back."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    ids = values.withColumn(out, (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))
    return df.join(ids, column, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def last_wins(df: DataFrame, key: str, position: str) -> DataFrame:
    """Of rows with one key the one of the highest position."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(position, *[c for c in others if c != position])).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def first_of_key(df: DataFrame, key: str) -> DataFrame:
    """U4: of rows with one key the least."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*others)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def by_speaker(df: DataFrame, spk: str = "spk", utt: str = "utt", position: str | None = None) -> DataFrame:
    """Utterances of each speaker, in the order of position (by default the utterance id)."""
    entry = F.struct(F.col(position or utt).alias("p"), F.col(utt).alias("u"))
    return df.groupBy(spk).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["u"]).alias("utts"))


def by_utterance(df: DataFrame, spk: str = "spk", utts: str = "utts") -> DataFrame:
    """A2: a row per utterance."""
    return df.select(F.explode(utts).alias("utt"), spk)


def stride_subset(df: DataFrame, n: int, spk: str = "spk", utts: str = "utts") -> DataFrame:
    """N utterances of each speaker list, every s-th with the largest s for which n * s fits."""
    step = F.greatest(F.lit(1), F.floor(F.size(utts) / n)).cast("int")
    ex = df.select(spk, step.alias("s"), F.posexplode(utts).alias("pos", "utt"))
    return ex.where((F.col("pos") % F.col("s") == 0) & (F.col("pos") < F.col("s") * n)).select("utt", spk)


def speaker_prefix(df: DataFrame, limit: int, spk: str = "spk") -> DataFrame:
    """Speakers in order while the running count of utterances before them is below the limit."""
    n = df.groupBy(spk).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(spk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(n.withColumn("before", before).where(F.col("before") < limit).select(spk), spk, "left_semi")


def sample_n(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """N rows by the order of a hash of seed and key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def per_group(df: DataFrame, group: str, n: int, order: list[Column | str]) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def copies(df: DataFrame, n: int, key: str = "utt") -> DataFrame:
    """U8: n + 1 rows of each, with the key suffixed _copy-0 to _copy-n."""
    out = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return out.withColumn(key, F.concat(F.col(key).cast("string"), F.lit("_copy-"), F.col("_k").cast("string"))).drop("_k")


def combine(tables: list[DataFrame], key: str) -> DataFrame:
    """Union of same-named tables, sorted by key."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.orderBy(key)


def repair(utts: DataFrame, speakers: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(utts, speakers, recordings) that refer to each other; utts has utt, spk, rec.

    Duplicate keys leave their least row; utterances need their speaker and recording, and the others need
    an utterance.
    """
    utts, speakers, recordings = first_of_key(utts, "utt"), first_of_key(speakers, "spk"), first_of_key(recordings, "rec")
    utts = utts.join(recordings.select("rec"), "rec", "left_semi").join(speakers.select("spk"), "spk", "left_semi")
    return utts, speakers.join(utts.select("spk").distinct(), "spk", "left_semi"), recordings.join(utts.select("rec").distinct(), "rec", "left_semi")


def majority(df: DataFrame, key: str, label: str, weight: str) -> DataFrame:
    """The label of the largest total weight of each key; ties go to the smaller label."""
    total = df.groupBy(key, label).agg(F.sum(weight).alias("w"))
    return total.groupBy(key).agg(F.min(F.struct((-F.col("w")).alias("w"), label)).alias("m")).select(key, F.col(f"m.{label}").alias(label), (-F.col("m.w")).alias("total"))


def longest(df: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """The row of the largest value in each group; ties go to the smaller key."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k")))
    return df.groupBy(group).agg(best.alias("m")).select(group, F.col("m.k").alias(key), (-F.col("m.v")).alias(value))


def shard_ids(df: DataFrame, order: list[Column | str], size: int) -> DataFrame:
    """K6: rows dealt into shards of `size` in the given order; the order is numbered by range partitions."""
    from vecspan.plans.prefix import running_sums

    dealt = df.withColumn("_h", F.conv(F.substring(order[0], 1, 4), 16, 10).cast("int")) if order else df
    numbered = running_sums(dealt, "_h", order, {"_n": F.lit(1)})
    return numbered.withColumn("shard", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_h", "_n")


def jitter(df: DataFrame, value: str, spread: float, *key: Column) -> DataFrame:
    """Value times a hashed factor in [1 - spread, 1 + spread)."""
    return df.withColumn("jittered", F.col(value) * (1 - spread + 2 * spread * hashed_unit(*key)))
