"""Exact deduplication by a tree merge of digest runs.

Rows are dealt into runs. Each run is combined on its own (digest -> best row, count); then runs are
exchanged in binomial rounds, FAN_BITS rounds at a time: run r meets the runs that share r >> FAN_BITS and a
multiway merge keeps one row per digest. A downward sweep hands the final choice back level by level. No
digest, however often it occurs, has more than 2**FAN_BITS rows per merged run at any level, so copies never
gather in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspan.llm.common import fresh_names, materialize, sqrt_buckets

#: Binomial rounds merged in one exchange: 2**5 runs meet.
FAN_BITS = 5

#: What makes two texts equal: SHA-256, and as its verification the length and an independent 64-bit hash.
KEY = ["sha", "n_chars", "check64"]


def _levels(n: int) -> int:
    """Merge levels so that the first runs hold about sqrt(n) rows."""
    return max(1, math.ceil(math.log2(sqrt_buckets(n)) / FAN_BITS)) if n > 1 else 1


def merge_up(rows: DataFrame, key: list[str], best: Callable[[Column], Column]) -> tuple[DataFrame, list[DataFrame], int]:
    """(top, run tables, levels): top has key, best and n, a row per key.

    rows is a materialized table with key and mark (a struct); best is F.max or F.min.
    """
    levels = _levels(rows.count())
    up = with_runs(rows, levels).groupBy("run", *key).agg(best(F.col("mark")).alias("best"), F.count("*").alias("n"))
    tables = []
    for _ in range(levels):
        tables.append(up := materialize(up, "run"))
        merged = up.withColumn("run", F.shiftright("run", FAN_BITS))
        up = merged.groupBy("run", *key).agg(best(F.col("best")).alias("best"), F.sum("n").alias("n"))
    return up.drop("run"), tables, levels


def with_runs(rows: DataFrame, levels: int) -> DataFrame:
    """Deal rows into 2**(FAN_BITS * levels) runs by the hash of mark.row."""
    return rows.withColumn("run", F.shiftrightunsigned(F.xxhash64("mark.row"), 64 - FAN_BITS * levels))


def hand_down(rows: DataFrame, top: DataFrame, key: list[str], tables: list[DataFrame], levels: int) -> DataFrame:
    """rows with the columns of top (a row per key), brought back level by level."""
    final = top.withColumn("run", F.lit(0).cast("long"))
    for table in reversed(tables):
        child = table.select(F.col("run").alias("below"), F.shiftright("run", FAN_BITS).alias("run"), *key)
        final = child.join(final, ["run", *key]).drop("run").withColumnRenamed("below", "run")
        final = materialize(final, "won")
    return with_runs(rows, levels).join(final, ["run", *key]).drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts form one group. Of equal texts the row with the largest id
    stays; a null id is below all others; of repeated rows with that id exactly one stays. An empty table
    gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.length(text).cast("long").alias("n_chars"),
        F.xxhash64(text).alias("check64"),
        F.struct(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row")).alias("mark"),
    )
    rows = materialize(rows, "digests")
    top, tables, levels = merge_up(rows, KEY, F.max)
    return hand_down(rows, top, KEY, tables, levels).select(
        "mark.doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("mark.row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups does not keep; all columns stay as they are.

    Repeated rows with the same id and text leave one row.
    """
    own_id, own_sha = fresh_names(docs, "kept_id", "kept_sha")
    kept = exact_groups(docs, id_col, text_col).where("kept")
    kept = materialize(kept.select(F.col("doc_id").alias("right_id"), F.col("text_sha256").alias("right_sha"), F.col("group_size").alias("right_size")), "kept")
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    left = docs.withColumn(own_sha, sha).withColumn(own_id, F.col(id_col))

    def on(table: DataFrame) -> Column:
        return table[own_id].eqNullSafe(kept["right_id"]) & (table[own_sha] == kept["right_sha"])

    out = left.join(kept, on(left), "left_semi")
    ids = left.select(own_id, own_sha)
    again = ids.join(kept.where("right_size > 1"), on(ids), "left_semi").groupBy(own_id, own_sha).count()
    if not again.where("count > 1").isEmpty():
        out = out.dropDuplicates([own_id, own_sha])
    return out.drop(own_id, own_sha)
