"""Training-order shards: every sequence's global slot is a keyed permutation of its index.

Documents become rows of STRIDE token ids (16-bit, the last row of a document padded). Rows are numbered by
their place in the partitions of the token table, the number goes through a Feistel network over the next
even power of two with cycle walking, and range partitions of slots write shards of a fixed number of
fixed-length rows, in order. Any slot's shard and place in it follow from the slot alone, so reading can start,
or start again, anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.llm.common import bounded_join, materialize, running_offset, scratch_path, sqrt_buckets
from vecspan.llm.tokens import END_ID, TOKENIZER, encoder

STRIDE = 512
ROWS_PER_SHARD = 4096
KEY = 20240229
ROUNDS = 6
#: At most so many tasks write shards; each writes a run of neighbouring ones.
MOST_TASKS = 20_000


def _round(x: np.ndarray, key: int, r: int) -> np.ndarray:
    """A keyed hash of the half block."""
    x = (x + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) % 2**64)) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0..n-1, element by element."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_round(right, key, r) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def token_rows(docs: DataFrame, stride: int = STRIDE, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, n_tokens, ids_crc32, ids: each document's ids and the end id in rows of stride 16-bit ids."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, end = encoder(tokenizer).encode, END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(encode(text.as_py()) + end, "<u4")
                if int(ids.max()) >= 1 << 16:
                    raise ValueError("this format holds ids below 65536 only")
                ids = ids.astype("<u2")
                for piece, begin in enumerate(range(0, len(ids), stride)):
                    part = ids[begin : begin + stride]
                    row = part.tobytes()
                    for column, value in zip(out, (doc_id, piece, len(part), zlib.crc32(row), row + b"\0" * (2 * stride - len(row))), strict=True):
                        column.append(value)
                if len(out[0]) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
                    out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    import pyarrow as pa

    names = ["doc_id", "piece", "n_tokens", "ids_crc32", "ids"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(cut, "doc_id long, piece int, n_tokens int, ids_crc32 long, ids binary")


def training_order(docs: DataFrame, stride: int = STRIDE, rows_per_shard: int = ROWS_PER_SHARD, key: int = KEY, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """slot, shard, place, doc_id, piece, n_tokens, ids_crc32, ids - dealt into ranges of shards, each in order.

    A null or empty text is one row with the end id. Repeated rows are documents of their own. An empty table
    gives an empty result. Other columns are ignored.
    """
    rows = token_rows(docs, stride, id_col, text_col, tokenizer).withColumn("uid", F.monotonically_increasing_id())
    rows = materialize(rows, "rows", compression="zstd")
    part = F.shiftrightunsigned("uid", 33)
    counts = materialize(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    bases = counts.withColumn("bucket", F.floor(F.col("part") / sqrt_buckets(counts.count())))
    bases = materialize(running_offset(bases, [], "bucket", ["part"], F.col("n"), "base").select("part", "base"), "bases")
    numbered = bounded_join(rows.withColumn("part", part), bases, "part")

    @F.pandas_udf("long")
    def slot_of(index):
        import pandas as pd

        return pd.Series(permute(index.to_numpy(), total, key))

    local = F.col("uid") - F.shiftleft("part", 33)
    placed = numbered.withColumn("slot", slot_of(F.col("base") + local))
    placed = placed.withColumn("shard", F.floor(F.col("slot") / rows_per_shard).cast("long"))
    shards = -(-total // rows_per_shard)
    per_task = max(1, -(-shards // MOST_TASKS))
    dealt = placed.repartitionById(max(1, -(-shards // per_task)), F.floor(F.col("shard") / per_task).cast("int"))
    dealt = dealt.sortWithinPartitions("slot").withColumn("place", (F.col("slot") % rows_per_shard).cast("int"))
    return dealt.select("slot", "shard", "place", "doc_id", "piece", "n_tokens", "ids_crc32", "ids")


def write_shards(ordered: DataFrame, path: str) -> None:
    """Write training_order's result, a folder per shard. A task that is run again replaces its own files only."""
    ordered.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, first_slot: int = 0, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """The rows from first_slot on; earlier shards are not opened. Rows of a shard file are in the order of slot."""
    rows = spark.read.schema("slot long, place int, doc_id long, piece int, n_tokens int, ids_crc32 long, ids binary, shard long").parquet(path)
    return rows.where((F.col("shard") >= first_slot // rows_per_shard) & (F.col("slot") >= first_slot))


def materialize_order(docs: DataFrame, path: str | None = None, **options: object) -> DataFrame:
    """Write the shards (by default to the shared scratch folder) and return them as read back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "shards")
    write_shards(training_order(docs, **options), path)
    return read_shards(spark, path)
