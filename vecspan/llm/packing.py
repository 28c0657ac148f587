"""Packing documents into sequences of fixed capacity by length patterns.

The histogram of piece lengths is all that planning needs. Patterns of up to three lengths that fill a
sequence exactly are enumerated, their repeat counts are fitted to the histogram by non-negative least
squares and rounded, and what is left is packed by best fit into further patterns. Each piece then gets its
place from its rank among the pieces of its length, so nothing but the histogram reaches the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspan.llm.common import join_ranks, materialize, running_offset, sqrt_buckets
from vecspan.llm.tokens import END_ID, TOKENIZER, encoder

CAPACITY = 1024

#: Steps of the accelerated projected gradient method; the residual's best fit takes up what they leave.
NNLS_STEPS = 600


def exact_patterns(capacity: int) -> np.ndarray:
    """All patterns a >= b >= c >= 0 of lengths with a + b + c = capacity, a row each."""
    b, c = np.meshgrid(np.arange(capacity + 1), np.arange(capacity + 1), indexing="ij")
    a = capacity - b - c
    keep = (a >= b) & (b >= c)
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def fit_repeats(histogram: np.ndarray, patterns: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """min |A x - histogram|, x >= 0, by FISTA; A counts each length in each pattern.

    Lengths up to an eighth of the capacity weigh less: their left-overs fit into any gap.
    """
    capacity = len(histogram) - 1
    weight = np.where(np.arange(capacity + 1) <= capacity // 8, 0.1, 1.0)
    weight[0] = 0.0
    goal = histogram * weight

    def forward(x: np.ndarray) -> np.ndarray:
        return weight * sum(np.bincount(patterns[:, k], x, capacity + 1) for k in range(patterns.shape[1]))

    def backward(y: np.ndarray) -> np.ndarray:
        y = weight * y
        return sum(y[patterns[:, k]] for k in range(patterns.shape[1]))

    v = np.ones(len(patterns))
    for _ in range(20):
        v = backward(forward(v))
        v /= np.linalg.norm(v)
    step = 1.0 / max(1e-12, 1.02 * np.linalg.norm(backward(forward(v))))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * backward(forward(y) - goal))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def pack_residual(left: np.ndarray) -> Counter:
    """Best fit, longest first, on the histogram of what is left: pattern (lengths) -> repeats.

    Open sequences of the same gap and content are handled together, so the work follows the number of
    distinct lengths and patterns, not that of pieces.
    """
    capacity = len(left) - 1
    open_by_gap: dict[int, Counter] = {}
    gaps = np.zeros(capacity + 1, dtype=bool)
    done: Counter = Counter()

    def put(pattern: tuple[int, ...], gap: int, n: int) -> None:
        if gap == 0:
            done[pattern] += n
        else:
            open_by_gap.setdefault(gap, Counter())[pattern] += n
            gaps[gap] = True

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                pattern, there = open_by_gap[gap].popitem()
                take = min(n, there)
                if there > take:
                    open_by_gap[gap][pattern] = there - take
                elif not open_by_gap[gap]:
                    gaps[gap] = False
                put((*pattern, length), gap - length, take)
                n -= take
            else:
                each = capacity // length
                if n >= each:
                    put((length,) * each, capacity - each * length, n // each)
                    n %= each
                else:
                    put((length,) * n, capacity - n * length, 1)
                    n = 0
    for patterns in open_by_gap.values():
        done.update(patterns)
    return done


def plan(histogram: np.ndarray, steps: int = NNLS_STEPS) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that together use every piece of the histogram (index = length) exactly once."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    used: Counter = Counter()
    if left[1:].sum():
        patterns = exact_patterns(capacity)
        present = (patterns == 0) | (left[patterns] > 0)
        patterns = patterns[present.all(axis=1)]
        if len(patterns):
            repeats = np.rint(fit_repeats(left.astype(float), patterns, steps)).astype(np.int64)
            for k in np.argsort(-repeats, kind="stable"):
                if repeats[k] <= 0:
                    break
                need = Counter(int(x) for x in patterns[k] if x)
                n = min(int(repeats[k]), *(int(left[x]) // m for x, m in need.items()))
                if n > 0:
                    used[tuple(int(x) for x in patterns[k] if x)] += n
                    for x, m in need.items():
                        left[x] -= n * m
    used.update(pack_residual(left))
    return sorted(used.items(), reverse=True)


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id, cut into pieces.

    Only documents of more than capacity ids are cut; all but their first piece have that length.
    """

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, end = encoder(tokenizer).encode, END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                begin, stop, k = 0, n % capacity or capacity, 0
                while begin < n:
                    for column, value in zip(out, (doc_id, k, begin, stop - begin, zlib.crc32(ids[4 * begin : 4 * stop])), strict=True):
                        column.append(value)
                    begin, stop, k = stop, stop + capacity, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    import pyarrow as pa

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return ids.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are documents of their own. An empty table
    gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity, id_col, text_col, tokenizer).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        histogram[length] = n
    places, base, used = [], 0, Counter()
    for pattern, repeats in plan(histogram):
        offset = 0
        for length, times in sorted(Counter(pattern).items(), reverse=True):
            places.append((length, used[length], used[length] + repeats * times, times, base, offset))
            used[length] += repeats * times
            offset += length * times
        base += repeats
    ranges = spark.createDataFrame(places, "length long, lo long, hi long, times long, base long, first long")
    total = int(histogram.sum())
    ranked = cut.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(sqrt_buckets(total))).cast("int"))
    ranked = running_offset(ranked, ["length"], "bucket", ["row"], F.lit(1), "rank")
    out = join_ranks(ranked, ranges, "length")
    turn = F.col("rank") - F.col("lo")
    return out.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("base") + F.floor(turn / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("first") + turn % F.col("times") * F.col("length")).cast("long").alias("offset"),
    )
