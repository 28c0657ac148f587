"""Structured Streaming: online clustering, gallery identification, gates and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vecspan.functions import vectors as V
from vecspan.operators.clustering import OnlineClusters

_OUT = "rec string, seq long, cluster int, conf double"


def online_clusters(stream: DataFrame, threshold: float = 0.5, most: int = 10) -> DataFrame:
    """ST2, ST9: rec, seq, cluster, conf from a stream of (rec, seq, v); centroids are the state of each recording.

    Rows of a micro-batch are taken in the order of seq.
    """

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        centroids, counts = state.get if state.exists else ([], [])
        own = OnlineClusters(threshold, most, [np.array(c) for c in centroids], list(counts))
        rows = pd.concat(list(batches)).sort_values("seq")
        found = [own.add(np.asarray(v)) for v in rows["v"]]
        state.update(([c.tolist() for c in own.centroids], own.counts))
        yield pd.DataFrame({"rec": key[0], "seq": rows["seq"], "cluster": [k for k, _ in found], "conf": [c for _, c in found]})

    rows = stream.select(F.col("rec").cast("string").alias("rec"), F.col("seq").cast("long").alias("seq"), V.as_double(F.col("v")).alias("v"))
    return rows.groupBy("rec").applyInPandasWithState(step, _OUT, "centroids array<array<double>>, counts array<int>", "append", GroupStateTimeout.NoTimeout)


def identify_stream(stream: DataFrame, gallery: list[tuple[str, list[float]]], threshold: float | None = None) -> DataFrame:
    """ST3: best gallery speaker and score of each vector; the gallery, a bounded list, stands in the expression."""
    u = V.l2_normalise(V.as_double(F.col("v")))
    scores = F.array(*[F.struct((-V.dot(u, V.l2_normalise(F.array(*[F.lit(float(x)) for x in v])))).alias("s"), F.lit(spk).alias("spk")) for spk, v in gallery])
    out = stream.withColumn("_best", F.array_min(scores)).withColumn("spk", F.col("_best.spk")).withColumn("score", -F.col("_best.s")).drop("_best")
    return out if threshold is None else out.where(F.col("score") >= threshold)


def gate(stream: DataFrame, classes: str = "classes", least: float = 0.5) -> DataFrame:
    """ST4: rows whose frames are at least `least` of one speaker (class 1)."""
    ones = F.size(F.filter(classes, lambda c: c == 1))
    return stream.where(ones >= least * F.size(classes))


def hopping_counts(stream: DataFrame, ts: str, key: str, size: str = "1 hour", hop: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """ST1: counts in sliding windows; the time column is cast to a timestamp, as a watermark needs it."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if late else rows
    return rows.groupBy(F.window("_ts", size, hop), key).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts in sessions that end after a gap."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.session_window("_ts", gap), key).agg(F.count("*").alias("n"))


def distinct_stream(stream: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First rows of each key within the watermark."""
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(keys).drop("_ts")


def frames_with_carry(stream: DataFrame, size: int, hop: int) -> DataFrame:
    """ST6: frames of `size` samples every `hop` from a stream of (rec, seq, samples); left-over samples are state."""

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        rest, index = state.get if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        samples = np.concatenate([np.asarray(rest, float), *[np.asarray(s, float) for s in rows["samples"]]])
        n = max(0, (len(samples) - size) // hop + 1) if len(samples) >= size else 0
        state.update((samples[n * hop :].tolist(), int(index) + n))
        yield pd.DataFrame({"rec": key[0], "frame": np.arange(index, index + n), "x": [samples[k * hop : k * hop + size].tolist() for k in range(n)]})

    rows = stream.select(F.col("rec").cast("string").alias("rec"), F.col("seq").cast("long").alias("seq"), F.col("samples").cast("array<double>").alias("samples"))
    return rows.groupBy("rec").applyInPandasWithState(step, "rec string, frame long, x array<double>", "rest array<double>, n long", "append", GroupStateTimeout.NoTimeout)
