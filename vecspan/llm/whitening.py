"""Whitening of embeddings by a tall-skinny QR.

Entries are taken to a grid of integers, so that counts, sums and deviations are exact. Rows are centred by the
exact sums, every task brings its rows into one triangular factor batch by batch, and the factors are merged in
a tree. The right singular vectors of the last factor are the components and its singular values their deviations,
so the covariance, whose condition is the square of the rows', is never formed. What leaves a task is of the size of
the dimension squared, and a node of the tree holds at most FAN_IN such states beside those of its own round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspan.llm.common import materialize

#: An entry c is x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Nodes of the tree's rounds: states of more tasks than the first width meet in its nodes.
FAN_IN = 16
WIDTHS = (FAN_IN**3, FAN_IN**2, FAN_IN, 1)
#: Components whose deviation is at most this share of the first one's have no variance to the precision of doubles.
LEAST = 1e-12


@dataclass(frozen=True)
class Whitening:
    """Rows, sums by dimension, whitening matrix (dimension x components), explained share and identity error."""

    n: int
    sums: np.ndarray
    matrix: np.ndarray
    explained: np.ndarray
    identity_error: float


def tree_merge(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """The states of parts (node long, state binary) merged level by level; None if there are none."""

    def step(group):
        import pandas as pd

        group = group.sort_values("at")
        return pd.DataFrame({"node": group["node"].iloc[:1], "state": [merge(list(group["state"]))]})

    for width in WIDTHS:
        dealt = parts.select((F.col("node") % width).alias("node"), F.col("node").alias("at"), "state")
        parts = dealt.groupBy("node").applyInPandas(step, "node long, state binary")
    row = parts.first()
    return bytes(row["state"]) if row else None


def merge_factors(states: list[bytes]) -> bytes:
    """The triangular factor of stacked triangular factors."""
    stacked = [np.frombuffer(s) for s in states]
    d = round(len(stacked[0]) ** 0.5)
    return np.linalg.qr(np.concatenate(stacked).reshape(-1, d), mode="r").tobytes()


def merge_moments(states: list[bytes]) -> bytes:
    """Count, mean and centred products of joined sets (each state: 1 + k + k * k doubles)."""
    k = round((len(states[0]) / 8 - 0.75) ** 0.5 - 0.5)
    n, mean, products = 0.0, np.zeros(k), np.zeros((k, k))
    for s in states:
        v = np.frombuffer(s)
        m, apart = v[0], v[1 : k + 1] - mean
        if m:
            products = products + v[k + 1 :].reshape(k, k) + np.outer(apart, apart) * (n * m / (n + m))
            mean = mean + apart * (m / (n + m))
            n += m
    return np.concatenate([[n], mean, products.ravel()]).tobytes()


def _clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec (array<double>) of the rows whose vector is whole and finite."""
    vec = F.col(vector_col).cast("array<double>")
    finite = F.forall(vec, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return df.select(F.col(id_col).alias("vec_id"), vec.alias("vec")).where(F.col("vec").isNotNull() & finite)


def _grid(column, d: int) -> np.ndarray:
    """The integers of a batch's vectors of d entries, a row each."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def _sums(clean: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and exact sums by dimension of the most frequent number of entries (of the larger one, if equal)."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        total: dict[int, list] = {}
        for batch in batches:
            sizes = pc.list_value_length(batch.column(0))
            for d in pc.unique(sizes).to_pylist():
                x = _grid(batch.column(0).filter(pc.equal(sizes, d)), d) if d else np.zeros((0, 0), np.int64)
                at = total.setdefault(d, [0, np.zeros(d, np.int64)])
                at[0] += len(x)
                at[1] += x.sum(axis=0)
        rows = [(d, k, n, int(s)) for d, (n, sums) in total.items() for k, s in enumerate(sums)]
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["d", "k", "n", "s"])

    parts = clean.select("vec").mapInArrow(add, "d int, k int, n long, s long")
    total = materialize(parts.groupBy("d", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "sums")
    top = total.where("k = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return 0, np.zeros(0, np.int64)
    return top["n"], np.array([r["s"] for r in total.where(F.col("d") == top["d"]).orderBy("k").collect()], np.int64)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, in 64-bit integers."""
    if len(x) and n * int(np.abs(x).max()) + int(np.abs(sums).max()) >= 2**63:
        raise OverflowError(f"{n} rows are too many for 64-bit deviations")
    return n * x - sums


def _factor(clean: DataFrame, n: int, sums: np.ndarray) -> np.ndarray | None:
    """The triangular factor of all centred rows."""
    d = len(sums)

    def factor(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        r = np.zeros((0, d))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, _deviations(_grid(batch.column(0), d), n, sums) / n]), mode="r")
        if len(r):
            square = np.vstack([r, np.zeros((d - len(r), d))])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([square.tobytes()], pa.binary())], names=["node", "state"])

    state = tree_merge(clean.select("vec").mapInArrow(factor, "node long, state binary"), merge_factors)
    return None if state is None else np.frombuffer(state).reshape(-1, d)


def _identity_error(clean: DataFrame, n: int, sums: np.ndarray, matrix: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    d, k = matrix.shape

    def moments(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        states: list[bytes] = []
        for batch in batches:
            z = _deviations(_grid(batch.column(0), d), n, sums) / n @ matrix
            if len(z):
                mean = z.mean(axis=0)
                states = [merge_moments([*states, np.concatenate([[len(z)], mean, ((z - mean).T @ (z - mean)).ravel()]).tobytes()])]
        if states:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array(states, pa.binary())], names=["node", "state"])

    state = np.frombuffer(tree_merge(clean.select("vec").mapInArrow(moments, "node long, state binary"), merge_moments))
    return float(np.abs(state[k + 1 :].reshape(k, k) / state[0] - np.eye(k)).max())


def fit(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening:
    """The whitening of all rows whose vector is whole: as many components as the rows have variance for, at most `components`."""
    clean = _clean(df, id_col, vector_col)
    n, sums = _sums(clean)
    d = len(sums)
    if not n:
        return Whitening(0, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    clean = clean.where(F.size("vec") == d)
    _, s, right = np.linalg.svd(_factor(clean, n, sums))
    keep = min(components, int((s > LEAST * s[0]).sum()))
    matrix = right[:keep].T * (n**0.5 / s[:keep])
    explained = s[:keep] ** 2 / max((s**2).sum(), 1e-300)
    return Whitening(n, sums, matrix, explained, _identity_error(clean, n, sums, matrix) if keep else 0.0)


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or has null or non-finite entries are left out, and so are those whose number of
    entries is not that of most rows. Repeated rows and null ids are rows like others. An empty table, one row, or
    rows that are all alike have no component and give an empty result, and fewer than `components` come where the
    rows have no more variance. Other columns are ignored. Deviations beyond 64 bits raise an OverflowError.
    """
    d, k = model.matrix.shape
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def project(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            apart = _deviations(_grid(batch.column(1), d), model.n, model.sums)
            rows = len(apart)
            if rows and d * int(np.abs(apart).max()) ** 2 >= 2**63:
                squares = np.array([sum(int(v) ** 2 for v in row) for row in apart], dtype=object)
            else:
                squares = (apart * apart).sum(axis=1)
            place = pa.array(np.repeat(np.arange(rows), k))
            columns = [
                batch.column(0).take(place),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n, np.int64)),
                pa.array(squares, pa.int64()).take(place),
                pa.array((apart / model.n @ model.matrix).ravel()),
                pa.array(np.tile(model.explained, rows)),
                pa.array(np.full(rows * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = _clean(df, id_col, vector_col).where(F.size("vec") == d if k else F.lit(False))
    return rows.select(F.col("vec_id").cast("long"), "vec").mapInArrow(project, out)
