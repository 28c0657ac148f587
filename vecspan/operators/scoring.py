"""Trials: generation, cosine scores, score normalisation, calibration, identification."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vecspan.functions import vectors as V
from vecspan.sources.storage import kept


#: Tasks that cells of pairs are dealt to at most; by the bytes of the rows they would be few.
MOST_TASKS = 200


def mean_vectors(df: DataFrame, group: list[str], vec: str = "v") -> DataFrame:
    """A4, A5: mean vector of each group (all rows if group is empty), a sum per dimension with map-side combine."""
    long = df.select(*group, F.posexplode(V.as_double(F.col(vec))).alias("i", "x"))
    avg = long.groupBy(*group, "i").agg(F.avg("x").alias("x"))
    back = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return avg.groupBy(*group).agg(back.alias(vec))


def enrol(df: DataFrame, spk: str = "spk", vec: str = "v") -> DataFrame:
    """Mean of each speaker, then unit length."""
    return mean_vectors(df, [spk], vec).withColumn(vec, V.l2_normalise(F.col(vec)))


def pairs(df: DataFrame, key: str, spk: str, same: bool | None = None, on: list[str] | None = None, block: int = 2048) -> DataFrame:
    """Unordered pairs enroll < test with target; same keeps target or non-target pairs only.

    This grows with the square of its input: give it the chosen utterances of a trial list, or blocks (on). Rows of one group
    (of on, and of spk for target pairs) are dealt into blocks, and every two blocks, and every block with itself, are a cell
    of their own, so a large speaker is many tasks and no pair is made twice. Without groups the blocks are ranges of the key.
    """
    on = on or []
    if not on and not same:
        out = _pairs_of_ranges(df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(spk).alias("spk")), block)
        return out if same is None else out.where(~F.col("target"))
    names = [f"_g{k}" for k in range(len(on))]
    group = [*names, "spk"] if same else names
    rows = df.where(F.col(key).isNotNull()).select(*[F.col(c).alias(g) for c, g in zip(on, names, strict=True)], F.col(key).alias("key"), F.col(spk).alias("spk"))
    for c in group:
        rows = rows.where(F.col(c).isNotNull())
    n = max(1, -(-(rows.groupBy(*group).count().agg(F.max("count").alias("n")).first()["n"] or 0) // block))
    place = F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    columns = [F.col(c).alias(c) for c in rows.columns]
    a = rows.select(*columns, place.alias("_i")).withColumn("_j", F.explode(F.sequence(F.col("_i"), F.lit(n - 1))))
    b = rows.select(*columns, place.alias("_j")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_j"))))
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"{g} {kinds[c]}" for c, g in zip(on, names, strict=True)], f"enroll {kinds[key]}", f"test {kinds[key]}", "target boolean"])
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def cell(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(left) or not len(right):
            return pa.Table.from_batches([], fields)
        c, out, m = Cell(left, right, []), [], len(right)
        x, y = c.keys
        whole = left["_i"][0].as_py() < left["_j"][0].as_py()
        step = max(1, (1 << 16) // m)
        for start in range(0, len(x), step):
            own = x.slice(start, step)
            at, of = pa.array(np.repeat(np.arange(len(own)), m)), pa.array(np.tile(np.arange(m), len(own)))
            p, q = own.take(at), y.take(of)
            lo, hi = (p, q) if not whole else (pc.if_else(pc.less(p, q), p, q), pc.if_else(pc.less(p, q), q, p))
            s, t = c.a[start : start + step, None], c.b[None]
            target = pa.array((s == t).ravel(), mask=((s < 0) | (t < 0)).ravel())
            batch = pa.RecordBatch.from_arrays([*[left[g].combine_chunks().take(pa.array(np.zeros(len(p), np.int64))) for g in names], lo, hi, target], schema=fields)
            keep = None if whole else pc.less(p, q)
            if same is not None:
                wanted = target if same else pc.invert(target)
                keep = wanted if keep is None else pc.and_(keep, wanted)
            out.append(batch if keep is None or same and whole else batch.filter(keep))
        return pa.Table.from_batches(out, fields)

    cells = [*group, "_i", "_j"]
    dealt = lambda x: x.repartition(min(MOST_TASKS, n * (n + 1) // 2 * (8 if group else 1)), *cells)  # noqa: E731  # small tables, but many pairs
    made = dealt(a).groupBy(*cells).cogroup(dealt(b).groupBy(*cells)).applyInArrow(cell, schema)
    return made.select(*[F.col(g).alias(c) for c, g in zip(on, names, strict=True)], "enroll", "test", "target")


def _pairs_of_ranges(rows: DataFrame, block: int, beside: int = 64) -> DataFrame:
    """pairs of all rows (key, spk): a row of the second block of a cell stands beside that many rows of the first at a time, so that keys in columnar files cost little.

    The rows of a range of keys are packed into one row, so a cell is a join of few rows, and pairs are listed as they are written.
    """
    n = max(1, -(-rows.count() // block))
    ranges = rows.repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("_b")).agg(F.sort_array(F.collect_list(F.struct("key", "spk"))).alias("right"))
    ranges = kept(ranges, "ranges")  # the bounds are sampled, so they are drawn once for both sides
    parts = F.transform(F.sequence(F.lit(0), F.size("right") - 1, F.lit(beside)), lambda k: F.slice("right", k + 1, beside))
    a = ranges.select(F.col("_b").alias("_i"), F.explode(F.sequence("_b", F.lit(n - 1))).alias("_j"), parts.alias("parts")).select("_i", "_j", F.explode("parts").alias("left"))
    b = ranges.select(F.explode(F.sequence(F.lit(0), "_b")).alias("_i"), F.col("_b").alias("_j"), "right")
    dealt = lambda x: x.repartition(min(MOST_TASKS, n * (n + 1) // 2), "_i", "_j")  # noqa: E731  # small tables, but many pairs
    cells = dealt(a).join(dealt(b).hint("merge"), ["_i", "_j"])
    listed = cells.select("left", F.explode("right").alias("q")).select(F.explode("left").alias("p"), "q").where("p.key < q.key")
    return listed.select(F.col("p.key").alias("enroll"), F.col("q.key").alias("test"), (F.col("p.spk") == F.col("q.spk")).alias("target"))


def _matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of an Arrow list column as rows of a matrix, filled up with zeros, and their lengths: -1 if null or with a null inside."""
    column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(int)
    inside, flat = np.arange(width) < lengths[:, None], column.flatten()
    out, holes = np.zeros(inside.shape), np.zeros(inside.shape, bool)
    out[inside], holes[inside] = flat.fill_null(0.0).to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    return out, np.where(holes.any(axis=1), -1, lengths)


class Cell:
    """One block of queries and one of rows: vectors x and y, codes of speakers (-1: null), which pairs have no common length, carried columns."""

    def __init__(self, left, right, carry: list[str]) -> None:
        import pyarrow as pa

        self.keys = left["key"].combine_chunks(), right["key"].combine_chunks()
        both = pa.chunked_array([*left["spk"].chunks, *right["spk"].chunks], left["spk"].type).combine_chunks().dictionary_encode()
        codes = both.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.a, self.b, self.names = codes[: len(left)], codes[len(left) :], both.dictionary
        if "v" in left.column_names:
            width = max(int(t["v"].combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False).max(initial=0)) for t in (left, right))
            (self.x, n), (self.y, m) = _matrix(left["v"], width), _matrix(right["v"], width)
            self.lost = n[:, None] < 0
            self.apart = None if (n == n[0]).all() and (m == n[0]).all() and n[0] >= 0 else (n[:, None] != m) | self.lost
        else:
            self.x = self.y = self.apart = self.lost = None
        self.q, self.r = ({c: t[c].to_numpy() for c in carry} for t in (left, right))
        own, others = (k.to_numpy(zero_copy_only=False) for k in self.keys)
        self.same = own[:, None] == others if np.isin(own, others).any() else None

    def units(self, mean: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """x and y at unit length, less mean first; pairs with a vector of length 0 are apart."""
        out, zero = [], []
        for v in (self.x, self.y):
            v = v if mean is None or not v.shape[1] else v - np.asarray(mean)
            n = np.sqrt((v * v).sum(axis=1, keepdims=True))
            zero.append(n[:, 0] == 0)
            out.append(v / np.where(n == 0, 1.0, n))
        if zero[0].any() or zero[1].any():
            none = zero[0][:, None] | zero[1]
            self.apart = none if self.apart is None else self.apart | none
        return out[0], out[1]


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """x rounded, halves away from zero, as SQL does."""
    return np.copysign(np.floor(np.abs(x) * 10.0**places + 0.5), x) / 10.0**places + 0.0


def _rising(x: np.ndarray) -> np.ndarray:
    """Places of x by rising value, but for its last bits, which give way to the place: one sort of integers, several times faster than argsort."""
    low = (1 << max(0, len(x) - 1).bit_length()) - 1
    bits = x.view(np.int64)
    bits = bits ^ (bits >> 63 & np.iinfo(np.int64).max)  # integers in the order of the doubles
    return np.sort(bits & ~low | np.arange(len(x))) & low


def query_cells(queries: DataFrame, rows: DataFrame, run: Callable, schema: str, key: str = "utt", spk: str = "spk", vec: str | None = "v", carry: list[str] | None = None, counted: tuple[DataFrame, DataFrame] | None = None, block: int = 2048) -> DataFrame:
    """run(Cell), a list of Arrow batches, of every block of queries and every block of rows.

    Both sides are dealt into blocks and a cell of the grid holds one block of queries and one of rows, so neither
    side gathers in one task nor is broadcast whole. Rows without a key are left out. counted are tables of as many rows as
    queries and rows, if these are dear to count.
    """
    less, more = counted or (queries, rows)
    n_queries, n_rows = max(1, -(-less.count() // block)), max(1, -(-more.count() // block))
    place = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    carry = carry or []

    columns = [F.col(key).alias("key"), F.col(spk).alias("spk"), *([V.as_double(F.col(vec)).alias("v")] if vec else []), *[F.col(c).cast("double").alias(c) for c in carry]]
    a = queries.where(F.col(key).isNotNull()).select(*columns, place(n_queries).alias("_i"), every(n_rows).alias("_j"))
    b = rows.where(F.col(key).isNotNull()).select(*columns, place(n_rows).alias("_j"), every(n_queries).alias("_i"))
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def cell(left, right):
        import pyarrow as pa

        got = run(Cell(left, right, carry)) if len(left) and len(right) else []
        return pa.Table.from_batches(got, fields)

    dealt = lambda x: x.repartition(min(MOST_TASKS, n_queries * n_rows), "_i", "_j").groupBy("_i", "_j")  # noqa: E731  # small tables, but many pairs
    return dealt(a).cogroup(dealt(b)).applyInArrow(cell, schema)


def query_pairs(queries: DataFrame, rows: DataFrame, values: dict[str, str], kernel: Callable, columns: str = "enroll test", key: str = "utt", spk: str = "spk", vec: str | None = "v", carry: list[str] | None = None, alone: tuple[str, ...] = (), counted: tuple[DataFrame, DataFrame] | None = None, by: str | None = None, strip: int = 1 << 23) -> DataFrame:
    """Every query against every row of another key: those of enroll, test, spk (the row's), target that columns names, and values.

    kernel(Cell) gives a function of a slice of queries: a matrix, queries by rows, of each value; masked entries are null. What
    it gives (values that are alone depend on the query's vector only) leaves a task in batches of about 65,536 pairs, rounded and in its final columns, and vectors leave none.

    The pairs are many more than the rows, so they leave a cell in an order that columnar files keep small: by the value `by`, which
    should be rounded, in strips of that many pairs, so that equal ones stand together; else each row beside 64 queries at a time.
    """
    names = columns.split()
    kinds = {"enroll": dict(queries.dtypes)[key], "test": dict(rows.dtypes)[key], "spk": dict(rows.dtypes)[spk], "target": "boolean", **values}
    schema = ", ".join(f"{n} {kinds[n]}" for n in [*names, *values])

    def run(c: Cell) -> list:
        import pyarrow as pa

        made, out, m = kernel(c), [], len(c.b)

        def worked(start: int, stop: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
            """The values of queries start to stop, some queries at a time, and where they are null."""
            data, none, step = {n: np.empty((stop - start, m)) for n in values}, {}, max(1, (1 << 16) // m)
            for s in range(start, stop, step):
                part = slice(s, min(s + step, stop))
                into, got = slice(s - start, part.stop - start), made(part)
                for n in values:
                    data[n][into] = np.ma.getdata(got[n])
                    apart = c.apart if n not in alone else np.broadcast_to(c.lost, (len(c.a), m)) if c.lost.any() else None
                    for mask in (np.ma.getmaskarray(got[n]) if np.ma.isMaskedArray(got[n]) else None, apart if apart is None else apart[part]):
                        if mask is not None and mask.any():
                            none.setdefault(n, np.zeros((stop - start, m), bool))[into] |= mask
            return data, none

        most = max(1, strip // m) if by else 64
        for start in range(0, len(c.a), most):
            stop = min(start + most, len(c.a))
            data, none = worked(start, stop)
            order = _rising(data[by].ravel()) if by else np.arange((stop - start) * m).reshape(-1, m).T.ravel()
            if c.same is not None and c.same[start:stop].any():
                order = order[~c.same[start:stop].ravel()[order]]
            at = (order // m).astype(np.int32)
            of = (order - at.astype(np.int64) * m).astype(np.int32)
            at += start
            cols = []
            for n in names:
                if n == "target":
                    a, b = c.a[at], c.b[of]
                    cols.append(pa.array(a == b, mask=(a < 0) | (b < 0)))
                else:
                    cols.append(c.keys[0].take(pa.array(at)) if n == "enroll" else c.keys[1].take(pa.array(of)) if n == "test" else c.names.take(pa.array(c.b[of], mask=c.b[of] < 0)))
            for n in values:
                cols.append(pa.array(data.pop(n).ravel()[order], mask=none[n].ravel()[order] if n in none else None))
            batch = pa.RecordBatch.from_arrays(cols, [*names, *values])
            out += [batch.slice(first, 1 << 16) for first in range(0, len(order), 1 << 16)]
        return out

    return query_cells(queries, rows, run, schema, key, spk, vec, carry, counted)


def cosines(f: Callable | None = None, mean: list[float] | None = None, places: int | None = None) -> Callable:
    """Kernel of query_pairs: f(Cell, slice, cosines), or the cosines as score."""

    def kernel(c: Cell) -> Callable:
        u, w = c.units(mean)
        return lambda s: f(c, s, u[s] @ w.T) if f else {"score": u[s] @ w.T if places is None else rounded(u[s] @ w.T, places)}

    return kernel


def plda_llrs(psi: list[float], n: float | None = None, places: int | None = None, swap: bool = False) -> Callable:
    """Kernel of query_pairs: llr as V.plda_llr of query and row; n enrolments, or those in the rows' carried n, which then are the enrolment side (swap).

    The sum over dimensions is one matrix product and a term of either side.
    """

    def kernel(c: Cell) -> Callable:
        e, t = (c.y, c.x) if swap else (c.x, c.y)
        p, k = np.asarray(psi), np.full((len(e), 1), n) if n is not None else c.r["n"][:, None]
        scale, var = k * p / (k * p + 1), 1 + p / (k * p + 1)
        cross, own = e * scale / var, -0.5 * (np.log(var) + (e * scale) ** 2 / var).sum(axis=1) + 0.5 * np.log(1 + p).sum()
        weight, squares = -0.5 / var + 0.5 / (1 + p), t**2

        def part(s: slice) -> dict[str, np.ndarray]:
            if swap:
                out = t[s] @ cross.T + own + squares[s] @ weight.T
            else:
                out = cross[s] @ t.T + own[s, None] + weight[s] @ squares.T
            return {"llr": out if places is None else rounded(out, places)}

        return part

    return kernel


def score_queries(queries: DataFrame, rows: DataFrame, mean: list[float] | None = None, key: str = "utt", spk: str = "spk", vec: str = "v", columns: str = "enroll test spk target", places: int | None = None) -> DataFrame:
    """B1 of every query against every other row: enroll, test, spk, target, score. Vectors are normalised once a cell."""
    return query_pairs(queries, rows, {"score": "double"}, cosines(mean=mean, places=places), columns, key, spk, vec, by=None if places is None else "score")


def best_scores(queries: DataFrame, rows: DataFrame, key: str = "utt", spk: str = "spk", vec: str = "v") -> DataFrame:
    """Enroll, spk, score: the best cosine of every query with the rows of each speaker; a cell gives one row for each of both."""

    def run(c: Cell) -> list:
        import pyarrow as pa

        u, w = c.units()
        order = np.argsort(c.b, kind="stable")
        codes, first = np.unique(c.b[order], return_index=True)
        out, step = [], max(1, (1 << 18) // len(c.b))
        for start in range(0, len(c.a), step):
            part = slice(start, min(start + step, len(c.a)))
            s = u[part] @ w.T
            for none in (c.apart, c.same):
                if none is not None:
                    s[none[part]] = -np.inf
            best = np.maximum.reduceat(s[:, order], first, axis=1).ravel()
            there = np.ones(best.shape, bool) if c.same is None else np.logical_or.reduceat(~c.same[part][:, order], first, axis=1).ravel()
            of = np.tile(codes, part.stop - part.start)
            at = pa.array(np.repeat(np.arange(part.start, part.stop), len(codes)))
            batch = pa.RecordBatch.from_arrays([c.keys[0].take(at), c.names.take(pa.array(of, mask=of < 0)), pa.array(best, mask=np.isneginf(best))], ["enroll", "spk", "score"])
            out.append(batch.filter(pa.array(there)))
        return out

    kinds = dict(rows.dtypes)
    cells = query_cells(queries, rows, run, f"enroll {dict(queries.dtypes)[key]}, spk {kinds[spk]}, score double", key, spk, vec)
    return cells.groupBy("enroll", "spk").agg(F.max("score").alias("score"))


def score(trials: DataFrame, enrol_vec: DataFrame, test_vec: DataFrame | None = None, mean: list[float] | None = None, key: str = "utt", vec: str = "v", strict: bool = False) -> DataFrame:
    """Cosine of each trial; vectors are normalised once, before the joins.

    Trials whose vectors are missing give no row, or an error if strict.
    """
    test_vec = enrol_vec if test_vec is None else test_vec

    def unit(df: DataFrame, name: str) -> DataFrame:
        v = V.as_double(F.col(vec))
        v = V.subtract(v, F.array(*[F.lit(float(x)) for x in mean])) if mean else v
        return df.select(F.col(key).alias(name), V.l2_normalise(v).alias(f"_{name}"))

    how = "left" if strict else "inner"
    out = trials.join(unit(enrol_vec, "enroll"), "enroll", how).join(unit(test_vec, "test"), "test", how)
    value = V.dot(F.col("_enroll"), F.col("_test"))
    if strict:
        value = F.when(F.col("_enroll").isNull() | F.col("_test").isNull(), F.raise_error(F.lit("a trial has no vector"))).otherwise(value)
    return out.withColumn("score", value).drop("_enroll", "_test")


def cohort_statistics(vecs: DataFrame, cohort: list[list[float]], top_n: int | None, key: str = "utt", vec: str = "v") -> DataFrame:
    """Mean and population deviation of each vector's top_n cohort cosines (all, if None).

    cohort is the bounded list of cohort vectors; every vector meets them inside its row, without a join.
    """
    unit = vecs.select(F.col(key), V.l2_normalise(V.as_double(F.col(vec))).alias("_u"))
    members = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in cohort])
    sims = F.transform(members, lambda c: V.dot(F.col("_u"), V.l2_normalise(c)))
    best = F.sort_array(sims, asc=False)
    best = F.slice(best, 1, top_n) if top_n else best
    out = unit.select(key, best.alias("s")).withColumn("mu", F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s"))
    sd = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + (x - F.col("mu")) * (x - F.col("mu"))) / F.size("s"))
    return out.select(key, "mu", sd.alias("sd"))


def cohort_statistics_join(vecs: DataFrame, cohort: DataFrame, top_n: int | None, key: str = "utt", vec: str = "v", cohort_key: str = "cohort") -> DataFrame:
    """A9 for cohorts that are tables: cohort rows are packed into blocks, each block scored in one numpy product.

    A row per (key, block) with the block's top_n scores reaches the shuffle, not one per pair.
    """
    size = 1024
    packed = cohort.select(F.pmod(F.xxhash64(cohort_key), F.lit(1 << 20)).alias("h"), F.col(vec).alias("c"))
    n = max(1, -(-cohort.count() // size))
    blocks = packed.groupBy((F.col("h") % n).alias("block")).agg(F.collect_list(V.as_double(F.col("c"))).alias("c"))
    both = vecs.select(F.col(key), V.as_double(F.col(vec)).alias("v")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))).join(blocks, "block")

    def top(batches):
        import numpy as np
        import pandas as pd

        for df in batches:
            out = []
            for _, g in df.groupby("block", sort=False):
                c = np.stack(g["c"].iloc[0]).astype(float)
                c /= np.linalg.norm(c, axis=1, keepdims=True)
                v = np.stack(g["v"]).astype(float)
                s = np.sort(v / np.linalg.norm(v, axis=1, keepdims=True) @ c.T, axis=1)[:, ::-1]
                out.append(pd.DataFrame({key: g[key].values, "s": list(s[:, : top_n or s.shape[1]])}))
            if out:
                yield pd.concat(out)

    kind = dict(vecs.dtypes)[key]
    tops = both.mapInPandas(top, f"{key} {kind}, s array<double>")
    merged = tops.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("s")), asc=False).alias("s"))
    merged = merged.withColumn("s", F.slice("s", 1, top_n)) if top_n else merged
    merged = merged.withColumn("mu", F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s"))
    sd = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + (x - F.col("mu")) * (x - F.col("mu"))) / F.size("s"))
    return merged.select(key, "mu", sd.alias("sd"))


def normalised_queries(queries: DataFrame, rows: DataFrame, places: int | None = None, counted: tuple[DataFrame, DataFrame] | None = None, key: str = "utt", spk: str = "spk", vec: str = "v") -> DataFrame:
    """B2 of every query against every other row: enroll, test, norm_score. Both sides carry their cohort's mu and sd, so pairs meet no join."""

    def normalise(c: Cell, s: slice, cos: np.ndarray) -> dict[str, np.ndarray]:
        mu, sd, nu, td = c.q["mu"][s, None], c.q["sd"][s, None], c.r["mu"], c.r["sd"]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 0.5 * ((cos - mu) / sd + (cos - nu) / td)
        return {"norm_score": np.ma.masked_array(out if places is None else rounded(out, places), (sd == 0) | (td == 0))}

    return query_pairs(queries, rows, {"norm_score": "double"}, cosines(normalise), "enroll test", key, spk, vec, ["mu", "sd"], counted=counted, by=None if places is None else "norm_score")


def query_factors(queries: DataFrame, rows: DataFrame, factors: list[str], caps: dict[str, float] | None = None, places: int | None = None, counted: tuple[DataFrame, DataFrame] | None = None, key: str = "utt", spk: str = "spk", by: str | None = None) -> DataFrame:
    """B3 of every query against every other row: those of calibration_factors' columns that factors names, without a join of pairs.

    Both sides carry the features, such as dur for dur_min, dur_max, dur_diff and dur_ratio. by is query_pairs'.
    """
    caps, features = caps or {}, sorted({f.rsplit("_", 1)[0] for f in factors})

    def value(kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if kind == "min" or kind == "max":
            return (np.minimum if kind == "min" else np.maximum)(a, b)
        if kind == "diff":
            return np.abs(a - b)
        lo = np.minimum(a, b)
        return np.ma.masked_array(np.maximum(a, b) / np.where(lo == 0, 1.0, lo), lo == 0)

    def kernel(c: Cell) -> Callable:
        # a factor of rounded minimum or maximum is a choice of rounded features
        own, others = ({n: np.minimum(t[n], caps.get(n, np.inf)) for n in features} for t in (c.q, c.r))

        def part(s: slice) -> dict[str, np.ndarray]:
            out = {}
            for f in factors:
                n, kind = f.rsplit("_", 1)
                a, b = own[n][s, None], others[n]
                if places is not None and kind in ("min", "max"):
                    out[f] = value(kind, rounded(a, places), rounded(b, places))
                else:
                    v = value(kind, a, b)
                    none = np.ma.getmask(v)
                    out[f] = v if places is None else np.ma.masked_array(rounded(np.ma.getdata(v), places), none) if none is not np.ma.nomask else rounded(np.ma.getdata(v), places)
            return out

        return part

    return query_pairs(queries, rows, dict.fromkeys(factors, "double"), kernel, "enroll test", key, spk, None, features, counted=counted, by=by)


def margins(c: Cell, s: slice, cos: np.ndarray, margin: float, scale: float, places: int) -> dict[str, np.ndarray]:
    """V.margin_logits of kinds am and aam for a cell's cosines: the margin is on the pairs of one speaker only, which are few."""
    am = rounded(scale * cos, places)
    aam = am.copy()
    target = (c.a[s, None] == c.b) & (c.b >= 0)
    t = cos[target]
    sin = np.sqrt(np.maximum(0.0, 1 - t * t))
    am[target] = rounded(scale * (t - margin), places)
    aam[target] = rounded(scale * np.where(t > math.cos(math.pi - margin), t * math.cos(margin) - sin * math.sin(margin), t - math.sin(math.pi - margin) * margin), places)
    return {"am": am, "aam": aam}


def normalise_scores(scores: DataFrame, enrol_stats: DataFrame, test_stats: DataFrame, key: str = "utt") -> DataFrame:
    """B2: 0.5 * ((s - mu_e) / sd_e + (s - mu_t) / sd_t); null where a deviation is 0."""
    e = enrol_stats.select(F.col(key).alias("enroll"), F.col("mu").alias("enroll_mu"), F.col("sd").alias("enroll_sd"))
    t = test_stats.select(F.col(key).alias("test"), F.col("mu").alias("test_mu"), F.col("sd").alias("test_sd"))
    s = F.col("score")
    norm = 0.5 * ((s - F.col("enroll_mu")) / F.nullif("enroll_sd", F.lit(0.0)) + (s - F.col("test_mu")) / F.nullif("test_sd", F.lit(0.0)))
    return scores.join(e, "enroll").join(t, "test").withColumn("norm_score", norm)


def calibration_factors(scores: DataFrame, features: DataFrame, columns: list[str], key: str = "utt", caps: dict[str, float] | None = None) -> DataFrame:
    """For each feature of both sides min, max, max - min and max / min; caps bound a feature first."""
    caps = caps or {}

    def side(name: str) -> DataFrame:
        return features.select(F.col(key).alias(name), *[(F.least(F.col(c), F.lit(caps[c])) if c in caps else F.col(c)).alias(f"_{name}_{c}") for c in columns])

    out = scores.join(side("enroll"), "enroll").join(side("test"), "test")
    for c in columns:
        lo, hi = F.least(f"_enroll_{c}", f"_test_{c}"), F.greatest(f"_enroll_{c}", f"_test_{c}")
        out = out.withColumns({f"{c}_min": lo, f"{c}_max": hi, f"{c}_diff": hi - lo, f"{c}_ratio": hi / F.nullif(lo, F.lit(0.0))})
    return out.drop(*[f"_{s}_{c}" for s in ("enroll", "test") for c in columns])


def fit_calibration(df: DataFrame, features: list[str], target: str = "target", steps: int = 50, gain: float = 1e-9) -> tuple[list[float], float]:
    """(weights, bias) that minimise the calibration cost; damped Newton steps on distributed sums.

    A step aggregates the cost, the gradient and the second derivatives of both classes, a row of (d + 1)**2 numbers.
    Steps that do not lower the cost are halved; the best weights met are returned. Without rows of either class
    the weights are the initial ones.
    """
    import numpy as np

    d = len(features)
    x = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((F.lit(float(a)) * c for a, c in zip(w, x, strict=True)), F.lit(0.0))
        y = F.when(F.col(target), 1.0).otherwise(-1.0)
        rows = df.select(F.col(target).alias("_t"), (y * z).alias("_m"), y.alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(x)])
        rows = rows.withColumn("_l", F.greatest(-F.col("_m"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_m")))).withColumn("_p", 1 / (1 + F.exp(F.col("_m"))))
        curve = F.col("_p") * (1 - F.col("_p"))
        sums = [F.avg("_l").alias("l")] + [F.avg(-F.col("_y") * F.col("_p") * F.col(f"_x{i}")).alias(f"g{i}") for i in range(d + 1)]
        sums += [F.avg(curve * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"h{i}_{j}") for i in range(d + 1) for j in range(i, d + 1)]
        got = rows.where("_t is not null").groupBy("_t").agg(*sums).collect()
        if len(got) < 2:
            return 0.0, np.zeros(d + 1), np.eye(d + 1)
        g = np.array([sum(r[f"g{i}"] for r in got) / 2 for i in range(d + 1)])
        h = np.array([[sum(r[f"h{min(i, j)}_{max(i, j)}"] for r in got) / 2 for j in range(d + 1)] for i in range(d + 1)])
        return sum(r["l"] for r in got) / 2, g, h

    w = np.r_[np.full(d, 1.0 / max(1, d)), 0.0]
    cost, g, h = evaluate(w)
    for _ in range(steps):
        step, size = np.linalg.solve(h + 1e-9 * np.eye(d + 1), g), 1.0
        tried = evaluate(w - step)
        while tried[0] > cost and size > 1e-6:
            size /= 2
            tried = evaluate(w - size * step)
        if tried[0] > cost:
            break
        better = cost - tried[0]
        w, (cost, g, h) = w - size * step, tried
        if better < gain:
            break
    return w[:-1].tolist(), float(w[-1])


def apply_linear(df: DataFrame, features: list[str], weights: list[float], bias: float, out: str = "calibrated") -> DataFrame:
    """Weighted sum of features plus bias."""
    return df.withColumn(out, sum((F.lit(float(w)) * F.col(f) for w, f in zip(weights, features, strict=True)), F.lit(float(bias))))


def rank_gallery(scores: DataFrame, trial: str, score_col: str = "score", tie: str = "spk") -> DataFrame:
    """Rank of each gallery entry within its trial, from 1, by descending score and then tie."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(trial).orderBy(F.desc(score_col), tie)))


def best_speaker(scores: DataFrame, key: str, spk: str = "spk", score_col: str = "score", threshold: float | None = None) -> DataFrame:
    """The best speaker of each key (ties: the smaller name), dropped if its score is below the threshold."""
    m = scores.groupBy(key).agg(F.min(F.struct((-F.col(score_col)).alias("s"), spk)).alias("m"))
    out = m.select(key, F.col(f"m.{spk}").alias(spk), (-F.col("m.s")).alias(score_col))
    return out if threshold is None else out.where(F.col(score_col) >= threshold)


def register(gallery: DataFrame, new: DataFrame, spk: str = "spk") -> DataFrame:
    """The gallery with those new entries whose speaker it does not have."""
    return gallery.unionByName(new.join(gallery.select(spk), spk, "left_anti"))


def gallery_scores(trials: DataFrame, enrolments: DataFrame, vecs: DataFrame, strategy: str = "mean", key: str = "utt", vec: str = "v") -> DataFrame:
    """Trial, spk, score of a probe against each gallery speaker.

    trials has trial and probe; enrolments has trial, spk and utt. mean: cosine to the mean of the enrolment
    vectors; max: the best of their cosines.
    """
    v = vecs.select(F.col(key), V.as_double(F.col(vec)).alias("_v"))
    probe = trials.join(v.withColumnRenamed(key, "probe").withColumnRenamed("_v", "_p"), "probe").select("trial", V.l2_normalise(F.col("_p")).alias("_p"))
    enrolled = enrolments.join(v.withColumnRenamed(key, "utt"), "utt")
    if strategy == "mean":
        side = mean_vectors(enrolled.withColumnRenamed("_v", "v"), ["trial", "spk"]).select("trial", "spk", V.l2_normalise(F.col("v")).alias("_g"))
        return side.join(probe, "trial").select("trial", "spk", V.dot(F.col("_p"), F.col("_g")).alias("score"))
    each = enrolled.select("trial", "spk", V.l2_normalise(F.col("_v")).alias("_g")).join(probe, "trial")
    return each.groupBy("trial", "spk").agg(F.max(V.dot(F.col("_p"), F.col("_g"))).alias("score"))


def hard_negatives(scores: DataFrame, key: str, own: Column, k: int, tie: str) -> DataFrame:
    """T4: the k best rows of other classes for each key."""
    return scores.where(~own).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), tie))).where(F.col("rank") <= k)
