"""Error rates of scored trials and identification accuracy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspan.operators import scoring
from vecspan.plans.prefix import range_bucket, running_sums
from vecspan.sources.storage import kept


def det_sweep(df: DataFrame, key: list[str], score: str = "score", target: str = "target", weight: Column | None = None, buckets: int = 64) -> DataFrame:
    """Columns of df with pos (from 1), fnr, fpr after each trial in the order of score, non-targets first, key.

    Scores are dealt into quantile ranges; each range is sorted in its own task and ranges are joined by
    their totals, so no task sees all trials.
    """
    weight = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.withColumn("_w", weight)
    rows = range_bucket(rows, score, buckets, "_b")
    t = F.col(target).cast("int")
    order = [F.col(score), t, *[F.col(k) for k in key]]
    out = running_sums(rows, "_b", order, {"pos": F.lit(1), "_t": t * F.col("_w"), "_n": (1 - t) * F.col("_w")})
    total = rows.agg(F.sum(t * F.col("_w")).alias("t"), F.sum((1 - t) * F.col("_w")).alias("n")).first()
    fnr = F.col("_t") / F.nullif(F.lit(float(total["t"] or 0)), F.lit(0.0))
    fpr = 1 - F.col("_n") / F.nullif(F.lit(float(total["n"] or 0)), F.lit(0.0))
    return out.withColumn("fnr", fnr).withColumn("fpr", fpr).drop("_w", "_b", "_t", "_n")


def eer(sweep: DataFrame, score: str = "score") -> DataFrame:
    """Eer and threshold, interpolated where fnr - fpr changes sign; null if it never does."""
    d = F.col("fnr") - F.col("fpr")
    ends = sweep.agg(
        F.min(F.when(d >= 0, F.struct("pos", "fnr", "fpr", F.col(score).alias("s")))).alias("x1"),
        F.max(F.when(d < 0, F.struct("pos", "fnr", "fpr", F.col(score).alias("s")))).alias("x2"),
    )
    a = (F.col("x1.fnr") - F.col("x1.fpr")) / (F.col("x2.fpr") - F.col("x1.fpr") - (F.col("x2.fnr") - F.col("x1.fnr")))
    return ends.select((F.col("x1.fnr") + a * (F.col("x2.fnr") - F.col("x1.fnr"))).alias("eer"), F.col("x1.s").alias("threshold"))


def min_dcf(sweep: DataFrame, p_target: float = 0.01, c_miss: float = 1.0, c_fa: float = 1.0) -> DataFrame:
    """Least detection cost, raw and divided by the cost of a system that does not look."""
    cost = c_miss * p_target * F.col("fnr") + c_fa * (1 - p_target) * F.col("fpr")
    return sweep.agg(F.min(cost).alias("min_dcf_raw")).withColumn("min_dcf", F.col("min_dcf_raw") / min(c_miss * p_target, c_fa * (1 - p_target)))


def cllr(df: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """Cost of log-likelihood ratios."""
    s = F.col(score)
    tar = F.avg(F.when(F.col(target), F.log1p(F.exp(-s))))
    non = F.avg(F.when(~F.col(target), F.log1p(F.exp(s))))
    return df.agg(((tar + non) / (2 * math.log(2))).alias("cllr"))


def top_k_accuracy(ranked: DataFrame, ks: list[int], trial: str = "trial", true: str = "true_spk", spk: str = "spk") -> DataFrame:
    """Share of closed-set trials whose speaker ranks within k; 0 without such trials."""
    hit = ranked.groupBy(trial).agg(F.min(F.when(F.col(spk) == F.col(true), F.col("rank"))).alias("at"))
    closed = F.count("at")
    return hit.agg(F.count("*").alias("num_trials"), closed.alias("num_closed_set"), (F.count("*") - closed).alias("num_open_set"), *[F.coalesce(F.avg(F.when(F.col("at").isNotNull(), (F.col("at") <= k).cast("double"))), F.lit(0.0)).alias(f"top_{k}") for k in ks])


def confusion(df: DataFrame, true: str = "true_spk", pred: str = "pred") -> DataFrame:
    """Counts of (true, predicted)."""
    return df.groupBy(true, pred).agg(F.count("*").alias("n"))


def most_confused(counts: DataFrame, n: int, true: str = "true_spk", pred: str = "pred") -> DataFrame:
    """The n largest off-diagonal counts with their row totals."""
    total = F.sum("n").over(Window.partitionBy(true))
    return counts.withColumn("row_total", total).where(F.col(true) != F.col(pred)).orderBy(F.desc("n"), true, pred).limit(n)


def equalised_weights(df: DataFrame, cond: str, target: str = "target") -> DataFrame:
    """Within target and non-target trials, conditions weigh the largest count over their own."""
    counts = df.groupBy(target, cond).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("weight", F.max("_n").over(Window.partitionBy(target)) / F.col("_n")).drop("_n")
    return df.join(counts, [target, cond])


def histogram_rates(df: DataFrame, bins: int = 1000, score: str = "score", target: str = "target") -> DataFrame:
    """Per bin of the score range, cumulative miss rate and false alarm rate."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    lo, hi = float(ends["lo"] or 0), float(ends["hi"] or 0)
    b = F.least(F.lit(bins - 1), F.floor((F.col(score) - lo) / max(hi - lo, 1e-300) * bins)).cast("int")
    t = F.col(target).cast("int")
    per = df.groupBy(b.alias("bin")).agg(F.sum(t).alias("t"), F.sum(1 - t).alias("n"))
    w, whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per.select("bin", (F.sum("t").over(w) / F.sum("t").over(whole)).alias("miss"), (1 - F.sum("n").over(w) / F.sum("n").over(whole)).alias("false_alarm"))


def sweep_table(df: DataFrame, rows: list[str], column: str, value: str) -> DataFrame:
    """A row per combination of rows, a column per value of column."""
    return df.groupBy(*rows).pivot(column).agg(F.first(value))


def probit(p: Column) -> Column:
    """Normal quantile by Acklam's rational approximation (fixed coefficients)."""
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]

    def poly(co: list[float], x: Column) -> Column:
        out = F.lit(co[0])
        for k in co[1:]:
            out = out * x + k
        return out

    def tail(q: Column) -> Column:
        return poly(c, q) / (poly(d, q) * q + 1)

    mid = p - 0.5
    r = mid * mid
    centre = poly(a, r) * mid / (poly(b, r) * r + 1)
    return F.when(p < 0.02425, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - 0.02425, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(centre)


def score_counts(df: DataFrame, condition: str, score: str = "score", target: str = "target", rows: int = 50_000) -> DataFrame:
    """Of every condition and score: targets and non-targets there (t, u), below (t0, u0) and in all (nt, nu).

    Equal scores are counted before anything is sorted, so ties of any size are one row. Scores are dealt into ranges
    of about `rows` of them, each is sorted in its own task, for all conditions at once. Trials without a score are left out.
    """
    t = F.col(target).cast("int")
    cells = df.where(F.col(score).isNotNull()).groupBy(F.struct(condition).alias("_c"), F.col(score).cast("double").alias("_score"))
    cells = cells.agg(F.sum(t).alias("t"), F.sum(1 - t).alias("u"))
    cells = range_bucket(cells, "_score", max(1, -(-cells.count() // rows)), "_b")
    run = running_sums(cells, "_b", ["_score"], {"t0": F.col("t"), "u0": F.col("u")}, ["_c"])
    total = cells.groupBy("_c").agg(F.sum("t").alias("nt"), F.sum("u").alias("nu"))
    run = run.withColumns({"t0": F.col("t0") - F.col("t"), "u0": F.col("u0") - F.col("u")})
    return run.join(total, "_c").select(F.col(f"_c.{condition}").alias(condition), F.col("_score").alias(score), "t", "u", "t0", "u0", "nt", "nu")


def metrics_by_condition(df: DataFrame, condition: str, key: list[str], score: str = "score", target: str = "target", p_target: float = 0.01, c_miss: float = 1.0, c_fa: float = 1.0) -> DataFrame:
    """Condition, n, eer, min_dcf of every condition's trials, as W10 to W12 give them, in one plan for all conditions.

    Along the trials of one score, non-targets first, the rates change evenly, so the trials at which the miss rate
    passes the false alarm rate, and those of least cost, follow from the counts. key orders trials that are alike, on
    which nothing depends. Conditions without targets or non-targets have null metrics.
    """
    return metrics_of_counts(score_counts(df, condition, score, target), condition, p_target, c_miss, c_fa)


def metrics_of_counts(c: DataFrame, condition: str, p_target: float = 0.01, c_miss: float = 1.0, c_fa: float = 1.0, exact: Column | None = None) -> DataFrame:
    """metrics_by_condition of score_counts' rows. Rows that are not exact hold many scores in one, of which only the last trial is looked at,
    and not for the cost: the scores at which the rates cross and the cost is least must be rows of their own."""
    exact = F.lit(True) if exact is None else exact
    t, u, t0, u0, nt, nu = (F.col(x) for x in ("t", "u", "t0", "u0", "nt", "nu"))

    def at(targets: Column, others: Column) -> Column:
        return F.struct((t0 + targets + u0 + others).alias("pos"), ((t0 + targets) / F.nullif(nt, F.lit(0))).alias("fnr"), (1 - (u0 + others) / F.nullif(nu, F.lit(0))).alias("fpr"))

    # the first trial of this score at which fnr >= fpr: among its non-targets, or else among its targets
    others = F.greatest(F.ceil((nu * (nt - t0) - u0 * nt) / F.nullif(nt, F.lit(0))), F.lit(1)).cast("long")
    targets = F.greatest(F.ceil(((nu - u0 - u) * nt - t0 * nu) / F.nullif(nu, F.lit(0))), F.lit(1)).cast("long")
    whole = (nt > 0) & (nu > 0)
    first = F.when(whole & (u > 0) & (others <= u), at(F.lit(0), others)).when(whole & (t > 0) & (targets <= t), at(targets, u))
    low = F.when(~whole, None).when((u > 0) & (others <= u), F.when(others > 1, at(F.lit(0), others - 1)))
    low = low.when((t > 0) & (targets <= t), F.when(targets > 1, at(targets - 1, u)).when(u > 0, at(F.lit(0), u))).otherwise(at(t, u))
    least = F.when(u > 0, at(F.lit(0), u)).otherwise(at(F.lit(1), F.lit(0)))
    cost = (c_miss * p_target * least["fnr"] + c_fa * (1 - p_target) * least["fpr"]) / min(c_miss * p_target, c_fa * (1 - p_target))
    ends = c.groupBy(condition).agg(F.sum(t + u).alias("n"), F.min(F.when(exact, first)).alias("x1"), F.max(low).alias("x2"), F.min(F.when(exact, cost)).alias("min_dcf"))
    a = (F.col("x1.fnr") - F.col("x1.fpr")) / (F.col("x2.fpr") - F.col("x2.fnr") - (F.col("x1.fpr") - F.col("x1.fnr")))
    return ends.select(condition, "n", (F.col("x1.fnr") + a * (F.col("x2.fnr") - F.col("x1.fnr"))).alias("eer"), "min_dcf")


def query_metrics(queries: DataFrame, rows: DataFrame, places: int = 9, p_target: float = 0.01, c_miss: float = 1.0, c_fa: float = 1.0, bins: int = 4096, key: str = "utt", spk: str = "spk", vec: str = "v") -> DataFrame:
    """W11, W12 of the rounded cosines of every query against every other row: n, eer, min_dcf, exact, without a row per pair.

    Pairs are counted by bins of the score in the tasks that score them. The bin in which the rates cross is known then, and so are
    the bins whose cost can't be the least (by the miss rate at their begin and the false alarm rate at their end). Only
    the pairs of the others are scored once more and counted by score. Scores that are null come last.
    """

    def tally(wanted: np.ndarray | None):
        def run(c) -> list:
            import pyarrow as pa

            u, w = c.units()
            total, scores, targets = np.zeros(2 * (bins + 1), np.int64), [], []
            for start in range(0, len(c.a), step := max(1, (1 << 16) // len(c.b))):
                part = slice(start, start + step)
                s = scoring.rounded(u[part] @ w.T, places)
                s[np.isnan(s)] = 2.0
                if c.apart is not None:
                    s[c.apart[part]] = 3.0
                at = np.where(s > 1.5, bins, np.clip((s + 1) * (bins / 2), 0, bins - 1)).astype(np.int64)
                target = c.a[part, None] == c.b
                valid = (c.a[part, None] >= 0) & (c.b >= 0)
                valid = valid if c.same is None else valid & ~c.same[part]
                if wanted is None:
                    total += np.bincount((2 * at + target)[valid], minlength=2 * (bins + 1))
                else:
                    valid &= wanted[at]
                    scores.append(s[valid])
                    targets.append(target[valid])
            if wanted is None:
                found = np.flatnonzero(total.reshape(-1, 2).any(axis=1))
                cells = total.reshape(-1, 2)[found]
            else:
                found, of = np.unique(np.concatenate(scores), return_inverse=True)
                hit = np.concatenate(targets)
                cells = np.stack([np.bincount(of[~hit], minlength=len(found)), np.bincount(of[hit], minlength=len(found))], axis=1).astype(np.int64)
            return [pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.ascontiguousarray(cells[:, 1])), pa.array(np.ascontiguousarray(cells[:, 0]))], ["at", "t", "u"])]

        return run

    def counted(wanted: np.ndarray | None) -> DataFrame:
        kind = "long" if wanted is None else "double"
        cells = scoring.query_cells(queries, rows, tally(wanted), f"at {kind}, t long, u long", key, spk, vec)
        return cells.groupBy("at").agg(F.sum("t").alias("t"), F.sum("u").alias("u"))

    got = sorted(counted(None).collect())  # a row per bin
    at, t, u = (np.array([r[k] for r in got], np.int64) for k in range(3))
    nt, nu = int(t.sum()), int(u.sum())
    wanted = np.zeros(bins + 1, bool)
    if nt and nu:
        fnr, fpr = t.cumsum() / nt, 1 - u.cumsum() / nu
        cost = lambda miss, alarm: c_miss * p_target * miss + c_fa * (1 - p_target) * alarm
        lowest = cost(fnr - t / nt, fpr)
        wanted[at[lowest <= cost(fnr, fpr).min() * (1 + 1e-9) + 1e-12]] = True
        # one bin more on either side, should the rates be equal at a bin's end but for the last digit
        wanted[at[np.abs(np.arange(len(at)) - np.argmax(fnr >= fpr)) <= 1]] = True
    spark = queries.sparkSession
    rest = [(float((a + 0.5) * 2 / bins - 1 if a < bins else 2.5), int(x), int(y), False) for a, x, y in zip(at, t, u) if not wanted[a]]
    cells = counted(wanted).withColumn("exact", F.lit(True)).unionByName(spark.createDataFrame(rest, "at double, t long, u long, exact boolean"))
    cells = kept(cells, "score_counts")
    cells = range_bucket(cells, "at", max(1, -(-cells.count() // 50_000)), "_b")
    run = running_sums(cells, "_b", ["at"], {"t0": F.col("t"), "u0": F.col("u")})
    run = run.withColumns({"t0": F.col("t0") - F.col("t"), "u0": F.col("u0") - F.col("u"), "nt": F.lit(nt).cast("long"), "nu": F.lit(nu).cast("long"), "all": F.lit(0)})
    return metrics_of_counts(run, "all", p_target, c_miss, c_fa, F.col("exact")).drop("all")
