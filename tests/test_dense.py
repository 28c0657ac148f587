"""Points and intervals of one busy recording: as plain loops over all pairs, in plans that make none."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vecspan.operators import intervals as I


def _tables(spark, seed, n=120):
    r = random.Random(seed)
    iv = [(r.choice([1, 1, 1, 2, None]), b, b + r.choice([0, 0, 1, 3, 9, 40]), r.choice(["x", "y", None])) for b in (r.randrange(-30, 90) for _ in range(n))]
    pt = [(i, r.choice([1, 1, 2, 3, None]), r.choice([None, *range(-35, 130)])) for i in range(n)] * 2
    return iv, pt, spark.createDataFrame(iv, "rec int, b long, e long, label string"), spark.createDataFrame(pt, "id int, rec int, t long")


@pytest.mark.parametrize("seed", range(3))
def test_label_at(spark, seed):
    iv, pt, intervals, points = _tables(spark, seed)
    key = lambda x: (x[1], x[2], x[3] is not None, x[3] or "")
    want = []
    for i, rec, t in pt:
        found = sorted((x for x in iv if None not in (rec, t) and x[0] == rec and x[1] <= t <= x[2]), key=key)
        want.append((i, rec, t, found[0][3] if found else None))
    got = [tuple(r) for r in I.label_at(points, intervals, ["rec"], rows=15).select("id", "rec", "t", "label").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_active_at(spark, seed):
    iv, pt, intervals, points = _tables(spark, seed)
    want = {(i, rec, t, x[3]) for i, rec, t in pt for x in iv if None not in (rec, t) and x[0] == rec and x[1] <= t < x[2]}
    got = [tuple(r) for r in I.active_at(points, intervals, ["rec"], rows=15).select("id", "rec", "t", "label").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed,reverse", [(0, False), (1, False), (2, True)])
def test_overlap_totals(spark, seed, reverse):
    iv, _, _, _ = _tables(spark, seed)
    iv = iv + [(1, 50, 44, "x"), (1, 7, 3, "z")] * reverse
    intervals = spark.createDataFrame(iv, "rec int, b long, e long, label string")
    want = defaultdict(int)
    for p in iv:
        for q in ((x[0], x[1] + 3, x[2] + 5, x[3]) for x in iv):
            if p[0] is not None and p[0] == q[0] and p[1] < q[2] and q[1] < p[2]:
                want[p[0], p[3], q[3]] += min(p[2], q[2]) - max(p[1], q[1])
    got = I.overlap_totals(intervals, intervals.withColumn("b", F.col("b") + 3).withColumn("e", F.col("e") + 5), ["rec"], rows=15).collect()
    assert {(r["rec"], r["label_a"], r["label_b"]): r["overlap"] for r in got} == dict(want) and len(got) == len(want)


def test_work_grows_with_the_rows(spark):
    """2,000 intervals of one recording that all overlap: the rows that joins give stay near the input's, not its square."""
    iv = spark.range(2000).select("id", F.lit(1).alias("rec"), F.col("id").alias("b"), (F.col("id") + 5000).alias("e"), (F.col("id") % 3).cast("string").alias("label"))
    points = iv.select("id", "rec", (F.col("b") + 500).alias("t"))
    for df in (I.label_at(points, iv, ["rec"]), I.active_at(points, iv, ["rec"]), I.overlap_totals(iv, iv, ["rec"])):
        df.collect()
        seen, rows, plans = set(), [], [df._jdf.queryExecution().executedPlan()]
        while plans:
            p = plans.pop()
            if p.nodeName() == "AdaptiveSparkPlan":
                p = p.executedPlan()
            if p.nodeName().endswith("QueryStage"):
                p = p.plan()
            if p.id() not in seen:
                seen.add(p.id())
                rows += [p.metrics().apply("numOutputRows").value()] if p.metrics().contains("numOutputRows") else []
                plans += [p.children().apply(k) for k in range(p.children().size())]
        assert rows and max(rows) <= 4 * 2000 * 3


def test_hold_filter_has_no_rounds(spark):
    """A recording whose class turns many times: as few jobs as one that does not turn."""
    from vecspan.operators.speech import hold_filter

    for name, width in (("many turns", 2), ("no turn", 5000)):
        df = spark.range(3000).select(F.lit(1).alias("rec"), F.col("id").alias("frame"), F.floor(F.col("id") / width).cast("int").alias("cls"))
        spark.sparkContext.setJobGroup(name, name)
        assert hold_filter(df, ["rec"], hold=1, rows=300).count() == 3000
    jobs = [len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)) for name in ("many turns", "no turn")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] <= 12
