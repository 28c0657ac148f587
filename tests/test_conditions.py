"""Error rates by condition from counts of equal scores, against the sweep over single trials."""

import random

import pytest

from vecspan.operators import metrics as M


def test_metrics_of_tied_scores(spark):
    """99 of 100 scores are equal in one condition; others have few trials, one kind only, or a null name."""
    r = random.Random(2)
    rows = [("tied", k, 0.5 if k % 100 else r.random(), k % 3 == 0) for k in range(3000)]
    rows += [(None, k, float(r.randrange(6)), r.random() < 0.4) for k in range(200)] + [("apart", k, k + 10.0 * (k % 2), k % 2 == 1) for k in range(20)]
    rows += [("one", 1, 0.1, True), ("none", 1, 0.1, False), ("two", 1, 0.3, True), ("two", 2, 0.3, False), ("wrong", 1, 0.1, True), ("wrong", 2, 0.9, False)]
    df = spark.createDataFrame(rows, "cond string, key int, score double, target boolean").repartition(3)
    got = {x["cond"]: x for x in M.metrics_by_condition(df, "cond", ["key"]).collect()}
    assert set(got) == {x[0] for x in rows}
    for cond in got:
        own = df.where(df["cond"].eqNullSafe(cond))
        assert got[cond]["n"] == own.count()
        sweep = M.det_sweep(own, ["key"], buckets=4)
        if cond in ("one", "none"):
            assert got[cond]["eer"] is None and got[cond]["min_dcf"] is None
            continue
        assert got[cond]["eer"] == pytest.approx(M.eer(sweep).first()["eer"], abs=1e-9), cond
        assert got[cond]["min_dcf"] == pytest.approx(M.min_dcf(sweep).first()["min_dcf"], abs=1e-9), cond


def test_one_plan_for_all_conditions(spark):
    df = spark.createDataFrame([(c, k, float(k), k % 2 == 0) for c in range(30) for k in range(4)], "cond int, key int, score double, target boolean")
    plan = M.metrics_by_condition(df, "cond", ["key"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("LogicalRDD") <= 4
