"""Every query against every row: odd vectors against plain Python, plans without pairs in a shuffle, metrics against the sweep."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA
from vecspan.functions import vectors as V
from vecspan.operators import metrics as M
from vecspan.operators import scoring as S
from vecspan.plans import catalog

ODD = [(0, 1, [1.0, 0.0]), (1, 1, [3.0, 4.0]), (2, None, [1.0, 1.0]), (3, 2, [0.0, 0.0]), (4, 2, None), (5, 2, [1.0, None]), (6, 1, [1.0]), (50, 2, [0.0, 2.0]), (100, None, [2.0, 0.0])]


def _cosine(x, y):
    if x is None or y is None or len(x) != len(y) or None in x or None in y:
        return None
    n = math.dist(x, [0] * len(x)) * math.dist(y, [0] * len(y))
    return round(sum(a * b for a, b in zip(x, y)) / n, 6) if n else None


def test_odd_vectors(spark):
    df = spark.createDataFrame(ODD, "utt long, spk int, v array<double>")
    got = {(r["enroll"], r["test"]): (r["target"], r["score"]) for r in S.score_queries(df.where("utt % 50 = 0"), df, places=6).collect()}
    want = {(a, b): (None if s is None or t is None else s == t, _cosine(x, y)) for a, s, x in ODD for b, t, y in ODD if a % 50 == 0 and a != b}
    assert got == want
    best = {(r["enroll"], r["spk"]): r["score"] and round(r["score"], 6) for r in S.best_scores(df.where("utt % 50 = 0"), df).collect()}
    for (a, s), x in best.items():
        scores = [_cosine(q[2], r[2]) for q in ODD for r in ODD if q[0] == a != r[0] and r[1] == s]
        assert x == max((c for c in scores if c is not None), default=None)
    assert set(best) == {(a, t) for a, _, _ in ODD for b, t, _ in ODD if a % 50 == 0 and a != b}


@pytest.mark.parametrize("name", ["b10_plda_scores", "v09_plda_llr", "v03_cosine", "v05_dot_magnitude", "v10_angles", "m05_margin_logits", "b01_cosine_scoring", "b02_asnorm", "b02_snorm", "b03_calibration_factors"])
def test_pairs_meet_no_shuffle(spark, name):
    """What the pairs' task gives is final: no join, exchange or expression comes after it."""
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    top = [line.strip(" :+-") for line in plan.splitlines() if "AdaptiveSparkPlan" not in line]
    assert top[0].startswith("FlatMapCoGroupsInArrow") or (top[0].startswith("Project") and top[1].startswith("FlatMapCoGroupsInArrow"))


def test_margins_are_the_column_function(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, r.randrange(3), [r.gauss(0, 1) for _ in range(4)]) for i in range(60)], "utt long, spk int, v array<double>")
    q = df.where("utt % 5 = 0")
    got = S.query_pairs(q, df, {"c": "double", "am": "double", "aam": "double"}, S.cosines(lambda c, s, cos: {"c": cos, **S.margins(c, s, cos, 0.2, 32.0, 4)}), "target")
    for kind in ("am", "aam"):
        assert got.where(F.abs(F.col(kind) - V.margin_logits(F.col("c"), F.col("target"), kind, 0.2, 32.0)) > 0.000051).isEmpty()


@pytest.mark.parametrize("seed,places", [(1, 9), (2, 1), (3, 0), (4, 2)])
def test_query_metrics_are_those_of_the_sweep(spark, seed, places):
    """Few and many equal scores, in bins of all sizes, against the sweep over rows of pairs."""
    r = random.Random(seed)
    df = spark.createDataFrame([(i, i % 4, [r.gauss(i % 4 == k, 0.7) for k in range(4)]) for i in range(240)], "utt long, spk int, v array<double>")
    q = df.where("utt % 5 = 0")
    sweep = M.det_sweep(S.score_queries(q, df, places=places), ["enroll", "test"])
    want = M.eer(sweep).first()["eer"], M.min_dcf(sweep).first()["min_dcf"]
    for bins in (2, 64, 4096):
        got = M.query_metrics(q, df, places, bins=bins).first()
        assert [got["n"], round(got["eer"], 9), round(got["min_dcf"], 9)] == [48 * 239, *[round(x, 9) for x in want]]


@pytest.mark.parametrize("same", [None, True, False])
@pytest.mark.parametrize("on", [[], ["rec"]])
def test_pairs_of_blocks(spark, same, on):
    """Blocks smaller than a speaker, against loops; keys, speakers and groups may be null, and keys repeat."""
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([f"u{i}", f"u{i}", f"u{i // 2}", None]), r.choice([1, 1, 1, 2, None])) for i in range(90)]
    want = []
    for g, x, s in rows:
        for h, y, t in rows:
            target = None if s is None or t is None else s == t
            if x and y and x < y and (not on or g and g == h) and (same is None or target is same):
                want.append((*([g] if on else []), x, y, target))
    out = S.pairs(spark.createDataFrame(rows, "rec string, utt string, spk int"), "utt", "spk", same, on, block=7)
    assert sorted((tuple(x) for x in out.collect()), key=str) == sorted(want, key=str)
    assert out.columns == [*on, "enroll", "test", "target"]


@pytest.mark.parametrize("by,most", [("cos", 9.5), (None, 16.5)])
def test_pairs_are_small_as_parquet(spark, tmp_path, by, most):
    """Two scores of a pair take 16 bytes; keys beside them cost little, and rounded scores in order far less than their bytes (17.2 in all before)."""
    df = spark.range(3000).selectExpr("id AS utt", "cast(id % 10 AS int) AS spk", "transform(sequence(1, 64), i -> randn(7) + cast(hash(id, i) AS double) / 2147483648) AS v")
    kernel = S.cosines(lambda c, s, cos: {"cos": S.rounded(cos, 6), "cos01": S.rounded((cos + 1) / 2, 6)} if by else {"cos": cos, "cos01": (cos + 1) / 2})
    S.query_pairs(df.where("utt % 3 = 0"), df, {"cos": "double", "cos01": "double"}, kernel, by=by).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 1000 * 2999
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) / (1000 * 2999) < most


@pytest.mark.parametrize("strip", [7, 90, 1 << 23])
def test_strips_of_ordered_pairs(spark, strip):
    """Every pair is there once, whatever the strips: null scores and the queries' own rows included."""
    r = random.Random(4)
    rows = [(i, r.choice([1, 2, None]), r.choice([None, [0.0, 0.0], [r.gauss(0, 1), r.gauss(0, 1)], [r.gauss(0, 1), r.gauss(0, 1)]])) for i in range(90)]
    df = spark.createDataFrame(rows, "utt long, spk int, v array<double>")
    for by in ("score", None):
        got = S.query_pairs(df.where("utt < 70"), df, {"score": "double"}, S.cosines(places=6), "enroll test target", by=by, strip=strip).collect()
        want = {(a, b): (None if s is None or t is None else s == t, _cosine(x, y)) for a, s, x in rows for b, t, y in rows if a < 70 and a != b}
        assert len(got) == len(want) and {(x["enroll"], x["test"]): (x["target"], x["score"]) for x in got} == want


def test_all_pairs_are_small_as_parquet(spark, tmp_path):
    """Keys of all pairs are runs and repeats in the file, not a number for each pair (0.58 bytes a pair before)."""
    df = spark.range(3000).selectExpr("id * 7 AS utt", "cast(id % 25 AS int) AS spk")
    out = S.pairs(df, "utt", "spk", block=1000)
    out.write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs")
    assert got.where("enroll < test").distinct().count() == got.count() == 3000 * 2999 // 2
    assert got.where("target").count() == 25 * 120 * 119 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) / (3000 * 2999 // 2) < 0.4
