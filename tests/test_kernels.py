import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspan.functions import vectors as V
from vecspan.operators import backends as B
from vecspan.operators import chain, clustering as C, intervals as I, metrics as M, scoring as S, signal as G


@pytest.mark.parametrize(
    "least, durations, groups",
    [
        (0.1, [5, 6, 7], [(0, 1), (1, 2), (2, 3)]),
        (0.5, [0.1, 6, 7], [(0, 2), (2, 3)]),
        (0.5, [6, 7, 0.1], [(0, 1), (1, 3)]),
        (0.5, [6, 0.1, 7], [(0, 2), (2, 3)]),
        (0.5, [7, 0.1, 6], [(0, 2), (2, 3)]),
        (1.0, [1.0, 0.5, 0.1, 6.0], [(0, 3), (3, 4)]),
    ],
)
def test_balance_goldens(least, durations, groups):
    assert C.balance_durations([float(d) for d in durations], least) == groups


def test_balance_properties():
    r = random.Random(1)
    for _ in range(100):
        d = [r.uniform(0.01, 3) for _ in range(r.randint(1, 20))]
        groups = C.balance_durations(d, 1.5)
        assert [i for s, e in groups for i in range(s, e)] == list(range(len(d)))
        assert len(groups) == 1 or all(sum(d[s:e]) >= 1.5 - 1e-4 for s, e in groups)
        assert C.balance_durations([x + r.uniform(-1e-7, 1e-7) for x in d], 1.5) == groups


def test_assignment_against_brute_force():
    r = np.random.default_rng(0)
    for _ in range(60):
        n, m = (int(k) for k in r.integers(1, 6, 2))
        g = r.integers(0, 9, (n, m)).astype(float)
        pairs = C.best_assignment(g)
        k = min(n, m)
        best = max(sum(g[i, j] for i, j in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert len(pairs) == k and math.isclose(sum(g[i, j] for i, j in pairs), best)


def test_clusters_of_separate_blobs():
    r = np.random.default_rng(2)
    centres = np.eye(8)[:3] * 10
    x = np.vstack([c + r.normal(0, 0.1, (12, 8)) for c in centres])
    want = np.repeat([0, 1, 2], 12)
    assert (C.spectral(x) == want).all()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (C.average_linkage(1 - u @ u.T, 0.5) == want).all()
    online = C.OnlineClusters(0.5, 10)
    assert [online.add(v)[0] for v in x] == want.tolist()
    assert (C.absorb_small(x, np.where(np.arange(36) % 12 < 6, want, -1)) == want).all()
    assert C.spectral(x[:2]).tolist() == [0, 0]


def test_state_machines():
    assert C.hold_filter([0, 1, 0, 1, 1, 1, 1], 2) == [0, 0, 0, 0, 0, 1, 1]
    assert C.hysteresis([0, 0.9, 0.9, 0.9, 0.1, 0.1, 0.1, 0.9], silence=2, speech=2) == [(1, 4), (7, 8)]
    assert C.hysteresis([0, 0.9, 0.9, 0.9, 0.1, 0.1, 0.1, 0.9], silence=2, speech=3) == [(7, 8)]  # longer than `speech`; the open one stays
    assert C.hysteresis([0.9] * 4 + [0.1, 0.4, 0.4, 0.9, 0.9], silence=2, speech=3) == [(0, 9)]  # frames between off and on end nothing
    assert C.hysteresis([0, 0.9, 0.9, 0.9, 0.1, 0.1, 0.1, 0.9], silence=2, speech=2, pad=2) == [(0, 5), (6, 8)]
    assert C.hysteresis([0, 0.9, 0.9, 0.9, 0.1, 0.1, 0.1, 0.9], silence=2, speech=2, least=2) == [(1, 4)] and C.hysteresis([]) == []
    assert C.best_subset(np.array([[1, 0.9, 0], [0.9, 1, 0.1], [0, 0.1, 1]]), 2) == (0, 1)


def test_signal_kernels():
    t = np.arange(16000) / 16000
    x = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    feat = G.log_mel(x, 16000)
    assert feat.shape == (98, 80) and abs(int(feat.mean(axis=0).argmax()) - int(G.log_mel(x[:8000], 16000).mean(axis=0).argmax())) <= 1
    assert len(G.resample(x, 16000, 8000)) == 8000
    assert np.allclose(G.envelope(x, 16000), math.sqrt(0.5), atol=0.02)
    noisy = G.mix_at_snr(x, np.random.default_rng(0).normal(size=100), 10)
    assert abs(10 * math.log10(np.mean(x**2) / np.mean((noisy - x) ** 2)) - 10) < 0.5
    assert (G.mask_spectrum(feat, 3) == 0).any() and G.log_mel(x[:10], 16000).shape == (0, 80)


def test_chain_and_plda(spark):
    r = np.random.default_rng(3)
    means = r.normal(size=(30, 4)) * 3
    rows = [(i * 10 + k, i, (means[i] + r.normal(size=4)).tolist()) for i in range(30) for k in range(8)]
    df = spark.createDataFrame(rows, "utt long, spk int, v array<double>")
    links = chain.fit("whitening | length-norm", df)
    assert chain.loads(chain.dumps(links)) == links
    out = np.stack([x["v"] for x in chain.apply(links, df).collect()])
    assert np.allclose(np.linalg.norm(out, axis=1), 1)
    white = np.stack([x["v"] for x in chain.apply(links[:1], df).collect()])
    assert np.allclose(np.cov(white.T, bias=True), np.eye(4), atol=1e-6)
    model = B.fit_plda(df, 5)
    assert (model["psi"] > 2).all()
    t = {x["utt"]: np.array(x["v"]) for x in B.transform_vectors(df, model["mu"], model["transform"].T).collect()}

    def llr(a, b):
        scale, var = model["psi"] / (model["psi"] + 1), 1 + model["psi"] / (model["psi"] + 1)
        return (-0.5 * (np.log(var) + (b - scale * a) ** 2 / var) + 0.5 * (np.log(1 + model["psi"]) + b**2 / (1 + model["psi"]))).sum()

    same = np.mean([llr(t[i * 10], t[i * 10 + 1]) for i in range(30)])
    other = np.mean([llr(t[i * 10], t[(i + 1) % 30 * 10]) for i in range(30)])
    assert same > 0 > other
    assert (B.adapt_plda(model, df)["psi"] >= 0).all()
    with pytest.raises(ValueError):
        chain.fit("nothing", df)


def test_interval_identities(spark):
    r = random.Random(5)
    rows = [(k, k % 3, "abc"[k % 2], b := r.randint(0, 400), b + r.randint(0, 60)) for k in range(80)]
    iv = spark.createDataFrame(rows, "id long, rec int, label string, b long, e long")
    once = I.union(iv, ["rec"])
    assert sorted(once.collect()) == sorted(I.union(once, ["rec"]).collect())
    holes = I.overlap_regions(iv, ["rec"])
    covered = {(x, t) for _, x, _, b, e in rows for t in range(b, e)}
    deep = {(x, t) for x in range(3) for t in range(470) if sum(b <= t < e for _, y, _, b, e in rows if x == y) >= 2}
    assert {(h["rec"], t) for h in holes.collect() for t in range(h["b"], h["e"])} == deep
    left = I.subtract(iv, holes, ["rec"]).collect()
    assert {(p["rec"], t) for p in left for t in range(p["b"], p["e"])} == covered - deep
    assert I.union(iv.limit(0), ["rec"]).count() == 0


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([(1, 0.9, True), (2, 0.8, True), (3, 0.1, False), (4, 0.2, False)], "key long, score double, target boolean")
    assert M.eer(M.det_sweep(df, ["key"])).first()["eer"] == pytest.approx(0.0, abs=1e-9)
    only = spark.createDataFrame([(1, 0.9, True), (2, 0.8, True)], df.schema)
    assert M.eer(M.det_sweep(only, ["key"])).first()["eer"] is None
    p = spark.createDataFrame([(x,) for x in (0.001, 0.2, 0.5, 0.975, 0.999)], "p double").select(M.probit(F.col("p"))).collect()
    assert [x[0] for x in p] == pytest.approx([-3.0902323, -0.8416212, 0.0, 1.9599640, 3.0902323], abs=1e-6)
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert zero.select(V.cosine(F.col("a"), F.col("b"))).first()[0] is None
    w, b = S.fit_calibration(spark.createDataFrame([(float(i % 10), i % 10 > r) for i in range(200) for r in (3, 5)], "x double, target boolean"), ["x"])
    assert w[0] > 0.5 and b < 0


def test_repeated_points_and_windows(spark):
    intervals = spark.createDataFrame([("r", 0, 10, "x"), ("r", 5, 300, "y")], "rec string, b long, e long, label string")
    points = spark.createDataFrame([("r", 7), ("r", 7), ("r", 11), ("r", 400), ("q", 7)], "rec string, t long")
    from vecspan.operators import intervals as I

    got = sorted((r["rec"], r["t"], r["label"] or "") for r in I.label_at(points, intervals, ["rec"], width=64).collect())
    assert got == [("q", 7, ""), ("r", 7, "x"), ("r", 7, "x"), ("r", 11, "y"), ("r", 400, "")]
    windows = spark.createDataFrame([("r", 0, 150), ("r", 0, 150), ("r", 0, 90)], "rec string, b long, e long")
    rows = I.dominant_label(windows, intervals, ["rec"]).collect()
    assert [(r["label"], r["overlap"]) for r in rows] == [("y", 145), ("y", 145)]


def test_labels_without_overlap_keep_their_name(spark):
    overlaps = spark.createDataFrame([("r", "a", "s1", 5), ("r", "b", "s1", 3)], "rec string, label_a string, label_b string, overlap long")
    labels = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c"), ("q", "d")], "rec string, label_a string")
    got = {(r["rec"], r["label_a"]): r["mapped"] for r in C.map_labels(overlaps, "rec", labels).collect()}
    assert got == {("r", "a"): "s1", ("r", "b"): "b", ("r", "c"): "c", ("q", "d"): "d"}


def test_curves_and_norms(spark):
    from vecspan.functions import schedules

    it = spark.range(0, 1001, 100).select(schedules.margin_curve(F.col("id"), 200, 600, 0.0, 0.2).alias("m"), F.col("id"))
    got = {r["id"]: r["m"] for r in it.collect()}
    want = lambda k: 0.2 * (1 - np.exp(k / 400 * np.log(1e-3 / (1 + 1e-6))))
    assert got[100] == 0 and got[600] == got[1000] == 0.2
    assert got[300] == pytest.approx(0.16443, abs=1e-4) and all(got[200 + k] == pytest.approx(want(k)) for k in (0, 100, 200, 300))
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],)], "v array<double>")
    rows = v.select(V.l2_normalise(F.col("v")).alias("a"), V.length_normalise(F.col("v")).alias("b")).collect()
    assert rows[0]["a"] == pytest.approx([0.6, 0.8]) and rows[0]["b"] == pytest.approx([0.6 * 2**0.5, 0.8 * 2**0.5])
    assert rows[1]["a"] == [None, None] and rows[2]["a"] == []


def test_calibration_finds_the_minimum(spark):
    r = np.random.default_rng(5)
    x = np.r_[r.normal(2, 1, 300), r.normal(-1, 1.5, 500)] * 0.3 + 4
    y = np.r_[np.ones(300), np.zeros(500)].astype(bool)
    w, b = S.fit_calibration(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, target boolean"), ["x"])

    def cost(w, b):
        z = np.where(y, 1, -1) * (w * x + b)
        loss = np.logaddexp(0, -z)
        return (loss[y].mean() + loss[~y].mean()) / 2

    best = cost(w[0], b)
    assert all(best <= cost(w[0] + i, b + j) + 1e-9 for i in (-0.01, 0, 0.01) for j in (-0.01, 0, 0.01))
