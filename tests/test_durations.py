"""Means over ranges of a timeline from prefix sums, and the sweep over durations, against plain loops."""

import random

import numpy as np
import pytest

from vecspan.operators import durations as D


def test_duration_sweep(spark):
    r = random.Random(5)
    spk = {s: [[r.gauss(m, 1) for m in (s, 1, -s)] for _ in range(n)] for s, n in ((1, 300), (2, 60), (3, 7), (4, 25))}
    rows = [(s, 10 * k, v) for s, vs in spk.items() for k, v in enumerate(vs)] + [(None, 1, [1.0, 1.0, 1.0]), (2, 5, None)]
    frames = spark.createDataFrame(rows, "spk int, utt long, v array<double>").repartition(3)
    conditions, guard = [(2, 1), (10, 5), (30, 12)], 2
    line = D.timeline(frames, rows=16)
    unit = lambda x: x / np.linalg.norm(x)
    means = {}
    for s, vs in spk.items():
        for e, p in conditions:
            if len(vs) >= e + guard + p:
                start = max(len(vs) - p, e + guard)
                means[s, e, p] = unit(np.mean(vs[:e], axis=0)), unit(np.mean(vs[start : start + p], axis=0))
    got = {(x["spk"], x["enrol"], x["probe"]): (x["gallery"], x["sample"]) for x in D.range_means(line, conditions, guard).collect()}
    assert set(got) == set(means) and all(np.allclose(got[k][side], means[k][side]) for k in means for side in (0, 1))
    out = {(x["enrol"], x["probe"]): x for x in D.two_speaker_sweep(frames, conditions, guard, 100, 1).collect()}
    for e, p in conditions:
        able = [s for s in spk if (s, e, p) in means]
        correct = sum(means[a, e, p][1] @ means[a, e, p][0] > means[a, e, p][1] @ means[b, e, p][0] for a in able for b in able if a != b)
        n = len(able) * (len(able) - 1) // 2
        x = out[e, p]
        assert (x["pairs"], x["skipped"], x["correct"]) == (6, 6 - n, correct) and x["accuracy"] == pytest.approx(correct / (2 * n))
    none = D.two_speaker_sweep(frames, [(400, 1)], guard, 3, 1).first()
    assert (none["pairs"], none["skipped"], none["accuracy"]) == (3, 3, None)
