"""Interval operators on one recording that holds most rows, in small slices, against plain loops."""

import random
from collections import Counter, defaultdict

import pytest

from vecspan.operators import intervals as I
from vecspan.operators.clustering import hold_filter as held_classes
from vecspan.operators.clustering import hysteresis
from vecspan.operators.speech import hold_filter, speech_segments

LABELS = "ab"


def recordings(seed):
    """rec -> intervals (id, b, e, label); nine of ten are of one recording, ties and repeats are frequent."""
    r = random.Random(seed)
    out = defaultdict(list)
    for k in range(600):
        rec = r.choice([None, 1, 2]) if k % 10 == 0 else 7
        b = r.randrange(3000)
        out[rec].append((k, b, b + r.randint(1, 12 if k % 7 else 60), r.choice(LABELS)))
    return out


def rows(spark, recs):
    return spark.createDataFrame([(rec, *x) for rec, found in recs.items() for x in found], "rec int, id long, b long, e long, label string").repartition(3)


def got(df, *columns):
    return sorted((tuple(x[c] for c in columns) for x in df.collect()), key=str)


def merged(found):
    out, held = [], None
    for b, _, e, label in sorted((b, i, e, label) for i, b, e, label in found):
        if held is None or b > held[2]:
            out += [tuple(held)] if held else []
            held = [label, float(b), float(e)]
        elif label == held[0]:
            held[2] = float(e)
        else:
            middle = (b + held[2]) / 2
            out.append((held[0], held[1], middle))
            held = [label, middle, float(e)]
    return out + ([tuple(held)] if held else [])


def covered(found, depth):
    """Stretches of at least `depth` intervals, unit by unit; touching ones are apart where the count falls between."""
    events = sorted([(b, 1) for _, b, _, _ in found] + [(e, -1) for _, _, e, _ in found], key=lambda x: x)
    out, n, begin = [], 0, None
    for t, d in events:
        if n < depth <= n + d:
            begin = t
        elif n + d < depth <= n:
            out.append((begin, t))
        n += d
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_recording(spark, seed):
    recs = recordings(seed)
    df = rows(spark, recs)
    assert got(I.merge_labels(df, ["rec"], ["b", "id"], rows=40), "rec", "label", "b", "e") == sorted(((rec, *x) for rec, found in recs.items() for x in merged(found)), key=str)
    joined = {rec: [] for rec in recs}
    for rec, found in recs.items():
        for _, b, e, _ in sorted(found, key=lambda x: x[1:3]):
            if joined[rec] and b <= joined[rec][-1][1]:
                joined[rec][-1][1] = max(joined[rec][-1][1], e)
            else:
                joined[rec].append([b, e])
    assert got(I.union(df, ["rec"], rows=40), "rec", "b", "e") == sorted(((rec, *x) for rec, found in joined.items() for x in found), key=str)
    for depth in (1, 2, 4):
        assert got(I.overlap_regions(df, ["rec"], depth=depth, rows=40), "rec", "b", "e") == sorted(((rec, *x) for rec, found in recs.items() for x in covered(found, depth)), key=str)


def test_runs_of_a_hot_recording(spark):
    r = random.Random(3)
    frames = [(7, k, r.choice([0, 0, 0, 1])) for k in range(500) if k % 97] + [(None, k, 1) for k in range(9)]
    want, last = [], {}
    for rec, k, c in frames:
        if last.get(rec) == (k, c):
            want[-1][3] = k + 1
        else:
            want.append([rec, c, k, k + 1])
        last[rec] = (k + 1, c)
    df = spark.createDataFrame(frames, "rec int, frame long, cls int").repartition(3)
    assert got(I.runs(df, ["rec"], rows=30), "rec", "cls", "b", "e") == sorted(map(tuple, want), key=str)


def test_error_rate_of_a_hot_recording(spark):
    ref, hyp = recordings(4), recordings(5)
    want = {}
    for rec in ref:
        total = Counter()
        marks = sorted({t for x in ref[rec] + hyp[rec] for t in x[1:3]})
        for t, u in zip(marks, marks[1:]):
            r, h = ({x[3] for x in side[rec] if x[1] <= t < x[2]} for side in (ref, hyp))
            for name, n in (("total", len(r)), ("miss", max(0, len(r) - len(h))), ("false_alarm", max(0, len(h) - len(r))), ("confusion", min(len(r), len(h)) - len(r & h))):
                total[name] += n * (u - t)
        want[rec] = dict(total)
    out = I.error_rate(rows(spark, ref), rows(spark, hyp), ["rec"], rows=50)
    assert {x["rec"]: {k: x[k] for k in want[7]} for x in out.collect()} == want


def test_no_window_over_a_whole_recording(spark):
    """Every window over rows is of a slice of a recording; those of whole recordings see one row a slice."""
    df = rows(spark, recordings(1))
    for out in (I.merge_labels(df, ["rec"], ["b", "id"], rows=40), I.union(df, ["rec"], rows=40), I.overlap_regions(df, ["rec"], rows=40), I.runs(df.selectExpr("rec", "id as frame", "label as cls"), ["rec"], rows=40)):
        plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        for k, line in enumerate(plan):
            if "Window [" in line and "_slice" not in line.split("], [")[1]:
                assert "Aggregate [_group" in plan[k + 1] or "Project" in plan[k + 1] and "Aggregate [_group" in plan[k + 2], plan[k : k + 3]


@pytest.mark.parametrize("pad, least", [(0, 0), (3, 0), (2, 9)])
def test_speech_of_a_hot_recording(spark, pad, least):
    """Slices against the state machine that goes from frame to frame."""
    r = random.Random(pad)
    recs = {rec: [r.choice([0.1, 0.1, 0.4, 0.9]) if k // 15 % 3 else r.choice([0.1, 0.9, 0.9]) for k in range(n)] for rec, n in ((7, 900), (1, 40), (2, 1), (None, 60))}
    recs[3] = [0.1] * 30
    df = spark.createDataFrame([(rec, k, p) for rec, found in recs.items() for k, p in enumerate(found)], "rec int, frame long, p double").repartition(3)
    want = [(rec, *x) for rec, found in recs.items() for x in hysteresis(found, silence=4, speech=3, pad=pad, least=least)]
    out = speech_segments(df, ["rec"], silence=4, speech=3, pad=pad, least=least, rows=50)
    assert len(want) > 20 and got(out, "rec", "b", "e") == sorted(want, key=str)


@pytest.mark.parametrize("hold", [0, 1, 4])
def test_held_classes_of_a_hot_recording(spark, hold):
    r = random.Random(hold)
    recs = {}
    for rec, n in ((7, 700), (1, 30), (2, 1), (None, 60)):
        recs[rec] = [c for _ in range(n) for c in [r.randrange(3)] * r.choice([1, 1, 2, 6])][:n]
    df = spark.createDataFrame([(rec, k, c) for rec, found in recs.items() for k, c in enumerate(found)], "rec int, frame long, cls int").repartition(3)
    want = [(rec, k, c) for rec, found in recs.items() for k, c in enumerate(held_classes(found, hold))]
    assert got(hold_filter(df, ["rec"], hold=hold, rows=40), "rec", "frame", "held") == sorted(want, key=str)
