"""Interval algebra: rows of (group, begin, end[, label]) with times as whole milliseconds or frames.

What runs along a group's time does so in slices (see plans/slices.py), so one long recording is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecspan.plans import slices
from vecspan.plans.slices import GROUP, SLICE


def merge_labels(df: DataFrame, group: list[str], seq: list[str], begin: str = "b", end: str = "e", label: str = "label", rows: int = slices.SLICE_ROWS) -> DataFrame:
    """Merge overlapping sub-windows in arrival order: group, label, b, e.

    Neighbours of one label that touch or overlap are one piece; where the label changes within an overlap
    both pieces end at its middle. The first of seq is a number along which rows come, null in none that counts.
    """
    order = [f"_s{k}" for k in range(len(seq))]
    keys = [F.col(c).alias(o) for c, o in zip(seq, order, strict=True)]
    cur = slices.sliced(df, group, seq[0], [*keys, F.col(begin).alias("b"), F.col(end).alias("e"), F.col(label).alias("label")], rows)
    cur = slices.neighbours(cur, order, ["b", "e", "label"])
    opens = F.col("before.e").isNull() | (F.col("b") > F.col("before.e"))
    turns, turned = F.col("label") != F.col("before.label"), F.col("after.label") != F.col("label")
    cur = cur.select(
        GROUP, SLICE, *order, "label",
        F.coalesce(opens | turns, F.lit(False)).cast("int").alias("start"),
        F.when(opens, F.col("b").cast("double")).when(turns, (F.col("b") + F.col("before.e")) / 2).alias("ib"),
        F.when(F.col("after.b").isNull() | (F.col("after.b") > F.col("e")), F.col("e").cast("double")).when(turned, (F.col("after.b") + F.col("e")) / 2).alias("ie"),
    )
    cur = slices.sums(cur, order, {"piece": F.col("start")})
    return cur.groupBy(GROUP, "piece").agg(F.first("label").alias("label"), F.max("ib").alias("b"), F.max("ie").alias("e")).select(f"{GROUP}.*", "label", "b", "e")


def union(df: DataFrame, group: list[str], begin: str = "b", end: str = "e", min_length: int = 0, rows: int = slices.SLICE_ROWS) -> DataFrame:
    """The union of each group's intervals as disjoint ones of at least min_length; touching ones are joined."""
    cur = slices.sliced(df, group, begin, [F.col(begin).alias("b"), F.col(end).alias("e")], rows)
    cur = slices.max_before(cur, ["b", "e"], "e", "far")
    cur = slices.sums(cur, ["b", "e"], {"island": (F.col("far").isNull() | (F.col("b") > F.col("far"))).cast("int")})
    out = cur.groupBy(GROUP, "island").agg(F.min("b").alias("b"), F.max("e").alias("e")).select(f"{GROUP}.*", "b", "e")
    return out.where(F.col("e") - F.col("b") >= min_length)


def overlap_regions(df: DataFrame, group: list[str], begin: str = "b", end: str = "e", depth: int = 2, rows: int = slices.SLICE_ROWS) -> DataFrame:
    """Stretches covered by at least `depth` intervals; at equal times ends come first."""
    events = df.select(*group, F.col(begin).alias("t"), F.lit(1).alias("d")).unionByName(df.select(*group, F.col(end).alias("t"), F.lit(-1).alias("d")))
    run = slices.sums(slices.sliced(events, group, "t", ["t", "d"], rows), ["t", "d"], {"n": F.col("d")})
    n, before = F.col("n"), F.col("n") - F.col("d")
    edges = run.where(((before < depth) & (n >= depth)) | ((before >= depth) & (n < depth))).select(GROUP, SLICE, "t", "d")
    edges = slices.sums(edges, ["t", "d"], {"k": F.lit(1)})  # they rise and fall by turns
    return edges.groupBy(GROUP, F.floor((F.col("k") - 1) / 2)).agg(F.min("t").alias("b"), F.max("t").alias("e")).select(f"{GROUP}.*", "b", "e")


def subtract(segments: DataFrame, holes: DataFrame, group: list[str], seg_id: str = "id") -> DataFrame:
    """What remains of each segment outside disjoint holes of its group: group, id, b, e."""
    h = holes.select(*group, F.col("b").alias("hb"), F.col("e").alias("he"))
    hit = range_join(segments.select(*group, seg_id, "b", "e"), h, group, ("b", "e"), ("hb", "he"), how="left")
    per = hit.groupBy(*group, seg_id, "b", "e").agg(F.sort_array(F.collect_list(F.when(F.col("hb").isNotNull(), F.struct("hb", "he")))).alias("h"))
    starts = F.concat(F.array("b"), F.transform("h", lambda x: x["he"]))
    stops = F.concat(F.transform("h", lambda x: x["hb"]), F.array("e"))
    pieces = per.select(*group, seg_id, F.explode(F.arrays_zip(starts.alias("b"), stops.alias("e"))).alias("p"))
    return pieces.select(*group, seg_id, "p.b", "p.e").where("b < e")


def runs(df: DataFrame, group: list[str], frame: str = "frame", label: str = "cls", rows: int = slices.SLICE_ROWS) -> DataFrame:
    """Contiguous frames of one class: group, class, first and last frame (the end is exclusive)."""
    cur = slices.sliced(df, [*group, label], frame, [F.col(frame).alias("at")], rows)
    cur = slices.sums(cur, ["at"], {"k": F.lit(1)})
    out = cur.groupBy(GROUP, (F.col("at") - F.col("k")).alias("run")).agg(F.min("at").alias("b"), (F.max("at") + 1).alias("e"))
    return out.select(f"{GROUP}.*", "b", "e")


def bursts(df: DataFrame, group: list[str], seq: str, flag: str, begin: str = "b", end: str = "e") -> DataFrame:
    """Runs of flagged turns: group, n_turns, b, e."""
    w = Window.partitionBy(*group).orderBy(seq)
    cur = df.withColumn("_k", F.row_number().over(w) - F.sum(F.col(flag).cast("int")).over(w))
    return cur.where(flag).groupBy(*group, "_k").agg(F.count("*").alias("n_turns"), F.min(begin).alias("b"), F.max(end).alias("e")).drop("_k")


def range_join(left: DataFrame, right: DataFrame, group: list[str], a: tuple[str, str], b: tuple[str, str], how: str = "inner", width: int = 1 << 22) -> DataFrame:
    """Pairs of intervals of one group with a.begin < b.end and b.begin < a.end (open overlap).

    Intervals are dealt into time buckets of `width`, joined on (group, bucket), and a pair is taken in the
    later of the two first buckets only, so long lists of one group spread over their buckets.
    """
    begin_a, end_a = a
    begin_b, end_b = b

    def dealt(df: DataFrame, begin: str, end: str, name: str) -> DataFrame:
        first = F.floor(F.col(begin) / width).cast("long")
        last = F.floor(F.greatest(F.col(end), F.col(begin)) / width).cast("long")
        return df.withColumn(name, first).withColumn("_bucket", F.explode(F.sequence(first, last)))

    x, y = dealt(left, begin_a, end_a, "_fa"), dealt(right, begin_b, end_b, "_fb")
    pairs = x.join(y, [*group, "_bucket"]).where((F.col(begin_a) < F.col(end_b)) & (F.col(begin_b) < F.col(end_a)) & (F.col("_bucket") == F.greatest("_fa", "_fb")))
    pairs = pairs.drop("_bucket", "_fa", "_fb")
    if how == "inner":
        return pairs
    keys = [c for c in left.columns]
    lonely = left.join(pairs.select(*keys).distinct(), keys, "left_anti")
    return pairs.unionByName(lonely, allowMissingColumns=True)


def overlap_totals(left: DataFrame, right: DataFrame, group: list[str], label: str = "label", rows: int = slices.SLICE_ROWS) -> DataFrame:
    """Total overlap of every pair of labels of two interval lists.

    A slice of time knows how many intervals of each label are open at its begin, and its stretches between borders add the
    product of both sides' counts and their length: no pair of intervals is made. Intervals without length add nothing, but
    a row for each label that is open before and after them.
    """

    def sided(df: DataFrame, side: int) -> DataFrame:
        return _grouped(df, group).select(F.struct(*group).alias("_g"), F.lit(side).alias("side"), F.col(label).cast("string").alias("label"), "b", "e")

    iv = sided(left, 0).unionByName(sided(right, 1)).where("b <= e")
    marks = F.array(*[F.struct(F.col(x).alias("t"), d.alias("d"), end.alias("ends"), at.alias("points")) for x, d, end, at in (
        ("b", F.when(F.col("b") < F.col("e"), 1).otherwise(0), F.lit(0), F.when(F.col("b") < F.col("e"), 0).otherwise(1)),
        ("e", F.when(F.col("b") < F.col("e"), -1).otherwise(0), F.when(F.col("b") < F.col("e"), 1).otherwise(0), F.lit(0)),
    )])
    events = iv.select("_g", "side", "label", F.inline(marks)).groupBy("_g", "side", "label", "t").agg(*[F.sum(c).alias(c) for c in ("d", "ends", "points")])
    events = slices.sliced(events, ["_g"], "t", ["side", "label", "t", "d", "ends", "points"], rows)
    cells = events.groupBy(GROUP, SLICE).agg(F.min("t").alias("t"))
    cells = cells.select(GROUP, SLICE, F.lead("t").over(Window.partitionBy(GROUP).orderBy(SLICE)).alias("until"))
    sums = events.groupBy(GROUP, SLICE, "side", "label").agg(F.sum("d").alias("d")).withColumn("label", F.struct("label"))
    grid = cells.join(sums.select(GROUP, "side", "label").distinct(), GROUP).join(sums, [GROUP, SLICE, "side", "label"], "left")
    earlier = Window.partitionBy(GROUP, "side", "label").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select(F.col(GROUP).alias(GROUP), F.col(SLICE).alias(SLICE), "until", F.col("side").alias("side"), F.col("label.label").alias("label"), F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("open"))

    def add(df, before):
        import numpy as np
        import pyarrow as pa

        out = pa.schema([("label_a", pa.string()), ("label_b", pa.string()), ("overlap", pa.int64())])
        if not len(df):
            return pa.Table.from_batches([], out.insert(0, before.schema.field(GROUP)))
        column = lambda t, c: t[c].combine_chunks().to_numpy(zero_copy_only=False)
        t, at = np.unique(column(df, "t"), return_inverse=True)
        until = before["until"][0].as_py()
        length = np.diff(np.append(t, t[-1] if until is None else until))
        labels = pa.chunked_array([*before["label"].chunks, *df["label"].chunks]).combine_chunks().dictionary_encode(null_encoding="encode")
        codes, side, own = labels.indices.to_numpy(), column(df, "side"), column(before, "side")
        known, new = codes[: len(before)], codes[len(before) :]
        here = [np.unique(np.concatenate([known[own == k], new[side == k]])) for k in (0, 1)]
        total, strict = np.zeros((len(here[0]), len(here[1])), np.int64), np.zeros((len(here[0]), len(here[1])), bool)
        step = max(1, (1 << 22) // max(1, len(here[0]) + len(here[1])))
        count = [np.zeros(len(h), np.int64) for h in here]
        for k in (0, 1):
            np.add.at(count[k], np.searchsorted(here[k], known[own == k]), column(before, "open")[own == k])
        for start in range(0, len(t), step):
            n = min(step, len(t) - start)
            opened, ends, points = ([np.zeros((n, len(h)), np.int64) for h in here] for _ in range(3))
            for k in (0, 1):
                pick = (side == k) & (at >= start) & (at < start + n)
                for table, c in ((opened[k], "d"), (ends[k], "ends"), (points[k], "points")):
                    np.add.at(table, (at[pick] - start, np.searchsorted(here[k], new[pick])), column(df, c)[pick])
            now = [count[k] + opened[k].cumsum(axis=0) for k in (0, 1)]
            total += (now[0] * length[start : start + n, None]).T @ now[1]
            held = [np.concatenate([count[k][None], now[k][:-1]]) - ends[k] > 0 for k in (0, 1)]
            for k in (0, 1):
                r = points[k].any(axis=1)
                met = ((points[k][r] > 0).astype(np.int64).T @ held[1 - k][r].astype(np.int64)) > 0
                strict |= met if k == 0 else met.T
            count = [now[k][-1] for k in (0, 1)]
        a, b = np.nonzero((total > 0) | strict)
        same = before[GROUP].combine_chunks().take(pa.array(np.zeros(len(a), np.int64)))
        name = lambda k, x: labels.dictionary.take(pa.array(here[k][x])).cast(pa.string())
        return pa.table({GROUP: same, "label_a": name(0, a), "label_b": name(1, b), "overlap": pa.array(total[a, b])})

    schema = StructType([events.schema[GROUP], *StructType.fromDDL("label_a string, label_b string, overlap long").fields])
    found = events.groupBy(GROUP, SLICE).cogroup(grid.groupBy(GROUP, SLICE)).applyInArrow(add, schema)
    found = found.select(f"{GROUP}._g.*", "label_a", "label_b", "overlap")
    if not (left.where("e < b").isEmpty() and right.where("e < b").isEmpty()):  # ends before begins: as the sum over pairs has it
        found = found.unionByName(_reversed_overlaps(left, right, group, label))
    return found.groupBy(*group, "label_a", "label_b").agg(F.sum("overlap").alias("overlap"))


def _reversed_overlaps(left: DataFrame, right: DataFrame, group: list[str], label: str) -> DataFrame:
    """overlap_totals' summands of the pairs in which an interval ends before it begins."""
    x = left.select(*group, F.col(label).alias("label_a"), F.col("b").alias("ab"), F.col("e").alias("ae"))
    y = right.select(*group, F.col(label).alias("label_b"), F.col("b").alias("bb"), F.col("e").alias("be"))
    sides = [(x.where("ae < ab"), y), (x.where("ab <= ae"), y.where("be < bb"))]
    pairs = [range_join(p, q, group, ("ab", "ae"), ("bb", "be")) for p, q in sides]
    return pairs[0].unionByName(pairs[1]).select(*group, "label_a", "label_b", (F.least("ae", "be") - F.greatest("ab", "bb")).alias("overlap"))


def _grouped(df: DataFrame, group: list[str]) -> DataFrame:
    """Rows whose group has no null: others meet no row of another table."""
    for g in group:
        df = df.where(F.col(g).isNotNull())
    return df


def label_at(points: DataFrame, intervals: DataFrame, group: list[str], t: str = "t", label: str = "label", width: int | None = None, rows: int = slices.SLICE_ROWS) -> DataFrame:
    """The label of the first interval (by begin, end, label) that holds each point, both ends closed; null if none.

    One row per row of points, repeated ones too. In that order an interval is the first from the end of all before it to its own,
    so these stretches are apart, and a point looks up the last one that has begun: no pair of both is made.
    """
    i = _grouped(intervals, group).where("b <= e")
    i = slices.sliced(i, group, "b", [F.col("b").alias("b"), F.col("e").alias("e"), F.col(label).alias("label")], rows, width)
    i = slices.max_before(i, ["b", "e", "label"], "e", "far").where("far is null or far < e")
    opens = F.when(F.col("far").isNull() | (F.col("b") > F.col("far")), 0).otherwise(2)  # at an earlier one's end: only after it
    first = i.select(f"{GROUP}.*", F.greatest("b", "far").alias("_at"), opens.alias("_kind"), F.struct("e", "label").alias("_first"))
    own = points.select(*group, F.col(t).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_point"))
    both = slices.sliced(first.unionByName(own, allowMissingColumns=True), group, "_at", ["_at", "_kind", "_first", "_point"], rows, width)
    found = slices.last_of(both, ["_at", "_kind"], "_first", "_now").where("_kind = 1")
    found = found.select("_point.*", F.when(F.col("_at") <= F.col("_now.e"), F.col("_now.label")).alias("label"))
    return found.unionByName(points.where(F.col(t).isNull()), allowMissingColumns=True)


def dominant_label(windows: DataFrame, intervals: DataFrame, group: list[str], min_overlap: int = 100, label: str = "label") -> DataFrame:
    """The label with the most overlap with each window (ties: the smaller label), if at least min_overlap.

    Repeated windows each give a row.
    """
    i = intervals.select(*group, F.col("b").alias("_ib"), F.col("e").alias("_ie"), F.col(label).alias("_label"))
    keys = windows.columns
    pairs = range_join(windows.withColumn("_window", F.monotonically_increasing_id()), i, group, ("b", "e"), ("_ib", "_ie"))
    total = pairs.groupBy("_window", *keys, "_label").agg(F.sum(F.least("e", "_ie") - F.greatest("b", "_ib")).alias("_overlap"))
    best = total.groupBy("_window", *keys).agg(F.min(F.struct((-F.col("_overlap")).alias("o"), "_label")).alias("_m"))
    return best.select(*keys, F.col("_m._label").alias("label"), (-F.col("_m.o")).alias("overlap")).where(F.col("overlap") >= min_overlap)


def active_at(points: DataFrame, intervals: DataFrame, group: list[str], t: str = "t", label: str = "label", rows: int = slices.SLICE_ROWS) -> DataFrame:
    """Every (point, label) with begin <= t < end.

    Intervals of one label are united first. A point meets each label that has an interval in its slice of time once, and
    looks up the last of these that has begun.
    """
    islands = union(_grouped(intervals, group).where("b < e").withColumn("_label", F.col(label)), [*group, "_label"], rows=rows)
    p = _grouped(points, group).where(F.col(t).isNotNull()).distinct()
    width = slices.slice_width(p, group, t, rows)
    p = p.select(*group, slices.slice_at(F.col(t), width).alias(SLICE), F.col(t).alias("_at"), F.struct(*points.columns).alias("_point"))
    ends = p.groupBy(*group).agg(F.min(SLICE).alias("_lo"), F.max(SLICE).alias("_hi"))
    lo, hi = F.greatest("_lo", slices.slice_at(F.col("b"), width)), F.least("_hi", slices.slice_at(F.col("e"), width))
    marks = islands.join(ends, group).where(lo <= hi).select(*group, "_label", "b", "e", F.explode(F.sequence(lo, hi)).alias(SLICE))
    meet = p.join(marks.select(*group, SLICE, "_label").distinct(), [*group, SLICE]).withColumn("_kind", F.lit(1))
    marks = marks.select(*group, SLICE, "_label", F.col("b").alias("_at"), F.lit(0).alias("_kind"), F.col("e").alias("_e"))
    last = Window.partitionBy(*group, SLICE, "_label").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = meet.unionByName(marks, allowMissingColumns=True).withColumn("_e", F.last("_e", ignorenulls=True).over(last))
    return found.where("_kind = 1 and _at < _e").select("_point.*", F.col("_label").alias("label"))


def clip(df: DataFrame, lo: int | None, hi: int | None, begin: str = "b", end: str = "e") -> DataFrame:
    """the parts of intervals inside [lo, hi]; a bound of None is no bound."""
    if lo is not None:
        df = df.where(F.col(end) > lo).withColumn(begin, F.greatest(F.col(begin), F.lit(lo)))
    if hi is not None:
        df = df.where(F.col(begin) < hi).withColumn(end, F.least(F.col(end), F.lit(hi)))
    return df


def window_starts(length: Column, size: int, step: int) -> Column:
    """G1: starts of windows of `size` every `step`; one at 0 if the whole is no longer than a window."""
    return F.when(length <= size, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), length - size + step - 1, F.lit(step).cast("long")))


def sub_windows(df: DataFrame, size: int = 150, step: int = 75, shift: int = 10, begin: str = "b", end: str = "e") -> DataFrame:
    """G1: frames of each segment as windows: columns of df, bf, ef (frames from the segment's begin)."""
    length = F.floor((F.col(end) - F.col(begin)) / shift)
    out = df.withColumn("_n", length).withColumn("bf", F.explode(window_starts(F.col("_n"), size, step)))
    return out.withColumn("ef", F.least(F.col("bf") + size, F.col("_n"))).drop("_n")


def growing_windows(df: DataFrame, size: int, stride: int, length: str = "n", wait_full: bool = False) -> DataFrame:
    """Windows that end at every stride, from max(0, end - size); the last stride may be partial."""
    last = F.ceil(F.col(length) / stride)
    out = df.where(F.col(length) >= stride).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    out = out.withColumn("we", F.least(F.col("_k") * stride, F.col(length))).withColumn("wb", F.greatest(F.lit(0), F.col("we") - size))
    out = out.where(F.col("we") - F.col("wb") >= size) if wait_full else out
    return out.drop("_k")


def error_rate(reference: DataFrame, hypothesis: DataFrame, group: list[str], label: str = "label", rows: int = slices.SLICE_ROWS) -> DataFrame:
    """Diarization error per group: total, miss, false_alarm, confusion (times), with labels already mapped.

    Time is cut at every border; in each stretch the larger of the speaker counts minus the agreeing
    speakers is error, split into miss, false alarm and confusion.
    """
    marks = []
    for side, df in (("r", reference), ("h", hypothesis)):
        for col, d in (("b", 1), ("e", -1)):
            marks.append(df.select(*group, F.col(label).alias("label"), F.col(col).alias("t"), F.lit(d if side == "r" else 0).alias("dr"), F.lit(d if side == "h" else 0).alias("dh")))
    events = marks[0]
    for m in marks[1:]:
        events = events.unionByName(m)
    per = events.groupBy(*group, "label", "t").agg(F.sum("dr").alias("dr"), F.sum("dh").alias("dh"))
    per = slices.sliced(per, [*group, "label"], "t", ["t", "dr", "dh"], rows)
    per = slices.sums(per, ["t"], {"ref": F.col("dr"), "hyp": F.col("dh")})
    now = [(F.col(x) > 0).cast("int") for x in ("ref", "hyp")]
    past = [(F.col(x) - F.col(y) > 0).cast("int") for x, y in (("ref", "dr"), ("hyp", "dh"))]
    change = [now[0] - past[0], now[1] - past[1], now[0] * now[1] - past[0] * past[1]]
    step = per.groupBy(*[F.col(f"{GROUP}.{g}").alias(g) for g in group], "t").agg(*[F.sum(c).alias(x) for c, x in zip(change, ("nr", "nh", "both"))])
    step = slices.sliced(step, group, "t", ["t", "nr", "nh", "both"], rows)
    step = slices.neighbours(slices.sums(step, ["t"], {"r": F.col("nr"), "h": F.col("nh"), "c": F.col("both")}), ["t"], ["t"])
    step = step.select(*[F.col(f"{GROUP}.{g}").alias(g) for g in group], (F.col("after.t") - F.col("t")).alias("d"), F.col("r").alias("nr"), F.col("h").alias("nh"), F.col("c").alias("both")).where("d > 0")
    r, h, c, d = (F.col(x) for x in ("nr", "nh", "both", "d"))
    return step.groupBy(*group).agg(
        F.sum(r * d).alias("total"),
        F.sum(F.greatest(r - h, F.lit(0)) * d).alias("miss"),
        F.sum(F.greatest(h - r, F.lit(0)) * d).alias("false_alarm"),
        F.sum((F.least(r, h) - c) * d).alias("confusion"),
    )


def majority_filter(df: DataFrame, group: list[str], frame: str = "frame", cls: str = "cls", half: int = 50, overlap: float = 0.7, single: float = 0.3) -> DataFrame:
    """Class 2 if at least `overlap` of the frames around are 2, else 1 if `single` of them are 1, else 0."""
    w = Window.partitionBy(*group).orderBy(frame).rowsBetween(-half, half)
    share = {k: F.avg((F.col(cls) == k).cast("double")).over(w) for k in (1, 2)}
    return df.withColumn("smoothed", F.when(share[2] >= overlap, 2).when(share[1] >= single, 1).otherwise(0))
