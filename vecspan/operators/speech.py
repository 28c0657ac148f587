"""Speech segments and held classes of frames, as joins and running sums over slices of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecspan.plans import slices
from vecspan.plans.slices import GROUP, SLICE


def speech_segments(df: DataFrame, group: list[str], frame: str = "frame", p: str = "p", on: float = 0.5, off: float = 0.35, silence: int = 10, speech: int = 25, pad: int = 0, least: int = 0, rows: int = slices.SLICE_ROWS) -> DataFrame:
    """Group, b, e: frames [b, e) of speech.

    Speech begins at p >= on. The first frame of p < off after the last one of p >= on is its end, as soon as another
    frame of p < off comes `silence` frames or more after it with no p >= on between; it counts if it is longer than `speech`.
    Speech still open at the last frame lasts to the end, however short. Segments grow by `pad` on both sides and
    share a gap that is too small for it; those shorter than `least` are dropped last.

    So what follows a frame of p >= on up to the next such one is summed up by its first and last frame of p < off, and
    speech breaks where these are far enough apart: no state is carried from frame to frame. Frames are numbered from 0;
    one of null p is neither. A group without speech has no row.
    """
    up, down = F.col("p") >= on, F.col("p") < off
    frames = slices.sliced(df, group, frame, [F.col(frame).alias("at"), F.col(p).alias("p")], rows)
    length = frames.groupBy(GROUP).agg((F.max("at") + 1).alias("n"))
    marked = slices.sums(frames, ["at"], {"gap": F.coalesce(up, F.lit(False)).cast("int")}).where("gap > 0")
    gaps = marked.groupBy(GROUP, "gap").agg(
        F.min("at").alias("u"),
        F.min(SLICE).alias(SLICE),
        F.min(F.when(down, F.col("at"))).alias("ends"),
        F.max(F.when(down, F.col("at"))).alias("quiet"),
    )
    gaps = gaps.withColumn("breaks", F.coalesce(F.col("quiet") - F.col("ends") >= silence, F.lit(False)).cast("int"))
    gaps = slices.sums(gaps, ["u"], {"broken": F.col("breaks")})
    found = gaps.groupBy(GROUP, (F.col("broken") - F.col("breaks")).alias("k")).agg(F.min("u").alias("b"), F.max(F.when(F.col("breaks") == 1, F.col("ends"))).alias("ends"), F.min(SLICE).alias(SLICE))
    found = found.join(length, GROUP).where((F.col("ends") - F.col("b") > speech) | F.col("ends").isNull())
    found = slices.neighbours(found.select(GROUP, SLICE, "n", "b", F.coalesce("ends", "n").alias("e")), ["b"], ["b", "e"])

    def grow(gap):
        return F.when(gap < 2 * pad, F.floor(gap / 2)).otherwise(F.lit(pad))

    left, right = F.col("b") - F.col("before.e"), F.col("after.b") - F.col("e")
    b = F.greatest(F.lit(0), F.col("b") - F.when(left.isNull(), F.lit(pad)).otherwise(grow(left)))
    e = F.when(right.isNull(), F.least(F.col("n"), F.col("e") + pad)).otherwise(F.col("e") + grow(right))
    return found.select(f"{GROUP}.*", b.cast("long").alias("b"), e.cast("long").alias("e")).where(F.col("e") - F.col("b") >= least)


def _runs(table) -> tuple[list[int], list[int], list]:
    """Codes and lengths of a slice's runs in the order of its frames, and the classes by code."""
    import numpy as np

    classes = table["cls"].combine_chunks().dictionary_encode(null_encoding="encode")
    codes = classes.indices.to_numpy()
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first].tolist(), np.diff(np.append(first, len(codes))).tolist(), classes.dictionary.to_pylist()


def hold_filter(df: DataFrame, group: list[str], frame: str = "frame", cls: str = "cls", hold: int = 75, rows: int = slices.SLICE_ROWS) -> DataFrame:
    """Group, frame, cls, held: the class stays until more than `hold` frames in a row have disagreed.

    What goes from frame to frame is the class held and how many frames have disagreed. A slice tells to which state each of these
    leads: of its own classes, and of any other, which all fare alike. From most slices all states come out as one, and then it
    tells that one only. So states are carried over slices, a few rows each, and then each slice is worked through once.
    Frames have a class, and follow each other by their numbers.
    """
    frames = slices.sliced(df, group, frame, [F.col(frame).cast("long").alias("at"), F.col(cls).alias("cls")], rows)
    kind = frames.schema["cls"].dataType.simpleString()

    def ends(table):
        import pyarrow as pa

        runs, lengths, classes = _runs(table := table.sort_by("at"))
        states = {(h, n): [(h, n)] for h in range(-1, len(classes)) for n in range(hold + 1)}  # -1: a class that is not here
        for c, length in zip(runs, lengths, strict=True):
            after: dict = {}
            for (h, n), entered in states.items():
                to = (c, 0) if h == c or n + length > hold else (h, n + length)
                if to in after:
                    after[to] += entered
                else:
                    after[to] = entered
            states = after
        (every, *_), alike = states, len(states) == 1
        out = [(-1, 0, *every)] if alike else [(*x, *to) for to, entered in states.items() for x in entered]
        name = lambda k: pa.array([classes[x[k]] if x[k] >= 0 else None for x in out], table["cls"].type)
        number = lambda k: pa.array([x[k] for x in out], pa.int64())
        flag = lambda values: pa.array(values, pa.bool_())
        many = pa.array([0] * len(out))
        return pa.table({
            GROUP: table[GROUP].combine_chunks().take(many), SLICE: table[SLICE].combine_chunks().take(many), "first": table["cls"].combine_chunks().take(many), "alike": flag([alike] * len(out)),
            "here": flag([x[0] >= 0 for x in out]), "cls": name(0), "n": number(1), "stays": flag([x[2] < 0 for x in out]), "to": name(2), "to_n": number(3),
        })

    def carry(table):
        import pyarrow as pa

        rows, entries, state = table.drop_columns([GROUP]).to_pylist(), [], None
        steps: dict = {}
        for r in rows:
            steps.setdefault(r[SLICE], []).append(r)
        for k in sorted(steps):
            state = state or (steps[k][0]["first"], 0)
            entries.append((k, *state))
            known = any(r["here"] and r["cls"] == state[0] for r in steps[k])
            for r in steps[k]:
                if r["alike"] or (r["n"] == state[1] and r["here"] == known and (not known or r["cls"] == state[0])):
                    state = (state[0] if r["stays"] else r["to"], r["to_n"])
                    break
        same = table[GROUP].combine_chunks().take(pa.array([0] * len(entries)))
        return pa.table({GROUP: same, SLICE: pa.array([e[0] for e in entries], pa.int64()), "held": pa.array([e[1] for e in entries], table["first"].type), "n": pa.array([e[2] for e in entries], pa.int64())})

    def walk(table):
        import numpy as np
        import pyarrow as pa

        runs, lengths, classes = _runs(table := table.sort_by("at"))
        held, n = table["held"][0].as_py(), table["n"][0].as_py()
        classes = classes if held in classes else [*classes, held]
        held, out, at = classes.index(held), np.repeat(runs, lengths), 0
        for c, length in zip(runs, lengths, strict=True):
            if c == held:
                n = 0
            elif n + length > hold:
                out[at : at + hold - n] = held
                held, n = c, 0
            else:
                out[at : at + length] = held
                n += length
            at += length
        return table.drop_columns(["held", "n", SLICE]).append_column("held", pa.array(classes, table["cls"].type).take(pa.array(out)))

    whole = frames.schema[GROUP]
    schema = lambda ddl: StructType([whole, *StructType.fromDDL(ddl).fields])
    states = frames.groupBy(GROUP, SLICE).applyInArrow(ends, schema(f"{SLICE} long, first {kind}, alike boolean, here boolean, cls {kind}, n long, stays boolean, to {kind}, to_n long"))
    entered = states.groupBy(GROUP).applyInArrow(carry, schema(f"{SLICE} long, held {kind}, n long"))
    out = frames.join(entered, [GROUP, SLICE]).groupBy(GROUP, SLICE).applyInArrow(walk, schema(f"at long, cls {kind}, held {kind}"))
    return out.select(f"{GROUP}.*", F.col("at").alias("frame"), "cls", "held")
