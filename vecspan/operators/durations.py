"""Identification by duration: how well two speakers are told apart from so much enrolment and so much probe.

A speaker's timeline is one vector for each unit of time. Prefix sums along it make the mean over any range a
difference of two rows, so all conditions are taken from one pass, whatever their number and length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspan.functions import vectors as V
from vecspan.operators.sampling import sample_pairs
from vecspan.plans.prefix import running_sums

#: Places of a timeline that are summed up in one task.
RUN = 4096


def timeline(frames: DataFrame, spk: str = "spk", seq: str = "utt", vec: str = "v", rows: int = RUN) -> DataFrame:
    """spk, place, n, i, total: the sum of component i over the places up to place, which are numbered from 0 by seq.

    Rows without a speaker, place in time or vector are left out. Places are dealt by ranges of seq.
    """
    from vecspan.plans import slices

    whole = frames.where(F.col(vec).isNotNull() & F.col(spk).isNotNull())
    cut = slices.sliced(whole, [F.col(spk).alias("spk")], seq, [F.col(seq).alias("seq"), V.as_double(F.col(vec)).alias("v")], rows)
    placed = slices.sums(cut, ["seq"], {"place": F.lit(1)}).select(F.col("_group.spk").alias("spk"), (F.col("place") - 1).alias("place"), "v")
    long = placed.select("spk", "place", F.floor(F.col("place") / rows).alias("run"), F.posexplode("v").alias("i", "x"))
    sums = running_sums(long, "run", ["place"], {"total": F.col("x")}, ["spk", "i"])
    n = placed.groupBy("spk").agg(F.count("*").alias("n"))
    return sums.join(n, "spk").select("spk", "place", "n", "i", "total")


def range_means(line: DataFrame, conditions: list[tuple[int, int]], guard: int) -> DataFrame:
    """spk, enrol, probe, gallery, sample: unit means over the first `enrol` places and over the last `probe` ones, a guard apart.

    Speakers whose timeline is shorter than enrol + guard + probe have no row for that condition.
    """
    spark = line.sparkSession
    wanted = F.array(*[F.struct(F.lit(e).alias("enrol"), F.lit(p).alias("probe")) for e, p in conditions])
    speakers = line.where("place = 0 and i = 0").select("spk", "n", F.explode(wanted).alias("c")).select("spk", "n", "c.*")
    speakers = speakers.where(F.col("n") >= F.col("enrol") + guard + F.col("probe"))
    start = F.greatest(F.col("n") - F.col("probe"), F.col("enrol") + guard)
    ends: list[tuple[str, int, Column]] = [("gallery", 1, F.col("enrol")), ("sample", 1, start + F.col("probe")), ("sample", -1, start)]
    edges = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(sign).alias("sign"), (at - 1).cast("long").alias("place")) for role, sign, at in ends])
    edges = speakers.select("spk", "enrol", "probe", F.explode(edges).alias("x")).select("spk", "enrol", "probe", "x.*")
    found = edges.join(line.drop("n"), ["spk", "place"]).groupBy("spk", "enrol", "probe", "role", "i").agg(F.sum(F.col("sign") * F.col("total")).alias("x"))
    whole = found.groupBy("spk", "enrol", "probe", "role").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    role = lambda name: F.max_by(V.l2_normalise(F.col("v")), F.col("role") == name).alias(name)  # noqa: E731  a mean's direction is its sum's
    return whole.groupBy("spk", "enrol", "probe").agg(role("gallery"), role("sample")) if conditions else spark.createDataFrame([], "spk string, enrol int, probe int, gallery array<double>, sample array<double>")


def two_speaker_sweep(frames: DataFrame, conditions: list[tuple[int, int]], guard: int, pairs: int, seed: int, spk: str = "spk", seq: str = "utt", vec: str = "v") -> DataFrame:
    """Enrol, probe, pairs, skipped, correct, accuracy of every condition.

    So many pairs of speakers are drawn (all, if there are fewer). Each speaker of a pair is a probe against the galleries
    of both; a tie goes to the first of the pair. Pairs with a speaker too short for a condition are skipped and counted.
    accuracy is null where all are.
    """
    spark = frames.sparkSession
    line = timeline(frames, spk, seq, vec)
    means = range_means(line, conditions, guard)
    names = line.where("place = 0 and i = 0").select("spk", F.col("spk").cast("string").alias("own"))
    drawn = sample_pairs(names, "spk", "own", 0, pairs, seed).select("a", "b")
    grid = spark.createDataFrame(conditions, "enrol int, probe int")
    tried = drawn.crossJoin(F.broadcast(grid))  # as many rows a pair as conditions are asked for
    side = lambda name: means.select(F.col("spk").alias(name), "enrol", "probe", F.col("gallery").alias(f"g_{name}"), F.col("sample").alias(f"s_{name}"))
    both = tried.join(side("a"), ["a", "enrol", "probe"], "left").join(side("b"), ["b", "enrol", "probe"], "left")
    score = lambda x, y: V.dot(F.col(x), F.col(y))
    usable = F.col("g_a").isNotNull() & F.col("g_b").isNotNull()
    right = (score("s_a", "g_a") >= score("s_a", "g_b")).cast("long") + (score("s_b", "g_b") > score("s_b", "g_a")).cast("long")
    out = both.groupBy("enrol", "probe").agg(F.count("*").alias("pairs"), F.count(F.when(~usable, 1)).alias("skipped"), F.coalesce(F.sum(F.when(usable, right)), F.lit(0)).alias("correct"))
    return out.withColumn("accuracy", F.col("correct") / F.nullif(2 * (F.col("pairs") - F.col("skipped")), F.lit(0)))
