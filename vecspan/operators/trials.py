"""Trial sampling by hashed ranks: the same draws in any engine, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*key: Column) -> Column:
    """Order key of a draw: md5 of the parts joined by ':'."""
    return F.md5(F.concat_ws(":", *[k.cast("string") for k in key]))


def sample_pools(speakers: DataFrame, trials: int, pool: int, seed: int, spk: str = "spk") -> DataFrame:
    """Trial, position, spk: for every trial `pool` different speakers by hashed rank; position 1 is the target.

    speakers is the bounded table of eligible speakers; trials are rows, so the work is spread over them.
    """
    t = speakers.sparkSession.range(1, trials + 1).withColumnRenamed("id", "trial")
    members = speakers.agg(F.sort_array(F.collect_list(spk)).alias("_all"))
    both = t.join(F.broadcast(members), F.lit(True))
    ranked = F.slice(F.array_sort(F.transform("_all", lambda s: F.struct(draw(F.lit(seed), F.col("trial"), s).alias("h"), s.alias("s")))), 1, pool)
    out = both.select("trial", F.posexplode(ranked).alias("k", "r"))
    return out.select("trial", (F.col("k") + 1).alias("position"), F.col("r.s").alias(spk))


def realise(pools: DataFrame, utts: DataFrame, enrol: int, seed: int, spk: str = "spk", utt: str = "utt") -> DataFrame:
    """Trial, spk, utt, role: a probe of the target and up to `enrol` other utterances of every pool speaker."""
    u = utts.select(spk, utt)
    ranked = pools.join(u, spk).withColumn("h", draw(F.lit(seed), F.col("trial"), F.col(utt)))
    w = Window.partitionBy("trial", spk).orderBy("h", utt)
    ranked = ranked.withColumn("rn", F.row_number().over(w))
    skip = F.when(F.col("position") == 1, 1).otherwise(0)
    role = F.when((F.col("position") == 1) & (F.col("rn") == 1), "probe").otherwise("enroll")
    return ranked.where(F.col("rn") <= enrol + skip).select("trial", spk, utt, role.alias("role"))


def calibration_trials(utts: DataFrame, n: int, seed: int, utt: str = "utt", band: str = "band") -> DataFrame:
    """N draws of (enroll, test) for each pair of duration bands, with replacement, inside speakers' lists.

    utts has spk, utt and band; the draw of a list is the utterance at a hashed position.
    """
    lists = utts.groupBy("spk").pivot(band, ["short", "long"]).agg(F.sort_array(F.collect_list(utt)))
    k = lists.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    kinds = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("short", "short"), ("short", "long"), ("long", "long"))]))
    rows = k.select("*", kinds.alias("kind"))

    def pick(side: str) -> Column:
        of = F.when(F.col(f"kind.{side}") == "short", F.col("short")).otherwise(F.col("long"))
        at = F.conv(F.substring(draw(F.lit(seed), F.col("spk"), F.col("k"), F.col("kind.a"), F.col("kind.b"), F.lit(side)), 1, 8), 16, 10).cast("long")
        return F.when(F.size(of) > 0, F.get(of, (at % F.greatest(F.size(of), F.lit(1))).cast("int")))

    return rows.select("spk", "k", F.concat_ws("-", "kind.a", "kind.b").alias("kind"), pick("a").alias("enroll"), pick("b").alias("test")).where("enroll is not null and test is not null")


def best_ranges(df: DataFrame, group: str, target: float, low: float = 0.7, high: float = 1.3, keep: int = 3) -> DataFrame:
    """Contiguous runs of segments whose length from first begin to last end is near the target: the `keep` closest.

    df has group, pos, b, e; runs are made inside the group's ordered array.
    """
    lists = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "b", "e"))).alias("s"))
    ranges = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice(F.col("s"), i + 1, F.size("s") - i), lambda y: F.struct(x["pos"].alias("i"), y["pos"].alias("j"), (y["e"] - x["b"]).alias("len")))))
    fit = F.filter(ranges, lambda r: (r["len"] >= low * target) & (r["len"] <= high * target))
    closest = F.slice(F.array_sort(F.transform(fit, lambda r: F.struct(F.abs(r["len"] - target).alias("off"), r["i"].alias("i"), r["j"].alias("j")))), 1, keep)
    return lists.select(group, F.explode(closest).alias("r")).select(group, "r.i", "r.j", "r.off")
