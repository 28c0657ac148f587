"""Samples of trials without listing what they are drawn from: ranks are drawn and turned into pairs and speakers.

Speakers, and utterances within a speaker, are numbered in the order of a hash. A rank among all pairs of one speaker
(or of different ones) names a pair: its speaker by a join with cumulative counts, the two within it by the
combinatorial number system. Ranks are drawn one in each of equal strata, so exactly as many different ones as asked for.
Everything follows from hashes of the seed, so any engine draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspan.plans.prefix import join_ranks, running_sums

#: Kinds of calibration trials: bands of the enrolled and of the tested utterance.
KINDS = (("short", "short"), ("short", "long"), ("long", "long"))


def hashed(*key: Column | str | int) -> Column:
    """A number below 2^60 from the parts, joined by ':'."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def spread_ranks(spark: SparkSession, n: int, total: int, seed: int | str) -> DataFrame:
    """i, rank: n different ranks of 0 .. total - 1, one in each of n equal strata; all of them if n is larger."""
    n = min(n, total)
    i = F.col("i")
    if n <= 0:
        return spark.range(0).select(F.col("id").alias("i"), F.col("id").alias("rank"))
    low = lambda x: x * (total // n) + F.floor(x * (total % n) / F.lit(n)).cast("long")
    return spark.range(n).select(F.col("id").alias("i")).withColumn("rank", low(i) + hashed(seed, i) % (low(i + 1) - low(i)))


def numbered(rows: DataFrame, group: list[str], key: str, seed: int | str, out: str = "place") -> DataFrame:
    """rows with their number, from 0, within their group, in the order of a hash of key; rows of a null group or key are left out."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    whole = rows.where(" and ".join(f"`{c}` is not null" for c in [*group, key])).withColumns({"_hash": h, "_bucket": F.conv(F.substring(h, 1, 3), 16, 10).cast("int")})
    return running_sums(whole, "_bucket", ["_hash", key], {out: F.lit(1)}, group).withColumn(out, F.col(out) - 1).drop("_hash", "_bucket")


def sample_pairs(rows: DataFrame, key: str, spk: str, targets: int, others: int, seed: int) -> DataFrame:
    """A, b, target: so many different pairs of rows of one speaker, and of different speakers.

    rows has one row a key. All pairs come if there are fewer. a precedes b in the order of numbers. For pairs of speakers, give each row
    its own speaker, or all one.
    """
    spark = rows.sparkSession
    placed = numbered(rows.select(spk, key), [spk], key, f"{seed}-row")
    counts = numbered(placed.groupBy(spk).agg(F.count("*").alias("n")).withColumn("_all", F.lit(0)), ["_all"], spk, f"{seed}-group", "no")
    n = F.col("n")
    counts = counts.withColumn("_bucket", F.floor(F.col("no") / 4096)).withColumn("pairs", F.floor(n * (n - 1) / 2).cast("long"))
    whole = counts.agg(F.sum("n"), F.sum("pairs")).first()
    total, n_target = whole[0] or 0, whole[1] or 0
    counts = running_sums(counts, "_bucket", ["no"], {"n_to": n, "t_to": F.col("pairs")}).withColumn("rest", F.lit(total) - F.col("n_to"))
    counts = running_sums(counts, "_bucket", ["no"], {"x_to": n * F.col("rest")}).withColumn("n_from", F.col("n_to") - n)
    n_other = total * (total - 1) // 2 - n_target
    zero = F.lit(0).alias("g")

    def drawn(k: int, of: int, to: str, own: Column, name: str) -> DataFrame:
        ranges = counts.select(zero, (F.col(to) - own).alias("lo"), F.col(to).alias("hi"), "n", "n_from", "rest")
        ranks = spread_ranks(spark, k, of, f"{seed}-{name}").select(zero, "rank")
        return join_ranks(ranks, ranges, "g", max(1, of // 4096)).withColumn("r", F.col("rank") - F.col("lo"))

    r = F.col("r")
    guess = F.floor((1 + F.sqrt(8.0 * r + 1)) / 2).cast("long")
    below = lambda b: F.floor(b * (b - 1) / 2).cast("long")
    second = F.when(below(guess) > r, guess - 1).when(below(guess + 1) <= r, guess + 1).otherwise(guess)
    same = drawn(targets, n_target, "t_to", F.col("pairs"), "target").withColumn("second", second)
    same = same.select((F.col("n_from") + r - below(F.col("second"))).alias("i"), (F.col("n_from") + F.col("second")).alias("j"), F.lit(True).alias("target"))
    rest = F.col("rest")
    apart = drawn(others, n_other, "x_to", n * F.col("rest"), "other")
    apart = apart.select((F.col("n_from") + F.expr("r div rest")).alias("i"), (F.col("n_from") + n + r % rest).alias("j"), F.lit(False).alias("target"))
    member = placed.join(counts.select(spk, "n_from"), spk).select((F.col("n_from") + F.col("place")).alias("at"), key)
    both = same.unionByName(apart).join(member.select(F.col("at").alias("i"), F.col(key).alias("a")), "i")
    return both.join(member.select(F.col("at").alias("j"), F.col(key).alias("b")), "j").select("a", "b", "target")


def open_set_pools(speakers: DataFrame, trials: int, pool: int, seed: int, open_share: float = 0.0, spk: str = "spk") -> DataFrame:
    """Trial, position, spk, target_in_gallery: for each trial `pool` different speakers, position 1 being the target.

    In about open_share of the trials the target is absent from the pool: it then has the position 0. speakers is the table of
    eligible ones, a row each; too few of them is an error. A speaker is drawn from each of equal strata of the numbered ones.
    """
    spark = speakers.sparkSession
    known = numbered(speakers.select(spk).distinct().withColumn("_all", F.lit(0)), ["_all"], spk, f"{seed}-speaker", "no").select(spk, "no")
    n, need = known.count(), pool + (open_share > 0)
    if n < need:
        raise ValueError(f"{need} eligible speakers are needed, but there are {n}")
    t = F.col("trial")
    rows = spark.range(1, trials + 1).select(F.col("id").alias("trial"), (hashed(seed, "open", F.col("id")) % 1_000_000 < round(open_share * 1_000_000)).alias("open"))
    size = F.lit(pool) + F.col("open").cast("int")
    rows = rows.withColumn("size", size).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    low = lambda k: F.floor(k * F.lit(n) / F.col("size")).cast("long")
    rows = rows.withColumn("no", low(F.col("k")) + hashed(seed, "speaker", t, F.col("k")) % (low(F.col("k") + 1) - low(F.col("k"))))
    drawn = rows.join(known, "no").groupBy("trial", "open").agg(F.sort_array(F.collect_list(F.struct(hashed(seed, "order", t, F.col("no")).alias("h"), spk))).alias("s"))
    out = drawn.select("trial", "open", F.posexplode("s").alias("p", "x"))
    return out.select("trial", (F.col("p") + F.when(F.col("open"), 0).otherwise(1)).alias("position"), F.col(f"x.{spk}").alias(spk), (~F.col("open")).alias("target_in_gallery"))


def labelled_trials(utts: DataFrame, n: int, seed: int, utt: str = "utt", spk: str = "spk", band: str = "band") -> DataFrame:
    """I, kind, enroll, test, target: n draws of a speaker and of another one, with a target and a non-target trial of each kind.

    utts has spk, utt and band (short or long); speakers without both bands are left out, and fewer than two of them
    give an error. Utterances are drawn with replacement; the two trials of a kind have one enrolled utterance.
    """
    spark = utts.sparkSession
    rows = utts.where(F.col(band).isin("short", "long")).select(F.col(spk).alias("spk"), F.col(utt).alias("utt"), F.col(band).alias("band"))
    counts = rows.groupBy("spk", "band").agg(F.count("*").alias("n"))
    both = counts.groupBy("spk").agg(F.count("*").alias("bands")).where("bands = 2").select("spk").withColumn("_all", F.lit(0))
    known = numbered(both, ["_all"], "spk", f"{seed}-speaker", "no").select("spk", "no")
    total = known.count()
    if total < 2:
        raise ValueError(f"two speakers with short and long utterances are needed, but there are {total}")
    i = F.col("i")
    draws = spark.range(n).select(F.col("id").alias("i")).withColumn("first", hashed(seed, "first", F.col("i")) % total)
    draws = draws.withColumn("second", (F.col("first") + 1 + hashed(seed, "second", i) % (total - 1)) % total)
    roles = [(f"{a}-{b}", role, who, of) for a, b in KINDS for role, who, of in (("enroll", "first", a), ("target", "first", b), ("nontarget", "second", b))]
    wanted = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.col(who).alias("no"), F.lit(of).alias("band")) for kind, role, who, of in roles])
    wanted = draws.select("i", F.explode(wanted).alias("w")).select("i", "w.*")
    wanted = wanted.join(known, "no").join(counts, ["spk", "band"])
    wanted = wanted.withColumn("place", hashed(seed, "utt", i, F.col("kind"), F.col("role")) % F.col("n"))
    found = wanted.join(numbered(rows, ["spk", "band"], "utt", f"{seed}-utt"), ["spk", "band", "place"])
    one = lambda role: F.max(F.when(F.col("role") == role, F.col("utt"))).alias(role)
    found = found.groupBy("i", "kind").agg(one("enroll"), one("target"), one("nontarget"))
    tests = F.explode(F.array(F.struct(F.col("target").alias("test"), F.lit(True).alias("target")), F.struct(F.col("nontarget").alias("test"), F.lit(False).alias("target"))))
    return found.select("i", "kind", "enroll", tests.alias("t")).select("i", "kind", "enroll", "t.test", "t.target")
