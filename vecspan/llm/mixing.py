"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled and laid end to end as a cyclic stream of words, cut into blocks of
block_words. Slot t of the schedule has the golden-ratio point frac((t + 1) / phi); the cumulative weights
map it to a source, and the k-th slot of a source takes the k-th block of its stream. A source takes exactly
its target (rounded to a word): slots past its last block are left out, and blocks for which the schedule
was too short by the points' discrepancy are appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspan.llm.common import bounded_join, fresh_names, hash_bucket, materialize, running_offset, sqrt_buckets

#: Weights dealt in turn to the sources in code point order.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK_WORDS = 1024
SEED = "mix-1"

#: Golden ratio points in fixed point: multiples of round(2**31 / phi), which is odd, modulo 2**31.
STEP, MODULUS = 1327217885, 1 << 31
#: Cumulative weights are looked up by cell of the unit interval.
CELLS = 1024


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: skey, source, idx, source_size, weight, target, need (target in whole words).

    sizes has skey, source and size. The sources share the sum of all sizes by weight; a target stops at
    max_repeats times the source's size and the excess is shared again by weight. In order of cap / weight
    this is one level: target = min(cap, level * weight).
    """
    by = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("idx", (F.row_number().over(ordered) - 1).cast("int"))
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("idx") % len(weights) + 1))
    by = by.withColumn("cap", max_repeats * F.col("source_size").cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    by = by.withColumn("level", left / open_weight).withColumn("rank", F.row_number().over(rising))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("rank", "level"))
    by = by.withColumn("level", F.coalesce(F.min(fits).over(whole)["level"], F.lit(0.0)))
    target = F.least("cap", F.col("level") * F.col("weight"))
    by = by.withColumn("target", target).withColumn("need", F.floor(target + 0.5).cast("long"))
    return by.select("skey", "source", "idx", "source_size", "weight", "target", "need")


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots: slot, idx (source), block (its number in the source's stream).

    targets is a materialized result of source_targets. Points are mapped through the cumulative weights by
    a join on cells of the unit interval, and ranked per source by counts of slot ranges.
    """
    spark = targets.sparkSession
    blocks = targets.withColumn("n_blocks", F.ceil(F.col("need") / block_words)).where("n_blocks > 0")
    total = blocks.agg(F.sum("n_blocks").alias("n")).first()["n"] or 0
    cum = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = blocks.withColumn("hi", F.sum("need").over(cum))
    spans = spans.withColumn("all", F.sum("need").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    spans = spans.select("idx", "n_blocks", ((F.col("hi") - F.col("need")) / F.col("all")).alias("lo"), (F.col("hi") / F.col("all")).alias("hi"))
    cells = F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))
    spans = spans.withColumn("cell", F.explode(cells))
    width = sqrt_buckets(total)
    point = ((F.col("slot") % MODULUS + 1) * STEP % MODULUS).cast("double") / MODULUS
    slots = spark.range(total).select(F.col("id").alias("slot"), point.alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    slots = slots.join(spans, "cell").where("lo <= u and u < hi").select("slot", "idx", "n_blocks", F.floor(F.col("slot") / width).cast("long").alias("part"))
    ranked = running_offset(slots, ["idx"], "part", ["slot"], F.lit(1), "block")
    ranked = materialize(ranked.where("block < n_blocks").select("slot", "idx", "block"), "slots")
    got = ranked.groupBy("idx").agg(F.count("*").alias("got"))
    short = blocks.join(got, "idx", "left").select("idx", "n_blocks", F.coalesce("got", F.lit(0)).alias("got")).where("got < n_blocks")
    tail = short.withColumn("block", F.explode(F.sequence("got", F.col("n_blocks") - 1)))
    n_sources = targets.count()
    tail = tail.select((F.lit(total) + F.col("block") * n_sources + F.col("idx")).alias("slot"), "idx", "block")
    return ranked.unionByName(tail)


def _sizes(docs: DataFrame, size: Column, id_col: str, source_col: str, row_col: str | None, seed: str) -> DataFrame:
    """One row per document: row, doc_id, source, skey (source, never null), size, h (place in the shuffle)."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        size.cast("long").alias("size"),
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("h"),
    )
    rows = rows.withColumn("skey", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    return materialize(rows, "sizes")


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the controls 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, seed: str = SEED, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, documents).

    mixture: slot, row, doc_id, epoch, start, n_words - what each slot of the schedule takes, as word ranges
    of documents; in the order of slot it is the training stream. documents: row, doc_id, source, size,
    source_size, target, one row per input row (row is row_col, or numbers them).

    Null and empty texts have no words and are in documents only; null is a source of its own, last in
    order; repeated rows are documents of their own; a source's documents lie in the order of
    md5(seed:doc_id), ties by size. An empty table gives empty results. Other columns are ignored.
    """
    rows = _sizes(docs, word_count(F.col(text_col).cast("string")), id_col, source_col, row_col, seed)
    targets = materialize(source_targets(rows, weights, max_repeats), "targets")
    known = targets.select("skey", "idx", "source_size", "target", "need")
    documents = bounded_join(rows, known, "skey")
    n = rows.count()
    placed = documents.where("size > 0").withColumn("bucket", hash_bucket("h", sqrt_buckets(n)))
    placed = running_offset(placed, ["idx"], "bucket", ["h", "size", "row"], F.col("size"), "at")
    placed = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    placed = placed.withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("at")).where("begin < need")
    placed = placed.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("need")))
    first, last = F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words)
    pieces = placed.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    lo = F.greatest("begin", F.col("block") * block_words)
    hi = F.least("end", (F.col("block") + 1) * block_words)
    pieces = pieces.select("row", "doc_id", "idx", "epoch", "block", (lo - F.col("begin")).alias("start"), (hi - lo).alias("n_words"))
    mixture = pieces.join(schedule(targets, block_words), ["idx", "block"])
    return mixture.select("slot", "row", "doc_id", "epoch", "start", "n_words"), documents.select("row", "doc_id", "source", "size", "source_size", "target")


def taken_words(docs: DataFrame, **options: object) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words in the mixture, repeats counted)."""
    return _taken(docs, **options).drop("row")


def _taken(docs: DataFrame, **options: object) -> DataFrame:
    mixture, documents = mix(docs, **options)
    taken = mixture.select("row", F.col("n_words").alias("taken"))
    base = documents.withColumn("taken", F.lit(0).cast("long"))
    both = base.unionByName(taken, allowMissingColumns=True)
    keep = [F.max(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return both.groupBy("row").agg(*keep, F.sum("taken").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """docs as the mix takes them: every pass over a document gives a row, the last pass cut to the words taken.

    A whole pass has the text as it is; a cut one has it up to the end of its last word. A document that the mix does
    not reach gives no row; one without a word is kept, once. Other columns stay as they are.
    """
    row, n_whole, n_cut, one_pass = fresh_names(docs, "row_number", "whole_passes", "cut_words", "one_pass")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = _taken(rows, id_col=id_col, text_col=text_col, source_col=source_col, row_col=row, **options)
    passes = taken.select(
        F.col("row").alias(row),
        F.when(F.col("size") == 0, 1).otherwise(F.expr("taken div greatest(size, 1)")).cast("int").alias(n_whole),
        F.when(F.col("size") > 0, F.col("taken") % F.greatest("size", F.lit(1))).otherwise(0).cast("int").alias(n_cut),
    )
    out = rows.join(passes.where((F.col(n_whole) > 0) | (F.col(n_cut) > 0)), row)
    out = out.withColumn(one_pass, F.explode(F.sequence(F.lit(0), F.col(n_whole) - F.when(F.col(n_cut) > 0, 0).otherwise(1))))
    words = F.slice(F.split(F.col(text_col), "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])"), 1, F.col(n_cut))
    text = F.when(F.col(one_pass) == F.col(n_whole), F.array_join(words, "")).otherwise(F.col(text_col))
    return out.withColumn(text_col, text).select(*docs.columns)
