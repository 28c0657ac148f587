"""The test tables in their domain roles: utterances, vectors, trials, intervals, data directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt, spk, lang, dur (seconds) from documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("utt"), F.col("source").alias("spk"), "lang", (F.col("n_chars") / 100.0).alias("dur"))


UTT = "utt AS (SELECT 'u' || doc_id AS utt, source AS spk, lang, n_chars::DOUBLE / 100 AS dur FROM documents)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt, spk, v (doubles) from embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("utt"), F.col("label").alias("spk"), F.col("embedding").cast("array<double>").alias("v"))


#: The queries of a trial list, against all rows; the others are the enrolment side where both should differ.
QUERY, GALLERY = "utt % 50 = 0", "utt % 50 <> 0"

VEC = "vec AS (SELECT vec_id AS utt, label AS spk, embedding::DOUBLE[] AS v FROM embeddings)"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, rec, label, b, e (whole milliseconds) from events."""
    e = table(spark, sf_dir, "events")
    b = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    e = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("rec"), F.col("event_type").alias("label"), b.alias("b"), F.round(F.col("value") * 100000).cast("long").alias("d"))
    return e.select("id", "rec", "label", "b", (F.col("b") + F.col("d")).alias("e"))


IV = "iv AS (SELECT event_id AS id, user_id % 20 AS rec, event_type AS label, epoch_us(ts) // 1000 AS b, epoch_us(ts) // 1000 + CAST(round(value * 100000) AS BIGINT) AS e FROM events)"


def target_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, score, target, cond from labels and documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    lab = table(spark, sf_dir, "labels")
    return lab.join(d, "doc_id").select(F.col("doc_id").alias("key"), ((F.col("n_chars") % 1000) / 250.0 - 2.0).alias("score"), (F.col("quality") == 1).alias("target"), F.col("lang").alias("cond"))


SCORES = "sc AS (SELECT l.doc_id AS key, (n_chars % 1000)::DOUBLE / 250 - 2 AS score, quality = 1 AS target, lang AS cond FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
