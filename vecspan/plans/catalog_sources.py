"""Registered queries of the archive and shard formats: the test tables written as files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecspan.plans import roles as R
from vecspan.plans.catalog import query
from vecspan.sources import archives, shards
from vecspan.sources.storage import scratch_uri


def _archived_vectors(spark, d):
    """The vectors written as archives; the folder."""
    archives.register(spark)
    uri = scratch_uri(spark, "archives")
    e = R.table(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("key"), F.col("embedding").alias("vector"))
    e.write.format("vector_archive").mode("append").save(uri)
    return uri


@query("s06_archive_round_trip", """SELECT 'v' || vec_id AS key, len(embedding)::BIGINT AS n, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total
FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL""")
def _(spark, d):
    v = spark.read.format("vector_archive").load(_archived_vectors(spark, d))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return v.select("key", F.size("vector").cast("long").alias("n"), F.get("vector", F.lit(0)).cast("double").alias("first"), F.element_at("vector", -1).cast("double").alias("last"), F.round(total, 6).alias("total"))


@query("s07_archive_keys", """SELECT 'v' || vec_id AS key, embedding[1]::DOUBLE AS first FROM embeddings
WHERE embedding IS NOT NULL AND vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def _(spark, d):
    index = archives.read_index(spark, _archived_vectors(spark, d))
    need = R.table(spark, d, "labels").where("toxic = 1").select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("key"))
    found = archives.read_records(index.join(need, "key", "left_semi"))
    return found.select("key", F.get("vector", F.lit(0)).cast("double").alias("first"))


@query("s16_tar_shards", """SELECT 'd' || doc_id AS key, source AS spk, md5(text) AS text_md5, (row_number() OVER (PARTITION BY doc_id % 16 ORDER BY 'd' || doc_id) - 1)::BIGINT AS place, (doc_id % 16)::BIGINT AS shard
FROM documents WHERE doc_id IS NOT NULL AND (text IS NOT NULL OR source IS NOT NULL)""")
def _(spark, d):
    docs = R.table(spark, d, "documents").where("doc_id is not null")
    members = F.create_map(F.lit("spk"), F.col("source").cast("binary"), F.lit("txt"), F.col("text").cast("binary"))
    uri = scratch_uri(spark, "shards")
    shards.write_shards(docs.select((F.col("doc_id") % 16).alias("shard"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), members.alias("members")), uri)
    groups = shards.samples(shards.read_groups(shards.index_shards(spark, uri)))
    shard = F.regexp_extract("archive", "_([0-9]+)-[0-9a-f]+[.]tar$", 1).cast("long")
    return groups.select("key", "spk", F.md5(F.element_at("members", "txt")).alias("text_md5"), F.col("group").alias("place"), shard.alias("shard"))
