"""Readers and line formats of the domain's text tables, as Spark text and JSON sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_scp(spark: SparkSession, path: str) -> DataFrame:
    """Key and the rest of the line; blank lines are skipped."""
    parts = F.split(F.trim("value"), "\\s+", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("key"), F.get(parts, F.lit(1)).alias("value"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed value a line."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """S3: the words of each line, ragged."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), "\\s+").alias("fields"))


def read_columns(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whitespace columns with names and types from a DDL schema."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    return read_table(spark, path).select(*[F.get("fields", F.lit(k)).cast(f.dataType).alias(f.name) for k, f in enumerate(fields)])


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """Rec, chan, b, e (seconds), label of SPEAKER lines."""
    f = F.col("fields")
    rows = read_table(spark, path).where(f[0] == "SPEAKER")
    return rows.select(f[1].alias("rec"), f[2].cast("int").alias("chan"), f[3].cast("double").alias("b"), (f[3].cast("double") + f[4].cast("double")).alias("e"), f[7].alias("label"))


def read_json_list(spark: SparkSession, path: str, schema: str = "key string, spk string, wav string, feat string, vad array<array<string>>") -> DataFrame:
    """JSON lines; lines that do not parse, or have no key, are dropped."""
    rows = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    return rows.where("r.key is not null").select("r.*")


def read_tsv(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Tab-separated with a header; a suffix of the first column is stripped."""
    df = spark.read.csv(path, sep="\t", header=True)
    first = df.columns[0]
    return df.withColumn(first, F.regexp_replace(F.col(first), f"\\Q{suffix}\\E$", "")) if suffix else df


def read_landmarks(spark: SparkSession, path: str, fps: float) -> DataFrame:
    """Seconds, face_idx, x, y, z and frame, rounded half to even."""
    df = spark.read.csv(path, header=True, schema="seconds double, face_idx int, x double, y double, z double")
    return df.withColumn("frame", F.bround(F.col("seconds") * fps).cast("long"))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files as (key, path, value): key is the last three path parts."""
    parts = F.split("path", "/")
    return spark.read.format("binaryFile").load(path).select(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), "/").alias("key"), "path", F.col("content").alias("value"))


def expand_tar(blobs: DataFrame) -> DataFrame:
    """Members of tar files as (key, suffix, value): the name up to its last dot, and what follows."""

    def run(batches):
        import io
        import tarfile

        import pandas as pd

        for df in batches:
            for content in df["value"]:
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        if member.isfile():
                            key, _, suffix = member.name.rpartition(".")
                            rows.append((key, suffix, tar.extractfile(member).read()))
                yield pd.DataFrame(rows, columns=["key", "suffix", "value"])

    return blobs.select("value").mapInPandas(run, "key string, suffix string, value binary")


def read_wav(blobs: DataFrame) -> DataFrame:
    """16-bit PCM WAV files as (key, sample_rate, wav): the mean of the channels, -1 to 1."""

    def run(batches):
        import io
        import wave

        import numpy as np
        import pandas as pd

        for df in batches:
            rows = []
            for key, content in zip(df["key"], df["value"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
                    rows.append((key, w.getframerate(), (x.mean(axis=1) / 32768.0).astype("float32").tolist()))
            yield pd.DataFrame(rows, columns=["key", "sample_rate", "wav"])

    return blobs.select("key", "value").mapInPandas(run, "key string, sample_rate int, wav array<float>")


def rttm_line(rec: Column, chan: Column, begin: Column, dur: Column, label: Column) -> Column:
    """K3: one interval as text."""
    return F.format_string("SPEAKER %s %d %.3f %.3f <NA> <NA> %s <NA> <NA>", rec, chan, begin, dur, label)


def segment_line(rec: Column, begin_ms: Column, end_ms: Column) -> Column:
    """K4: id, recording, begin and end in seconds."""
    return F.format_string("%s-%08d-%08d %s %.3f %.3f", rec, begin_ms, end_ms, rec, begin_ms / 1000.0, end_ms / 1000.0)


def decode_sub_segment(key: Column, frame_shift: int = 10) -> Column:
    """Struct rec, begin, end (seconds) of rec-begin_ms-end_ms-first_frame-last_frame; recordings may hold '-'."""
    p = F.regexp_extract_all(key, F.lit("^(.*)-(\\d+)-(\\d+)-(\\d+)-(\\d+)$"), F.lit(1))
    num = [F.regexp_extract(key, "^(.*)-(\\d+)-(\\d+)-(\\d+)-(\\d+)$", k).cast("long") for k in (2, 4, 5)]
    return F.struct(F.get(p, F.lit(0)).alias("rec"), ((num[0] + num[1] * frame_shift) / 1000.0).alias("begin"), ((num[0] + num[2] * frame_shift) / 1000.0).alias("end"))


def write_lines(df: DataFrame, line: Column, path: str) -> None:
    """K2 to K5: a text file of lines."""
    df.select(line.alias("value")).write.text(path)
