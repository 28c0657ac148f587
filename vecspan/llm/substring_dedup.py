"""Substring deduplication by unit hashing: of a passage that occurs more than once, the first occurrence stays.

Units are the lines of a text, cut further at the ends of sentences; they are normalised to their lower-case words.
Their digests are grouped globally and the occurrence of the lowest rank (document, then place) is kept. Neighbouring
units of a text that all stand earlier elsewhere make up a run: a repeated sentence, line, paragraph or longer
passage. Runs of at least min_words words are cut out of the text, with their original offsets retained.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspan.llm.common import BROADCAST_ROWS, materialize

#: Repeated runs of fewer words stay, as short lines repeat without being copies; 1 removes every repeated unit.
MIN_WORDS = 25

#: Pieces that make up a text: up to the end of a sentence or line. Words: runs of other characters than ASCII's
#: controls, blanks and punctuation. The same in Java and RE2.
PIECE = "[^.!?\\n]*[.!?\\n]+|[^.!?\\n]+"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_PIECE, _WORD = re.compile(PIECE), re.compile(WORD)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def document_units(numbered: DataFrame) -> DataFrame:
    """row, doc_id, units: of every unit that has a word its digest, number of words, begin and end (characters)."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fields = [("digest", pa.binary()), ("n_words", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            ends = [0]
            for text in batch.column(2):
                for piece in _PIECE.finditer(text.as_py() or ""):
                    if words := _WORD.findall(piece.group().lower()):
                        digest = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        for column, value in zip(columns, (digest, len(words), *piece.span())):
                            column.append(value)
                ends.append(len(columns[0]))
            units = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], fields=[pa.field(*f) for f in fields])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), units)], names=["row", "doc_id", "units"])

    return numbered.select("row", "doc_id", "text").mapInArrow(cut, "row long, doc_id long, units array<struct<digest: binary, n_words: int, begin: int, end: int>>")


def repeated_units(units: DataFrame) -> DataFrame:
    """row, unit, n_words, begin, end, kept_id of the units (row, doc_id, unit, digest, ...) that stand earlier elsewhere.

    Occurrences rank by doc_id (null last), row and unit. Digests are counted with partial sums; those that occur so
    often that one task should not hold their rows are few by their number, and are looked up by broadcast.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "unit")
    counted = units.groupBy("digest").agg(F.count("*").alias("copies"), F.min(rank).alias("first")).where("copies > 1")
    counted = materialize(counted, "repeats", "zstd")
    total = counted.agg(F.sum("copies")).first()[0] or 0
    most = max(10_000, -(-total // BROADCAST_ROWS))  # at most BROADCAST_ROWS digests have more copies
    hot = F.broadcast(counted.where(F.col("copies") > most))
    found = units.join(hot, "digest").unionByName(units.join(counted.where(F.col("copies") <= most), "digest"))
    return found.withColumn("rank", rank).where("rank <> first").select("row", "unit", "n_words", "begin", "end", F.col("first.doc_id").alias("kept_id"))


def removed_runs(per_document: DataFrame, min_words: int) -> DataFrame:
    """row, removed: the runs to cut out, in order, each with begin, end, n_units, n_words and the ids whose text stays."""
    units = per_document.select("row", "doc_id", F.posexplode("units").alias("unit", "u")).select("row", "doc_id", "unit", "u.*")
    order = Window.partitionBy("row").orderBy("unit")
    runs = repeated_units(units).withColumn("island", F.col("unit") - F.row_number().over(order))
    runs = runs.groupBy("row", "island").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").cast("int").alias("n_units"),
        F.sum("n_words").cast("int").alias("n_words"), F.array_sort(F.collect_set("kept_id")).alias("kept_ids"),
    )
    run = F.struct("begin", "end", "n_units", "n_words", "kept_ids")
    return runs.where(F.col("n_words") >= min_words).groupBy("row").agg(F.sort_array(F.collect_list(run)).alias("removed"))


def duplicate_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_units, removed (runs with begin and end in characters of the original text), kept.

    kept: nothing is removed. Null, empty and wordless texts have no unit. A unit that a text itself repeats stays
    where it comes first; of repeated rows one keeps its text, the others lose all of it (if it has min_words
    words). An empty table gives an empty result. Other columns are ignored.
    """
    per_document = materialize(document_units(_numbered(docs, id_col, text_col)), "units", "zstd")
    return _with_removed(per_document, min_words).drop("row")


def _with_removed(per_document: DataFrame, min_words: int) -> DataFrame:
    runs = removed_runs(per_document, min_words)
    out = per_document.select("row", "doc_id", F.size("units").cast("long").alias("n_units")).join(runs, "row", "left")
    return out.select("row", "doc_id", "n_units", F.coalesce("removed", F.array()).alias("removed"), F.col("removed").isNull().alias("kept"))


def dedup_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: doc_id, text without the removed runs, removed, kept; cases as in duplicate_passages."""
    numbered = materialize(_numbered(docs, id_col, text_col), "numbered", "zstd")
    per_document = materialize(document_units(numbered), "units", "zstd")
    joined = numbered.select("row", "text").join(_with_removed(per_document, min_words), "row")
    begins = F.concat(F.array(F.lit(0)), F.transform("removed", lambda r: r["end"]))
    ends = F.concat(F.transform("removed", lambda r: r["begin"]), F.array(F.length("text")))
    left = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a)), "")
    return joined.select("doc_id", F.when(F.col("kept"), F.col("text")).otherwise(left).alias("text"), "removed", "kept")
