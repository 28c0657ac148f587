"""Archives of vectors and matrices with an index, as a Spark data source and by joins on the index.

An archive holds records one after the other: key, a blank, a binary mark, the kind, the dimensions and little-endian
numbers. A line of its index is `key archive:offset`. Index files are split by bytes and archives are read at the
offsets of the wanted keys only, so neither the driver nor a task holds an index.

    register(spark)
    df.write.format("vector_archive").mode("append").save(uri)        # key string, vector array<float>
    spark.read.format("vector_archive").load(uri).where(F.col("key").isin("a", "b"))
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from vecspan.sources.storage import Staging, published, storage

#: Kinds of records (fixed values): number of dimensions and type of the numbers.
KINDS = {b"FV ": (1, "<f4"), b"DV ": (1, "<f8"), b"FM ": (2, "<f4"), b"DM ": (2, "<f8")}
MARK = b"\0B"
SCHEMAS = {"vector": "key string, vector array<float>", "matrix": "key string, matrix array<array<float>>"}
#: Bytes of index lines that a task takes.
INDEX_SPLIT = 1 << 20
#: Bytes read at once when neighbouring records are wanted.
READ_AHEAD = 1 << 20


def record(values: np.ndarray) -> bytes:
    """A vector or matrix as a record, without its key."""
    kind = (b"D" if values.dtype == np.float64 else b"F") + (b"V " if values.ndim == 1 else b"M ")
    sizes = b"".join(b"\x04" + struct.pack("<i", n) for n in values.shape)
    return MARK + kind + sizes + values.astype(KINDS[kind][1]).tobytes()


class ArchiveFile:
    """One archive, read at offsets; bytes_read counts what is taken from storage."""

    def __init__(self, uri: str, ahead: int = READ_AHEAD) -> None:
        fs, path = storage(uri)
        self._file, self._ahead = fs.open_input_file(path), ahead
        self._begin, self._held = 0, b""
        self.bytes_read = 0

    def _take(self, at: int, n: int) -> bytes:
        if not self._begin <= at <= at + n <= self._begin + len(self._held):
            self._held = self._file.read_at(max(n, self._ahead), at)
            self._begin, self.bytes_read = at, self.bytes_read + len(self._held)
        out = self._held[at - self._begin : at - self._begin + n]
        if len(out) < n:
            raise ValueError(f"the archive ends within the record at byte {at}")
        return out

    def read(self, offset: int) -> np.ndarray:
        """The record at an offset of the index."""
        head = self._take(offset, 10)
        if head[:2] != MARK or head[2:5] not in KINDS:
            raise ValueError(f"no record of a vector or matrix at byte {offset}")
        dims, kind = KINDS[head[2:5]]
        size = [struct.unpack("<i", self._take(offset + 6 + 5 * k, 4))[0] for k in range(dims)]
        n = int(np.prod(size)) * np.dtype(kind).itemsize
        return np.frombuffer(self._take(offset + 5 + 5 * dims, n), kind).reshape(size)

    def close(self) -> None:
        self._file.close()


def split_place(value: str) -> tuple[str, int]:
    """Archive and offset of an index line's second field."""
    archive, _, offset = value.rpartition(":")
    return archive, int(offset)


def _records(entries: Iterator[tuple[str, str, int]], ahead: int) -> Iterator[tuple[str, np.ndarray]]:
    """(key, values) of (key, archive, offset); an archive stays open as long as entries name it."""
    at, name = None, None
    for key, archive, offset in entries:
        if archive != name:
            if at:
                at.close()
            at, name = ArchiveFile(archive, ahead), archive
        yield key, at.read(offset)
    if at:
        at.close()


def _batches(found: Iterator[tuple[str, np.ndarray]], column: str) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.float32()) if column == "vector" else pa.list_(pa.list_(pa.float32()))
    keys, values, size = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, kind)], names=["key", column])

    for key, x in found:
        if (x.ndim == 1) != (column == "vector"):
            raise ValueError(f"the record of {key} is no {column}")
        keys.append(key)
        values.append(x.astype(np.float32) if x.ndim == 1 else [row.astype(np.float32) for row in x])
        size += x.nbytes
        if size > 8 << 20:
            yield batch()
            keys, values, size = [], [], 0
    if keys:
        yield batch()


@dataclass
class IndexRange(InputPartition):
    """The lines of an index file that begin in a range of its bytes."""

    uri: str
    begin: int
    end: int


def index_lines(part: IndexRange) -> Iterator[tuple[str, str, int]]:
    """(key, archive, offset) of a range of an index file; relative archives are looked for beside it."""
    fs, path = storage(part.uri)
    folder = part.uri.rpartition("/")[0]
    with fs.open_input_file(path) as f:
        at = max(0, part.begin - 1)
        f.seek(at)
        left, skip = b"", part.begin > 0
        while at < part.end or left:
            block = f.read(1 << 16)
            if not block and not left:
                break
            lines = (left + block).split(b"\n")
            left = lines.pop() if block else b""
            for line in lines:
                begin, at = at, at + len(line) + 1
                if skip:
                    skip = False
                elif begin >= part.end:
                    return
                elif line.strip():
                    key, _, value = line.decode().strip().partition(" ")
                    archive, offset = split_place(value.strip())
                    yield key, archive if archive.startswith("/") or "://" in archive else f"{folder}/{archive}", offset


class ArchiveReader(DataSourceReader):
    def __init__(self, uri: str, column: str, split: int) -> None:
        self._uri, self._column, self._split = uri, column, split
        self._keys: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Equality and lists of keys are left to the index, so other records are not read."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("key",):
                keys = set(f.value if isinstance(f, In) else [f.value])
                self._keys = keys if self._keys is None else self._keys & keys
            else:
                yield f

    def partitions(self) -> list[IndexRange]:
        out = []
        for name, size in published(self._uri, (".scp",)):
            uri = f"{self._uri}/{name}" if name else self._uri
            out += [IndexRange(uri, at, min(size, at + self._split)) for at in range(0, size, self._split)]
        return out

    def read(self, partition: IndexRange | None) -> Iterator:
        entries = index_lines(partition) if partition else iter(())  # none at all is one of None
        if self._keys is not None:
            entries = (e for e in entries if e[0] in self._keys)
        return _batches(_records(entries, READ_AHEAD if self._keys is None else 0), self._column)


@dataclass
class Written(WriterCommitMessage):
    """The name of a task's archive and index, without their endings; null if it had no rows."""

    name: str | None


class ArchiveWriter(DataSourceArrowWriter):
    """A task writes an archive and its index; the commit publishes all archives, then all indexes."""

    def __init__(self, uri: str, overwrite: bool) -> None:
        self._staging, self._overwrite = Staging(uri), overwrite

    def write(self, iterator: Iterator) -> Written:
        name, at, archive, index = f"part-{uuid.uuid4().hex}", 0, None, None
        try:
            for batch in iterator:
                for key, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if key is None or not values.is_valid:
                        continue
                    if not key or key.split() != [key]:
                        raise ValueError(f"a key of an archive must be one word: {key!r}")
                    if archive is None:
                        archive, index = self._staging.create(f"{name}.ark"), self._staging.create(f"{name}.scp")
                    head, body = f"{key} ".encode(), record(np.array(values.as_py(), np.float32))
                    archive.write(head + body)
                    index.write(f"{key} {self._staging.target(name)}.ark:{at + len(head)}\n".encode())
                    at += len(head) + len(body)
        finally:
            for file in (archive, index):
                if file:
                    file.close()
        return Written(name if archive else None)

    def commit(self, messages: list) -> None:
        names = [m.name for m in messages if m and m.name]
        old = self._staging.old_files((".scp", ".ark")) if self._overwrite else []
        self._staging.publish([f"{n}.ark" for n in names])
        self._staging.remove([n for n in old if n.endswith(".scp")])
        self._staging.publish([f"{n}.scp" for n in names])
        self._staging.remove([n for n in old if n.endswith(".ark")])
        self._staging.clear()

    def abort(self, messages: list) -> None:
        self._staging.clear()


class VectorArchive(DataSource):
    """Options: path (a folder of indexes, or one index), kind (vector or matrix), indexSplitBytes.

    Rows with a null key or null values have no record; repeated keys have one each, and an empty table writes no
    file. A key that is empty or holds white space is an error. Values are 32-bit floats; archives of 64-bit ones
    are read as such.
    """

    @classmethod
    def name(cls) -> str:
        return "vector_archive"

    def _kind(self) -> str:
        return self.options.get("kind", "vector")

    def schema(self) -> str:
        return SCHEMAS[self._kind()]

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"].rstrip("/"), self._kind(), int(self.options.get("indexSplitBytes", INDEX_SPLIT)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VectorArchive)


def read_index(spark: SparkSession, uri: str) -> DataFrame:
    """key, archive, offset: the index as a table, to be filtered and joined before any record is read."""
    parts = F.split(F.trim("value"), "\\s+", 2)
    place = F.regexp_extract_all(F.get(parts, F.lit(1)), F.lit("^(.*):([0-9]+)$"), F.lit(1))
    offset = F.regexp_extract(F.get(parts, F.lit(1)), ":([0-9]+)$", 1).cast("long")
    lines = spark.read.option("pathGlobFilter", "*.scp").text(uri).where(F.trim("value") != "")
    archive = F.get(place, F.lit(0))
    beside = F.concat(F.regexp_replace(F.input_file_name(), "[^/]*$", ""), archive)
    return lines.select(parts[0].alias("key"), F.when(archive.rlike("^/|://"), archive).otherwise(beside).alias("archive"), offset.alias("offset"))


def read_records(index: DataFrame, column: str = "vector", run_bytes: int = 64 << 20) -> DataFrame:
    """The records of (key, archive, offset): a task reads those of some runs of bytes, in order, and nothing else."""

    def read(batches: Iterator) -> Iterator:
        def entries() -> Iterator[tuple[str, str, int]]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        return _batches(_records(entries(), 0), column)

    dealt = index.select("key", "archive", "offset", F.floor(F.col("offset") / run_bytes).alias("run"))
    dealt = dealt.repartition("archive", "run").sortWithinPartitions("archive", "offset").drop("run")
    return dealt.mapInArrow(read, SCHEMAS[column])
