"""Tar shards: an index of their members, groups of members that belong together, and a writer.

Headers are walked once, by a task for each archive that reads nothing else. Members that follow each other with one
name up to the last dot are a group; a split takes the groups that begin in its range of bytes, so several tasks read
one archive and no group is cut. A damaged archive gives the groups before the damage and one row of the errors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from vecspan.sources.storage import Staging, storage

BLOCK = 512
#: Bytes of an archive that one task reads.
SPLIT = 64 << 20


@dataclass(frozen=True)
class Member:
    """A file of an archive: its name, and where its content lies."""

    name: str
    offset: int
    size: int

    @property
    def key(self) -> str:
        return self.name.rpartition(".")[0]

    @property
    def suffix(self) -> str:
        return self.name.rpartition(".")[2]


def _number(field: bytes) -> int:
    """A header's number: octal digits, or base 256 if the first bit is set; -1 for anything else."""
    if field[0] & 0x80:
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    digits = field.strip(b" \0") or b"0"
    return int(digits, 8) if set(digits) <= set(b"01234567") else -1


def _text(field: bytes) -> str:
    return field.split(b"\0", 1)[0].decode("utf-8", "replace")


def _extended(content: bytes) -> dict[str, str]:
    """The records of an extended header: length, blank, name=value, newline."""
    out = {}
    while content:
        length = int(content.split(b" ", 1)[0])
        name, _, value = content[:length].split(b" ", 1)[1].rstrip(b"\n").partition(b"=")
        out[name.decode()] = value.decode("utf-8", "replace")
        content = content[length:]
    return out


def walk_headers(file, size: int) -> Iterator[Member]:
    """The members of an open tar archive of `size` bytes, from their headers; a ValueError where it is damaged."""
    at, longer = 0, {}
    while at + BLOCK <= size:
        head = file.read_at(BLOCK, at)
        if not head.strip(b"\0"):
            return
        plain = head[:148] + b" " * 8 + head[156:]
        if len(head) < BLOCK or _number(head[148:156]) != sum(plain):
            raise ValueError(f"no header of a member at byte {at}")
        n, kind = max(0, _number(head[124:136])), head[156:157]
        if "size" in longer:
            n = int(longer["size"])
        begin = at + BLOCK
        at = begin + -(-n // BLOCK) * BLOCK
        if begin + n > size:
            raise ValueError(f"the archive ends within the member at byte {begin}")
        if kind == b"L":
            longer = {**longer, "path": _text(file.read_at(n, begin))}
        elif kind == b"x":
            longer = {**longer, **_extended(file.read_at(n, begin))}
        else:
            if kind in (b"0", b"\0"):
                prefix = _text(head[345:500]) if head[257:262] == b"ustar" and head[257:265] != b"ustar  \0" else ""
                name = longer.get("path") or (f"{prefix}/" if prefix else "") + _text(head[:100])
                yield Member(name, begin, n)
            if kind != b"g":
                longer = {}
    if at < size or at == 0:
        raise ValueError(f"the archive ends within the header at byte {at}")


def index_shards(spark: SparkSession, path: str) -> DataFrame:
    """archive, group, key, members (array of suffix, offset, size), error: the groups of each archive, without their content.

    A row with an error (and no group) tells of a damaged archive or of a member without a suffix, which belongs to no group.
    """

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        member = pa.struct([("suffix", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(member), pa.string()]

        def rows(archive: str, size: int) -> Iterator[tuple]:
            number, held = 0, []
            fs, path = storage(archive)
            error = None
            with fs.open_input_file(path) as file:
                try:
                    for m in walk_headers(file, size):
                        if not m.key:
                            yield archive, None, None, None, f"{m.name}: a member without a suffix"
                            continue
                        if held and held[0].key != m.key:
                            yield archive, number, held[0].key, _places(held), None
                            number, held = number + 1, []
                        held.append(m)
                except ValueError as damage:
                    error = str(damage)
            if held:
                yield archive, number, held[0].key, _places(held), None
            if error:
                yield archive, None, None, None, error

        for batch in batches:
            for archive, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out: list[tuple] = []
                for row in rows(archive, size):
                    out.append(row)
                    if len(out) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    names = ["archive", "group", "key", "members", "error"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(path).select("path", "length")
    files = files.repartition("path")
    return files.mapInArrow(walk, "archive string, group long, key string, members array<struct<suffix:string,offset:long,size:long>>, error string")


def _places(members: list[Member]) -> list[dict]:
    return [{"suffix": m.suffix, "offset": m.offset, "size": m.size} for m in members]


def read_groups(index: DataFrame, split: int = SPLIT) -> DataFrame:
    """archive, group, key, members (map of suffix to content) of the groups of index_shards, which may be filtered before.

    Of members of one suffix in a group the last one counts. Rows with an error are left out.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        content = pa.map_(pa.string(), pa.binary())
        file, name = None, None
        for batch in batches:
            out, size = [], 0
            for archive, group, key, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    if file:
                        file.close()
                    fs, path = storage(archive)
                    file, name = fs.open_input_file(path), archive
                values = {m["suffix"]: file.read_at(m["size"], m["offset"]) for m in members}
                out.append((archive, group, key, list(values.items())))
                size += sum(map(len, values.values()))
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), content))], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), content))], names=names)
        if file:
            file.close()

    names = ["archive", "group", "key", "members"]
    groups = index.where("error is null").withColumn("part", F.floor(F.col("members")[0]["offset"] / split))
    dealt = groups.repartition("archive", "part").sortWithinPartitions("archive", "group").select(names)
    return dealt.mapInArrow(read, "archive string, group long, key string, members map<string,binary>")


def samples(groups: DataFrame, text: str = "spk") -> DataFrame:
    """groups with the member `text` as a trimmed string column of that name; groups where it is no UTF-8 are dropped.

    A group without that member has a null there.
    """
    raw = F.element_at("members", text)
    value = F.try_validate_utf8(raw)
    out = groups.withColumn(text, F.regexp_replace(value.cast("string"), "^\\s+|\\s+$", ""))
    return out.where(raw.isNull() | F.col(text).isNotNull())


@dataclass
class Written(WriterCommitMessage):
    """Names of a task's archives."""

    names: list[str]


class ShardWriter(DataSourceArrowWriter):
    """A task writes an archive for each run of rows of one shard; the commit moves all into place and lists them last."""

    def __init__(self, uri: str, overwrite: bool, prefix: str) -> None:
        self._staging, self._overwrite, self._prefix = Staging(uri), overwrite, prefix

    def write(self, iterator: Iterator) -> Written:
        import io
        import tarfile

        names, shard, tar, out = [], None, None, None

        def close() -> None:
            if tar:
                tar.close()
                out.close()

        try:
            for batch in iterator:
                for number, key, members in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist(), batch.column("members"), strict=True):
                    if number != shard or tar is None:
                        close()
                        shard = number
                        names.append(f"{self._prefix}_{number:09d}-{uuid.uuid4().hex[:12]}.tar")
                        out = self._staging.create(names[-1])
                        tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.PAX_FORMAT)
                    for suffix, value in members.as_py() or []:
                        if value is not None:
                            info = tarfile.TarInfo(f"{key}.{suffix}")
                            info.size = len(value)
                            tar.addfile(info, io.BytesIO(value))
        finally:
            close()
        return Written(names)

    def commit(self, messages: list) -> None:
        names = sorted(n for m in messages if m for n in m.names)
        old = self._staging.old_files((".tar", ".list")) if self._overwrite else []
        self._staging.publish(names)
        lines = f"{self._prefix}-{self._staging.job}.list"
        with self._staging.create(lines) as f:
            f.write("".join(f"{self._staging.target(n)}\n" for n in names).encode())
        self._staging.remove([n for n in old if n.endswith(".list")])
        self._staging.publish([lines])
        self._staging.remove([n for n in old if n.endswith(".tar")])
        self._staging.clear()

    def abort(self, messages: list) -> None:
        self._staging.clear()


class TarShards(DataSource):
    """For writing: rows (shard long, key string, members map<string,binary>), those of a shard next to each other.

    Options: path, prefix. Null members are left out, so a row of none has no entry; a null key is written as
    `None`, so filter these before. Use write_shards, which deals the rows.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return "shard long, key string, members map<string,binary>"

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], overwrite, self.options.get("prefix", "shards"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarShards)


def write_shards(rows: DataFrame, uri: str, mode: str = "append", prefix: str = "shards") -> None:
    """Write rows (shard, key, members), a tar archive a shard, sorted by key within it. Rows without a key are left out."""
    register(rows.sparkSession)
    own = rows.where("key is not null and shard is not null").select("shard", "key", "members")
    dealt = own.repartition("shard").sortWithinPartitions("shard", "key")
    dealt.write.format("tar_shards").mode(mode).option("prefix", prefix).save(uri)
