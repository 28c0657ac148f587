"""Archives of vectors and tar shards: round trips, pushed filters, damage, and what failed jobs leave."""

import io
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspan.sources import archives as A
from vecspan.sources import shards as S


@pytest.fixture
def vectors(spark, tmp_path):
    A.register(spark)
    rows = spark.createDataFrame([(f"k{i}", [float(i), i / 4, -1.0]) for i in range(200)], "key string, vector array<float>").repartition(3)
    uri = str(tmp_path / "a")
    rows.write.format("vector_archive").mode("append").save(uri)
    return rows, uri


def test_archive_round_trip(spark, vectors):
    rows, uri = vectors
    for split in ("50", "100000"):
        got = spark.read.format("vector_archive").option("indexSplitBytes", split).load(uri)
        assert got.count() == 200 and got.exceptAll(rows).isEmpty()
    assert not [n for n in os.listdir(uri) if n.startswith("_")]
    rows.where("key < 'k11'").write.format("vector_archive").mode("overwrite").save("file://" + uri)
    assert spark.read.format("vector_archive").load(uri).count() == rows.where("key < 'k11'").count()


def test_archive_format(tmp_path):
    """A record byte by byte, and 64-bit numbers and relative places as other tools write them."""
    assert A.record(np.array([1.0, -2.0], np.float32)) == b"\0BFV \x04\x02\0\0\0" + np.array([1, -2], "<f4").tobytes()
    body = b"a " + A.record(np.array([[1.5, 2.0]]))
    (tmp_path / "x.ark").write_bytes(body)
    (tmp_path / "x.scp").write_text("a x.ark:2\n\nb x.ark:2")
    parts = [A.IndexRange(str(tmp_path / "x.scp"), k, k + 4) for k in range(0, 24, 4)]
    assert [e[0] for p in parts for e in A.index_lines(p)] == ["a", "b"]
    reader = A.ArchiveReader(str(tmp_path), "matrix", 5)
    batches = [b.to_pylist() for p in reader.partitions() for b in reader.read(p)]
    assert batches == [[{"key": k, "matrix": [[1.5, 2.0]]}] for k in ("a", "b")]
    (tmp_path / "x.ark").write_bytes(body[:-1])
    with pytest.raises(ValueError, match="ends within"):
        A.ArchiveFile(str(tmp_path / "x.ark")).read(2)
    with pytest.raises(ValueError, match="no record"):
        A.ArchiveFile(str(tmp_path / "x.ark")).read(0)


def test_filters_reach_the_archive(spark, vectors, monkeypatch):
    """Only the wanted records' bytes are read."""
    rows, uri = vectors
    got = spark.read.format("vector_archive").load(uri).where(F.col("key").isin("k7", "k150", "none"))
    assert {r["key"] for r in got.collect()} == {"k7", "k150"}
    assert "Filter" not in got._jdf.queryExecution().optimizedPlan().toString()
    from pyspark.sql.datasource import EqualTo, In, IsNotNull

    reader = A.ArchiveReader(uri, "vector", 1000)
    other = IsNotNull(("key",))
    assert list(reader.pushFilters([In(("key",), ("k7", "k150")), other])) == [other]
    opened = []
    start = A.ArchiveFile.__init__
    monkeypatch.setattr(A.ArchiveFile, "__init__", lambda self, *a: (start(self, *a), opened.append(self))[0])
    found = [k for p in reader.partitions() for b in reader.read(p) for k in b.column(0).to_pylist()]
    assert sorted(found) == ["k150", "k7"] and sum(f.bytes_read for f in opened) == 2 * (10 + 3 * 4)
    assert list(reader.pushFilters([EqualTo(("key",), "k9")])) == [] and not any(True for p in reader.partitions() for _ in reader.read(p))


def test_archive_index_join(spark, vectors):
    rows, uri = vectors
    need = rows.where("key like '%7'").select("key")
    got = A.read_records(A.read_index(spark, uri).join(need, "key", "left_semi"), run_bytes=500)
    assert got.count() == 20 and got.exceptAll(rows).isEmpty()


def test_failed_writes_leave_nothing(spark, vectors, tmp_path):
    rows, uri = vectors
    before = sorted(os.listdir(uri))
    bad = rows.withColumn("key", F.when(F.col("key") == "k77", "two words").otherwise(F.col("key")))
    with pytest.raises(Exception, match="one word"):
        bad.write.format("vector_archive").mode("overwrite").save(uri)
    assert sorted(os.listdir(uri)) == before
    odd = spark.createDataFrame([(None, [1.0]), ("a", None), ("b", []), ("b", [2.0])], "key string, vector array<float>")
    odd.write.format("vector_archive").mode("append").save(str(tmp_path / "odd"))
    assert sorted(map(tuple, spark.read.format("vector_archive").load(str(tmp_path / "odd")).collect())) == [("b", []), ("b", [2.0])]
    odd.limit(0).write.format("vector_archive").mode("append").save(str(tmp_path / "none"))
    assert spark.read.format("vector_archive").load(str(tmp_path / "none")).count() == 0


def tar(path, members, kind=tarfile.PAX_FORMAT):
    with tarfile.open(path, "w", format=kind) as t:
        for name, value in members:
            info = tarfile.TarInfo(name)
            info.size = len(value)
            t.addfile(info, io.BytesIO(value))


@pytest.mark.parametrize("kind", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_headers_are_those_of_tarfile(tmp_path, kind):
    path = str(tmp_path / "x.tar")
    far = "d/" * 60 + "x" * 60 if kind == tarfile.USTAR_FORMAT else "d/" * 90 + "é" * 120
    tar(path, [("a.b.spk", b"s"), (far + ".wav", b"x" * 1025), ("e.txt", b""), ("c", b"1")], kind)
    fs, at = S.storage(path)
    with fs.open_input_file(at) as f, tarfile.open(path) as t:
        found = list(S.walk_headers(f, os.path.getsize(path)))
        assert [(m.name, m.offset, m.size) for m in found] == [(m.name, m.offset_data, m.size) for m in t.getmembers()]
    assert [m.key for m in found] == ["a.b", far, "e", ""]


def test_shards_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, f"k{k}", {"txt": b"t" * k, "spk": b"s%d\n" % k, "no": None}) for k in range(60)] + [(0, None, {}), (1, "none", {})], "shard long, key string, members map<string,binary>")
    uri = str(tmp_path / "s")
    S.write_shards(rows, uri)
    names = sorted(os.listdir(uri))
    assert sum(n.endswith(".tar") for n in names) == 3 and not any(n.startswith("_") for n in names)
    (listed,) = [n for n in names if n.endswith(".list")]
    assert sorted(open(f"{uri}/{listed}").read().split()) == [f"{uri}/{n}" for n in names if n.endswith(".tar")]
    index = S.index_shards(spark, uri)
    assert index.where("error is not null").isEmpty()
    for split in (600, 64 << 20):  # the small one begins within groups
        got = S.samples(S.read_groups(index, split)).collect()
        assert sorted((r["key"], r["spk"], bytes(r["members"]["txt"])) for r in got) == sorted((f"k{k}", f"s{k}", b"t" * k) for k in range(60))


def test_damaged_shards(spark, tmp_path):
    good = [("a.spk", b"1"), ("a.txt", b"x"), ("b.txt", b"y" * 600), ("a.spk", b"2"), ("c.spk", b"\xff\xfe"), ("plain", b"z")]
    tar(tmp_path / "good.tar", good)
    tar(tmp_path / "cut.tar", good)
    whole = (tmp_path / "cut.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(whole[: 5 * 512 + 100])
    (tmp_path / "bad.tar").write_bytes(b"x" * 2000)
    index = S.index_shards(spark, str(tmp_path))
    errors = {r["archive"].rpartition("/")[2]: r["error"] for r in index.where("error is not null").collect()}
    assert set(errors) == {"good.tar", "cut.tar", "bad.tar"} and "suffix" in errors["good.tar"] and "ends within" in errors["cut.tar"]
    got = {(r["archive"].rpartition("/")[2], r["group"], r["key"], r["spk"]) for r in S.samples(S.read_groups(index)).collect()}
    assert got == {("cut.tar", 0, "a", "1"), ("good.tar", 0, "a", "1"), ("good.tar", 1, "b", None), ("good.tar", 2, "a", "2")}
