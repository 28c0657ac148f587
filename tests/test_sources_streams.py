import io
import tarfile
import wave

import numpy as np

from vecspan.sources import text as T
from vecspan.streaming import online as O


def test_text_sources(spark, tmp_path):
    (tmp_path / "wav.scp").write_text("u1 /d/u1.wav\nu2 sox a b |\n\n")
    assert [tuple(r) for r in T.read_scp(spark, str(tmp_path / "wav.scp")).collect()] == [("u1", "/d/u1.wav"), ("u2", "sox a b |")]
    (tmp_path / "r.rttm").write_text("SPEAKER rec1 1 0.500 1.750 <NA> <NA> s1 <NA> <NA>\n")
    assert tuple(T.read_rttm(spark, str(tmp_path / "r.rttm")).first()) == ("rec1", 1, 0.5, 2.25, "s1")
    (tmp_path / "raw.list").write_text('{"key": "a", "spk": "s", "wav": "x"}\nnot json\n')
    assert T.read_json_list(spark, str(tmp_path / "raw.list")).count() == 1
    (tmp_path / "n").write_text("rec1 3\n")
    assert tuple(T.read_columns(spark, str(tmp_path / "n"), "rec string, n int").first()) == ("rec1", 3)
    assert T.read_list(spark, str(tmp_path / "n")).first()["value"] == "rec1 3"
    (tmp_path / "k.tsv").write_text("id\tx\na.sph\t1\n")
    assert T.read_tsv(spark, str(tmp_path / "k.tsv"), ".sph").first()["id"] == "a"
    (tmp_path / "l.csv").write_text("seconds,face_idx,x,y,z\n0.5,0,1,2,3\n")
    assert T.read_landmarks(spark, str(tmp_path / "l.csv"), 25).first()["frame"] == 12


def test_binary_sources(spark, tmp_path):
    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(np.array([[16384, 0], [0, 0]], "<i2").tobytes())
    (tmp_path / "x.wav").write_bytes(b.getvalue())
    row = T.read_wav(T.read_blobs(spark, str(tmp_path / "x.wav"))).first()
    assert row["sample_rate"] == 16000 and list(row["wav"]) == [0.25, 0.0]
    with tarfile.open(tmp_path / "s.tar", "w") as t:
        for name, data in (("k1.spk", b"s1"), ("k1.wav", b.getvalue())):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    assert sorted(tuple(r)[:2] for r in T.expand_tar(T.read_blobs(spark, str(tmp_path / "s.tar"))).collect()) == [("k1", "spk"), ("k1", "wav")]


def run(df, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table("out").collect()


def test_streams(spark, tmp_path):
    rows = [("r1", k, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in range(6)]
    batch = spark.createDataFrame(rows, "rec string, seq long, v array<double>")
    batch.write.parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "v"))
    got = sorted(run(O.online_clusters(stream)))
    assert [r["cluster"] for r in got] == [0, 1, 0, 1, 0, 1]
    named = O.identify_stream(batch, [("a", [1.0, 0.0]), ("b", [0.0, 2.0])], 0.5).orderBy("seq").collect()
    assert [r["spk"] for r in named] == ["b", "a"] * 3
    waves = spark.createDataFrame([("r", 0, [1.0, 2.0, 3.0]), ("r", 1, [4.0, 5.0])], "rec string, seq long, samples array<double>")
    waves.write.parquet(str(tmp_path / "w"))
    frames = sorted(run(O.frames_with_carry(spark.readStream.schema(waves.schema).parquet(str(tmp_path / "w")), 2, 2)))
    assert [r["x"] for r in frames] == [[1.0, 2.0], [3.0, 4.0]]
    gated = spark.createDataFrame([([1, 1, 0],), ([0, 2, 1],)], "classes array<int>")
    assert O.gate(gated).count() == 1
    ev = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:10:00")], "k string, t string")
    ev = ev.selectExpr("k", "cast(t as timestamp_ntz) ts")
    ev.write.parquet(str(tmp_path / "e"))
    es = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "e"))
    assert len(run(O.distinct_stream(es, "ts", ["k"]))) == 1
    assert len(run(O.hopping_counts(es, "ts", "k"), "complete")) == 2
    assert O.session_counts(es, "ts", "k").isStreaming
