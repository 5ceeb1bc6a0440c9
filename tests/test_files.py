"""Recordings in byte ranges, files published as a whole, rates."""

import struct
import time
import wave

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomspan.operators import features as X
from loomspan.sources import pcm, published as B, scans
from loomspan.sources.stores import files_under, store


def recording(path, values, channels=1, width=2, rate=16_000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(b"".join(int(v).to_bytes(width, "little", signed=width > 1) for v in values))


def heard(spark, path, **options):
    rows = scans.audio(spark, str(path), **options).orderBy("path", "channel", "block_no").collect()
    out = {}
    for r in rows:
        out.setdefault((r.path.rsplit("/", 1)[-1], r.channel), []).extend(r.samples or [])
    return out


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_widths(spark, tmp_path, width):
    top = 1 << 8 * width - 1
    values = [0, 1, top - 1] if width > 1 else [128, 129, 255]
    values += [-top, -1] if width > 1 else [0, 127]
    recording(tmp_path / "a.wav", values, width=width)
    signed = values if width > 1 else [v - 128 for v in values]
    assert heard(spark, tmp_path)["a.wav", 0] == pytest.approx([v / top for v in signed])


def test_floats_odd_chunks_and_extensible(spark, tmp_path):
    x = np.array([0.5, -0.25, 1.0], "<f4")
    for name, kind, tail in (("f.wav", 3, b""), ("x.wav", 0xFFFE, struct.pack("<HHI", 22, 32, 4) + struct.pack("<H", 3) + bytes(14))):
        fmt = struct.pack("<HHIIHH", kind, 1, 8000, 32_000, 4, 32) + tail
        body = b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", 12) + x.tobytes()
        (tmp_path / name).write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    assert heard(spark, tmp_path) == {("f.wav", 0): x.tolist(), ("x.wav", 0): x.tolist()}


def test_ranges_change_nothing(spark, tmp_path):
    """Blocks are whole and the same, whatever bytes a task gets; several recordings share a task, and one is cut over many."""
    rng = np.random.default_rng(3)
    want = {}
    for name, n in (("long.wav", 50_001), ("short.wav", 3), ("none.wav", 0)):
        x = rng.integers(-32768, 32768, 2 * n)
        recording(tmp_path / name, x, channels=2)
        if n:
            want |= {(name, k): (x[k::2] / 32768).tolist() for k in (0, 1)}
    for most in ("777", "40000", "100000000"):
        got = scans.audio(spark, str(tmp_path), split_stereo=True, partitionBytes=most, blockSamples="1000")
        assert got.where("channel = 0 and size(samples) <> 1000").count() == 2
        assert heard(spark, tmp_path, split_stereo=True, partitionBytes=most, blockSamples="1000") == want
    mixed = heard(spark, tmp_path)["long.wav", 0]
    assert mixed == pytest.approx(np.mean([want["long.wav", 0], want["long.wav", 1]], axis=0).tolist(), abs=1e-7)


def test_partitions_hold_bounded_bytes():
    got = pcm.ranges([("a", 10), ("b", 25_000), ("c", 0), ("d", 5)], 10_000)
    assert [r.parts for r in got] == [[("a", 10, 0, 10)], [("b", 25_000, 0, 10_000)], [("b", 25_000, 10_000, 20_000)], [("b", 25_000, 20_000, 25_000), ("c", 0, 0, 1)], [("d", 5, 0, 5)]]
    assert pcm.ranges([], 10) == []


def test_files_that_are_no_recordings(spark, tmp_path):
    recording(tmp_path / "cut.wav", range(100))
    whole = (tmp_path / "cut.wav").read_bytes()
    (tmp_path / "cut.wav").write_bytes(whole[:-51])
    (tmp_path / "a.wav").write_bytes(b"")
    (tmp_path / "b.wav").write_bytes(b"RIFF....WAVEfmt ")
    (tmp_path / "c.txt").write_text("c")
    assert [len(v) for v in heard(spark, tmp_path).values()] == [74]
    told = scans.audio(spark, str(tmp_path), mode="PERMISSIVE").where("error is not null").orderBy("path").collect()
    assert [(r.path.rsplit("/", 1)[-1], r.error, r.samples) for r in told] == [("a.wav", "no RIFF WAVE file", None), ("b.wav", "no samples", None)]
    with pytest.raises(PySparkException):
        scans.audio(spark, str(tmp_path), mode="FAILFAST").count()
    assert scans.audio(spark, f"{tmp_path}/nothing*").count() == 0


def test_publish_and_archive(spark, tmp_path):
    where = str(tmp_path / "out")
    rows = lambda *names: spark.createDataFrame([(n, f"text of {n}") for n in names], "name string, content string").repartition(3)
    B.publish(rows("a.txt", "deep/b.txt", "ü ö.txt"), where, "r1")
    read = lambda run=None: {r.name: bytes(r.content).decode() for r in B.read_published(spark, where, run).collect()}
    first = {n: f"text of {n}" for n in ("a.txt", "deep/b.txt", "ü ö.txt")}
    assert read() == first
    B.publish(rows("c.txt"), where, "r2")
    assert (read(), read("r1"), B.runs(where)) == ({"c.txt": "text of c.txt"}, first, ["r1", "r2"])
    B.publish(rows("a.txt", "deep/b.txt", "ü ö.txt"), where, "r1")
    assert read() == read("r1") == first and len(files_under(*store(f"{where}/r1"))) == 4
    B.publish(rows("d.txt"), where, overwrite=True)
    assert list(read()) == ["d.txt"] and len(B.runs(where)) == 1
    B.publish(rows("d.txt").where("false"), where, "r9")
    assert read() == {}
    with pytest.raises(FileNotFoundError):
        B.folders(where, "never")


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    where = str(tmp_path / "out")
    good = spark.range(40).selectExpr("concat(id, '.txt') as name", "'x' as content")
    B.publish(good, where, "r1")
    bad = good.repartition(4).withColumn("content", F.expr("if(name = '7.txt', raise_error('no'), content)"))
    for name in ("r2", "r1"):
        with pytest.raises(PySparkException):
            B.publish(bad, where, name)
        assert B.runs(where) == ["r1"] and B.read_published(spark, where).count() == 40
    time.sleep(2)  # tasks that still ran fail, as their folder is gone
    assert len(files_under(*store(where))) == 42
    for name in ("../x", "/x", "a//b", "", "_latest"):
        with pytest.raises(PySparkException):
            B.publish(good.limit(1).withColumn("name", F.lit(name)), where, "r3")
    with pytest.raises(PySparkException):
        B.publish(good.coalesce(1).withColumn("name", F.lit("same")), where, "r3")
    assert B.runs(where) == ["r1"] and not (tmp_path / "x").exists()


def test_null_content_and_bytes(spark, tmp_path):
    """A file without bytes is written; Spark's readers pass over it."""
    B.publish(spark.createDataFrame([("a", None), ("b", bytearray(b"\xff\x00"))], "name string, content binary"), str(tmp_path))
    assert sorted(size for p, size in files_under(*store(str(tmp_path))) if "/part-" in p) == [0, 2]
    assert {r.name: bytes(r.content) for r in B.read_published(spark, str(tmp_path)).collect()} == {"b": b"\xff\x00"}


def test_recordings_round_trip(spark, tmp_path):
    signals = spark.createDataFrame([(1, [0.0, 0.5, -2.0, None]), (2, []), (3, None)], "rec_id long, samples array<double>")
    B.publish(scans.recordings(signals, 8000), str(tmp_path))
    got = scans.audio(spark, str(tmp_path)).select("path", "rate", "samples").collect()
    assert len(got) == 1 and got[0].rate == 8000 and [round(v * 32768) for v in got[0].samples] == [0, 16384, -32767, 0]


@pytest.mark.parametrize(("rate", "to"), [(44_100, 16_000), (8_000, 16_000), (48_000, 16_000), (16_000, 22_050)])
def test_blocks_resample_like_the_whole(spark, rate, to):
    rng = np.random.default_rng(rate)
    signals = {1: rng.standard_normal(5000), 2: rng.standard_normal(X.Resampler(rate, to).reach), 3: rng.standard_normal(1), 4: rng.standard_normal(2113)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in signals.items()] + [(5, [])], "rec_id long, samples array<double>")
    for block in (97, 1000):
        parts = X.resampled(X.blocks_of(df, block), block, rate, to).orderBy("rec_id", "block_no").collect()
        got = {k: [] for k in signals}
        for r in parts:
            assert r["first"] == len(got[r.rec_id])
            got[r.rec_id] += r.samples
        for k, v in signals.items():
            assert len(got[k]) == -(-len(v) * to // rate)
            np.testing.assert_allclose(got[k], X.resample(v, rate, to), atol=1e-12)


def test_a_sine_keeps_its_amplitude_and_high_tones_go():
    n = np.arange(44_100)
    y = X.resample(np.sin(2 * np.pi * 1000 * n / 44_100), 44_100, 16_000)
    m = np.arange(len(y))
    inner = slice(200, -200)
    np.testing.assert_allclose(y[inner], np.sin(2 * np.pi * 1000 * m / 16_000)[inner], atol=0.01)
    assert np.abs(X.resample(np.sin(2 * np.pi * 12_000 * n / 44_100), 44_100, 16_000)[inner]).max() < 0.01
    np.testing.assert_allclose(X.resample(np.ones(1000), 44_100, 16_000), 1, atol=1e-12)
    assert list(X.resample(np.array([1.0, 2.0]), 16_000, 16_000)) == [1, 2]


def test_resampler_refuses():
    for bad in ((0, 1), (1, 0), (1, 1, 0)):
        with pytest.raises(ValueError):
            X.Resampler(*bad)


def test_blocks_shorter_than_the_reach(spark):
    with pytest.raises(ValueError):
        X.resampled(spark.createDataFrame([], "rec_id long, block_no long, samples array<double>"), 10, 44_100, 16_000)
