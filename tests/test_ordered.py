"""Scans and as-of joins over cells, and what is built on them, against plain loops."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import ordered, segments as S
from loomspan.params import BLOCK, VadParams

INTERVALS = "rec_id long, k long, start long, end long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def intervals(seed, records=5, most=40):
    r, rows = random.Random(seed), []
    for rec in [*range(records), None]:
        at = 0
        for k in range(r.randint(1, most)):
            start = at + r.choice([0, 1, 5, 40])
            at = start + r.choice([0, 1, 3, 30, 70])
            rows.append((rec, k, start, at))
    return rows


def test_scan_over_cells(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 2, None]), i, r.choice([None, *range(50)])) for i in range(400)]
    df = spark.createDataFrame(rows, "g long, i long, v long")
    for strict in (False, True):
        got = ordered.scanned(df, ["g"], F.floor(F.col("i") / 7), ["i"], strict, most=(F.col("v"), F.max), total=(F.col("v"), F.sum))
        assert got.count() == len(rows) and got.columns == ["g", "i", "v", "most", "total"]
        for x in got.collect():
            own = [v for g, i, v in rows if g == x.g and (i < x.i or i == x.i and not strict) and v is not None]
            assert (x.most, x.total) == ((max(own), sum(own)) if own else (None, None))


def test_as_of(spark):
    r = random.Random(3)
    marks = [(r.choice([1, 2]), r.randint(-50, 300)) for _ in range(60)]
    rows = [(r.choice([1, 2, 3]), r.choice([None, *range(-60, 310, 3)]), "x") for _ in range(300)]
    a = spark.createDataFrame(rows, "g long, t long, __at string")
    b = spark.createDataFrame(marks, "g long, m long")
    got = ordered.as_of(a.withColumnRenamed("__at", "other"), b, ["g"], F.col("t"), F.col("m"), F.col("m"), 16, "last")
    assert got.columns == ["g", "t", "other", "last"] and got.count() == len(rows)
    for x in got.collect():
        before = [m for g, m in marks if g == x.g and x.t is not None and m <= x.t]
        assert x["last"] == (max(before) if before else None)
    assert "Join" not in plan(got)


def test_times_against_a_search(spark):
    rows = intervals(5)
    df = spark.createDataFrame(rows, INTERVALS)
    chunks = S.time_map(df, mark_last=False)
    r = random.Random(6)
    times = [(rec, i, r.randint(0, 900) / 4, r.random() < 0.5) for rec in [*range(5), 99, None] for i in range(150)]
    got = S.original_times(spark.createDataFrame(times, "rec_id long, t_no long, t double, is_end boolean"), chunks, 4)
    assert "Join" not in plan(got)
    seen = 0
    for x in got.collect():
        own = [(s, e) for rec, _, s, e in rows if rec == x.rec_id]
        ends = np.cumsum([e - s for s, e in own]).tolist()
        sample = int(x.t * 4)
        at = ends.index(sample) if x.is_end and sample > 0 and sample in ends else bisect.bisect(ends, sample)
        at = min(at, len(own) - 1)
        assert x.k == at and x.original == round(x.t + (own[at][0] - (ends[at] - (own[at][1] - own[at][0]))) / 4, 2), x
        seen += 1
    assert seen == 150 * 6


def test_a_recording_of_a_million_words(spark):
    """Both sides of one recording are dealt over cells; nothing is joined."""
    n = 1_000_000
    chunks = S.time_map(spark.range(0, n // 10).selectExpr("7L as rec_id", "id as k", "id * 60000 as start", "id * 60000 + 48000 as end"), mark_last=False)
    words = spark.range(0, n).selectExpr("7L as rec_id", "0L as seg_no", "id as word_no", "id * 0.3D as start", "id * 0.3D + 0.2D as end")
    got = S.restore_words(words, chunks)
    assert "Join" not in plan(got)
    total, last = got.agg(F.count("*"), F.max("end")).first()
    assert total == n and last == pytest.approx(0.3 * (n - 1) + 0.2 + 0.75 * (n // 10 - 1), abs=0.01)


def test_silence_with_overlapping_intervals(spark):
    r = random.Random(8)
    spans = [(g, k, s, s + r.choice([-5, 0, 3, 40, 200])) for g in (1, 2) for k in range(30) for s in [r.randint(0, 2000)]]
    frames = [(g, i, 0.5, "kept") for g in (1, 2, 3) for i in range(0, 260)]
    got = S.drop_silence(spark.createDataFrame(frames, "rec_id long, frame_no long, prob double, other string"), spark.createDataFrame(spans, INTERVALS), 8)
    want = [f for f in frames if any(g == f[0] and s <= f[1] * 8 < e for g, _, s, e in spans)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def packed(sizes, most):
    """Chunks of one recording: offset, size, numbers of the listed intervals."""
    out, size, done, listed = [], 0, 0, []
    for i, x in enumerate(sizes):
        if size + x > most:
            out.append((done, size, listed))
            done, size, listed = done + size, x, []
        else:
            size, listed = size + x, [*listed, i]
    return [*out, (done, size, listed)]


@pytest.mark.parametrize("block", [2, 512])
def test_packing_against_the_loop(spark, block, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_OF_JUMPS", block)
    monkeypatch.setattr(S, "CELL_INTERVALS", 9)
    for most in (10, 1000):
        rows = [x for x in intervals(most, records=4, most=60) if x[0] is not None]
        got = {}
        for x in S.pack_intervals(spark.createDataFrame(rows, INTERVALS), most, 1).orderBy("rec_id", "chunk_no").collect():
            got.setdefault(x.rec_id, []).append((x.chunk_no, x.offset, x.duration, [tuple(s) for s in x.segments]))
        for rec in range(4):
            own = [(s, e) for g, _, s, e in rows if g == rec]
            want = [(i, float(a), float(b), [own[j] for j in c]) for i, (a, b, c) in enumerate(packed([e - s for s, e in own], most))]
            assert got[rec] == want


def test_packing_of_nothing(spark):
    assert S.pack_intervals(spark.createDataFrame([], INTERVALS), 10).count() == 0


def spoken(probs, p):
    """The rules frame by frame, by the machine that streams use."""
    from loomspan.streaming.machine import SpeechMachine

    m, out = SpeechMachine(p), []
    for i, x in enumerate(probs):
        out += m.frame(BLOCK * i, x)
    return [*out, *m.end(BLOCK * len(probs))]


@pytest.mark.parametrize("limit, silence, low", [(float("inf"), 0, None), (float("inf"), 400, 0.5), (float("inf"), 40, 0.7), (0.6, 40, None), (2.0, 400, None), (0.6, 0, 0.5), (2.0, 40, 0.7)])
def test_speech_in_pieces_and_cells(spark, monkeypatch, limit, silence, low):
    monkeypatch.setattr(S, "CELL_FRAMES", 64)
    r = np.random.default_rng(4)
    tracks = {k: (np.clip(np.cumsum(r.normal(0, 0.15, 400)) % 2 - 0.5, 0, 1) if k % 2 else (r.random(400) < r.random()) * r.random(400)).round(3).tolist() for k in range(10)}
    tracks[10], tracks[11], tracks[12] = [0.0] * 200, [1.0] * 200, [0.0] * 150 + [1.0] * 90 + [0.0] * 150
    df = spark.createDataFrame([(k, i, float(x)) for k, t in tracks.items() for i, x in enumerate(t)], "rec_id long, frame_no long, prob double")
    for use in (True, False):
        p = VadParams(threshold=0.5, neg_threshold=low, min_silence_duration_ms=silence, max_speech_duration_s=limit, speech_pad_ms=0, min_speech_duration_ms=40, min_silence_at_max_speech=50, use_max_poss_sil_at_max_speech=use)
        got = {}
        for x in S.speech_segments(df, p).orderBy("rec_id", "k").collect():
            got.setdefault(x.rec_id, []).append((x.start, x.end))
        assert got == {k: v for k, t in tracks.items() if (v := spoken(t, p))}


def test_pieces_are_short(spark):
    """A long recording with pauses is followed in pieces; without a limit no list of frames is made at all."""
    df = spark.range(0, 60_000).selectExpr("1L as rec_id", "id as frame_no", "if(id % 1000 < 700, 0.9D, 0.0D) as prob")
    p = VadParams(max_speech_duration_s=10)
    sizes = S._pieces(df, p, 16_000).groupBy("rec_id", "piece").count()
    assert sizes.agg(F.max("count")).first()[0] < 1000
    assert S.speech_segments(df, p).count() > 60
    assert "collect_list" not in plan(S.speech_segments(df))
