"""Streams run over what is there and give what a batch gives."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan import views
from loomspan.operators import segments as S
from loomspan.params import VadParams
from loomspan.streaming import sessions as ST
from loomspan.streaming.machine import STORE, SpeechMachine, speech_stream


def wave(seed, n):
    """Loud and quiet stretches with values in between."""
    r = np.random.default_rng(seed)
    return np.clip(np.cumsum(r.normal(0, 0.3, n)) % 2 - 0.5, 0, 1).round(3).tolist()


CASES = [
    VadParams(threshold=0.5, min_speech_duration_ms=50, min_silence_duration_ms=100, speech_pad_ms=0),
    VadParams(threshold=0.5, min_silence_duration_ms=200, speech_pad_ms=70, max_speech_duration_s=1.5, min_silence_at_max_speech=60),
    VadParams(threshold=0.6, min_silence_duration_ms=300, speech_pad_ms=30, max_speech_duration_s=1.0, min_silence_at_max_speech=40, use_max_poss_sil_at_max_speech=False),
]


@pytest.mark.parametrize("p", CASES)
@pytest.mark.parametrize("size", [23, 120])
def test_speech_stream_equals_the_table(spark, tmp_path, p, size):
    """Whatever the batches are, and with a restart from the checkpoint between two of them."""
    n = 240
    (tmp_path / "in").mkdir()
    rows = [(k, i, x) for k in range(4) for i, x in enumerate(wave(k, n))]
    schema = "rec_id long, frame_no long, prob double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    settings = {STORE[0].replace(".", "__"): STORE[1]}
    for a in range(0, n, size):
        part = [x for x in rows if a <= x[1] < a + size]
        part += [(k, n, None) for k in range(4)] if a + size >= n else []
        random.Random(a).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        if a + size >= n or a >= n // 2 > a - size:
            got = ST.run_once(speech_stream(stream, p), str(tmp_path / "run"), **settings)
        else:
            time.sleep(1.1)  # files are taken by age, which is told in seconds
    expected = S.speech_segments(spark.createDataFrame(rows, schema), p)
    assert sorted(map(tuple, got.select(expected.columns).collect())) == sorted(map(tuple, expected.collect())) and expected.count() > 4


def test_an_idle_recording_ends_by_its_timer(spark, tmp_path):
    p, schema = CASES[0], "rec_id long, frame_no long, prob double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    # a query with timers would go on without data, as one may always come to expire
    settings = {STORE[0].replace(".", "__"): STORE[1], "spark__sql__streaming__noDataMicroBatches__enabled": "false"}
    spark.createDataFrame([(1, i, 0.9) for i in range(20)], schema).write.mode("append").json(str(tmp_path / "in"))
    assert ST.run_once(speech_stream(stream, p, idle_ms=1000), str(tmp_path / "run"), **settings).count() == 0
    time.sleep(1.5)
    spark.createDataFrame([(2, 0, 0.9)], schema).write.mode("append").json(str(tmp_path / "in"))
    got = ST.run_once(speech_stream(stream, p, idle_ms=1000), str(tmp_path / "run"), **settings)
    assert [tuple(r) for r in got.collect()] == [(1, 0, 0, 20 * 512)]


def test_machine_keeps_its_state_in_a_row():
    m, once, again = SpeechMachine(CASES[1]), [], []
    for i, x in enumerate(wave(9, 300)):
        once += m.frame(512 * i, x)
    state = SpeechMachine(CASES[1]).state()
    for i, x in enumerate(wave(9, 300)):
        other = SpeechMachine(CASES[1])
        other.restore(state)
        again += other.frame(512 * i, x)
        state = other.state()
    assert once == again and len(once) > 3


def test_late_events_are_dropped(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_type string, value double"
    one = lambda t, v: spark.createDataFrame([(1, t, "a", v)], "user_id long, t string, event_type string, value double").selectExpr("user_id", "cast(t as timestamp) as ts", "event_type", "value")
    for k, (t, v) in enumerate([("2024-01-01 00:10:00", 1.0), ("2024-01-01 09:00:00", 2.0), ("2024-01-01 09:30:00", 16.0), ("2024-01-01 00:20:00", 4.0), ("2024-01-01 20:00:00", 8.0)]):
        one(t, v).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(1.1 if k < 4 else 0)  # files are taken by age, which is told in seconds
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in"))
    got = ST.run_once(ST.tumbling(stream, "1 hour"), str(tmp_path / "run"))
    assert {(str(r.start), r.total) for r in got.collect()} == {("2024-01-01 00:00:00", 1.0), ("2024-01-01 09:00:00", 18.0)}


def test_sql_access(spark, sf_dir):
    views.register_views(spark, sf_dir)
    views.register_functions(spark)
    assert spark.sql("SELECT count(*) AS n FROM words WHERE probability < 0.1").first().n > 0
    assert spark.sql("SELECT numbers_in_digits('上午十点') AS t").first().t == "上午10点"
    plan = spark.table("words").where(F.col("rec_id") == 3).select("rec_id", "seg_no")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(conv_id,3)" in plan
