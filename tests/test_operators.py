"""Small cases with known answers, and second statements of folds."""

import random
import unicodedata

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan import views
from loomspan.functions import text as T
from loomspan.functions.forms import composed
from loomspan.functions.time import clock, human_size
from loomspan.operators import decoding as D, features as X, quality as Q, reports as P, segments as S, words as W
from loomspan.params import BLOCK, DecodeParams, VadParams, check_device, check_threshold, effective_language
from loomspan.sources import scans


@pytest.mark.parametrize("s, value", [("十", "10"), ("二十三", "23"), ("一百零五", "105"), ("两千", "2000"), ("三万五千", "35000"), ("一二三", "3"), ("万", "0"), ("九十一", "91")])
def test_numeral_value(spark, s, value):
    assert spark.createDataFrame([(s,)], "s string").select(T.numeral_value(F.col("s"))).first()[0] == value
    assert str(views.numeral(s)) == value


def test_numbers_in_digits(spark):
    known = [("百分之九十一", "91%"), ("上午十点，十分重要的一部分", "上午10点，10分重要的一部分"), ("百分之，好", "\0，好"), ("三百分之五", "三5%"), ("", ""), (None, None), ("十点", "10点"), ("点十", "点十"), ("百分之", "\0"), ("\0二分", "2%分")]
    for row in spark.createDataFrame(known, "t string, e string").select("t", "e", T.normalise_numbers("t").alias("x"), T.flatten("t").alias("f")).collect():
        assert row.x == row.e
        if row.t is not None:
            assert (row.x, row.f) == (views.numbers_in_digits(row.t), views.flat(row.t))
    assert views.flat("百分之，好") == "好"


def test_texts_equal_the_character_database(spark):
    """Every assigned character of the planes that have any that change, alone and between others, and runs of marks and syllables."""
    r = random.Random(8)
    chars = [chr(c) for c in range(1, 0x30000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    odd = [c for c in chars if unicodedata.combining(c) or unicodedata.normalize("NFKC", c) != c] + [chr(c) for c in (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3))]
    numerals = "零一二两十百千万点分百分之\0"
    mixed = ["".join(r.choice((r.choice(odd), r.choice("aeE가각中 1Σ\n"), r.choice(numerals), r.choice(chars))) for _ in range(r.randint(1, 12))) for _ in range(6000)]
    texts = ["", " ", "Ａｂｃ，１２３ﬁ é", "é" * 20_000, "가" * 5000, "e" + "\u0301\u0323" * 300, *mixed, *("e" + c + "\u0301" for c in odd)]
    texts += ["".join(chars[i : i + 1]) for i in range(len(chars))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8).select("t", composed(F.col("t")).alias("c"), T.normalise("t").alias("n"), T.flatten("t").alias("f")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.c == unicodedata.normalize("NFKC", row.t), ascii(row.t)
        assert row.n == views.normalised(row.t), ascii(row.t)
        assert row.f == views.flat(row.t), ascii(row.t)
    plan = spark.createDataFrame([("x",)], "t string").select(T.flatten("t"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and spark.createDataFrame([(None,)], "t string").select(T.flatten("t")).first()[0] is None


def test_prompts_of_any_segments(spark):
    """Segments without tokens, with more than are kept, with nulls; against a walk over each recording."""
    r = random.Random(4)
    rows = [(rec, k, None if r.random() < 0.1 else [r.randint(0, 99) for _ in range(r.choice((0, 0, 1, 3, 9)))], r.choice((True, False, False, False, None))) for rec in range(12) for k in range(r.randint(1, 40))]
    want, said, last = {}, [], None
    for rec, k, tokens, reset in rows:
        said = [] if rec != last else said
        last = rec
        want[rec, k] = said[-7:]
        said = [] if reset else said + (tokens or [])
    got = D.prompt_tokens(spark.createDataFrame(rows, "rec_id long, seg_no long, tokens array<long>, reset boolean"), keep=7).collect()
    assert len(got) == len(want) and {(x.rec_id, x.seg_no): x.prompt for x in got} == want


def test_error_rate_counts_agree_with_the_walk_back(spark):
    r = random.Random(3)
    pairs = [("".join(r.choices("abc", k=r.randint(0, 9))), "".join(r.choices("abc", k=r.randint(0, 9)))) for _ in range(80)]
    for row in Q.error_rates(spark.createDataFrame(pairs, "ref string, hyp string")).collect():
        distance, ops = T.edit_ops(row.ref, row.hyp)
        tags = [t for t, *_ in ops]
        assert (row.distance, row.s, row.d, row.i) == (distance, tags.count(T.SUB), tags.count(T.DEL), tags.count(T.INS))
        assert row.s + row.d + row.i == row.distance


def table_ops(ref, hyp):
    """The preferred alignment by the whole table."""
    d = [[i + j if not i * j else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i, a in enumerate(ref, 1):
        for j, b in enumerate(hyp, 1):
            d[i][j] = min(d[i - 1][j - 1] + (a != b), d[i - 1][j] + 1, d[i][j - 1] + 1)
    i, j, ops = len(ref), len(hyp), []
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            ops.append((T.OK if ref[i] == hyp[j] else T.SUB, ref[i], hyp[j]))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            ops.append((T.DEL, ref[i], None))
        else:
            j -= 1
            ops.append((T.INS, None, hyp[j]))
    return d[-1][-1], ops[::-1]


def test_alignment_in_a_band_equals_the_table():
    r = random.Random(12)
    pairs = [("", ""), ("", "abc"), ("abc", ""), ("a" * 40, "b" * 9), ("ab" * 30, "ba" * 30)]
    for n in [*range(0, 12)] * 8 + [60, 90] * 6:
        a = r.choices("abc", k=n)
        b = [x for x in a if r.random() > 0.2] if r.random() < 0.6 else r.choices("abc", k=r.randint(0, 30))
        for _ in range(r.randint(0, 5)):
            b.insert(r.randint(0, len(b)), r.choice("abcd"))
        pairs += [("".join(a), "".join(b)), ("".join(b), "".join(a))]
    for a, b in pairs:
        assert T.edit_ops(a, b) == table_ops(a, b), (a, b)
        assert T.edit_distance(a, b) == table_ops(a, b)[0]


def test_alignment_of_long_texts_in_little_memory():
    """Two texts of 10^5 characters with a hundred edits; the whole table would be 10^10 cells."""
    import tracemalloc

    r = random.Random(13)
    a = r.choices("abcdefghij", k=100_000)
    b = list(a)
    for _ in range(120):
        at = r.randrange(len(b))
        b[at : at + r.randint(0, 1)] = r.choices("abcdefghij", k=r.randint(0, 2))
    tracemalloc.start()
    distance, ops = T.edit_ops(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 80 < distance <= 240 and peak < 200e6
    assert [x for _, x, _ in ops if x is not None] == a and [y for *_, y in ops if y is not None] == b and sum(t != T.OK for t, *_ in ops) == distance


def test_clock_and_sizes(spark):
    df = spark.createDataFrame([(0.0, 0), (61.5, 1023), (3600.0, 1536), (360000.25, 5 << 30)], "s double, n long")
    got = [tuple(r) for r in df.select(clock(F.col("s")), clock(F.col("s"), True, ","), human_size(F.col("n"))).collect()]
    assert got == [("00:00.000", "00:00:00,000", "0 B"), ("01:01.500", "00:01:01,500", "1023 B"), ("01:00:00.000", "01:00:00,000", "1.5 KB"), ("100:00:00.250", "100:00:00,250", "5.0 GB")]


def test_sizes_beyond_a_terabyte(spark, tmp_path):
    """Orders with keys as in larger tables: the query stops at GB, as its SQL does; the function goes on to TB."""
    from loomspan import plans

    queries, oracle = plans.load()
    keys = [1, 8, 256, 262_143, 262_144, 262_145, 900_000, 9_000_000, 23_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = dict(map(tuple, queries["X10_human_size"](spark, str(tmp_path)).collect()))
    assert got == dict(duck.sql(oracle["X10_human_size"]).fetchall()) and got[900_000] == "12069.9 GB"
    df = spark.createDataFrame([((1 << 40) - 1,), (1 << 40,), (3 << 39,)], "n long")
    assert [tuple(x) for x in df.select(human_size(F.col("n")), human_size(F.col("n"), "GB")).collect()] == [("1024.0 GB", "1024.0 GB"), ("1.0 TB", "1024.0 GB"), ("1.5 TB", "1536.0 GB")]


def speech(probs, p):
    """Another statement of the segmentation rules, frame by frame."""
    low, quiet = p.low, p.samples(p.min_silence_at_max_speech)
    open_, start, temp, prev, nxt, cand, out = False, 0, 0, 0, 0, [], []
    for i, x in enumerate(probs):
        cur = BLOCK * i
        if x >= p.threshold and temp:
            if cur - temp > quiet:
                cand.append((temp, cur - temp))
            temp = 0
            if nxt < prev:
                nxt = cur
        if x >= p.threshold and not open_:
            open_, start = True, cur
            continue
        if open_ and cur - start > p.longest():
            if p.use_max_poss_sil_at_max_speech and cand:
                at, size = max(cand, key=lambda c: c[1])
                out.append((start, at))
                open_, start = (True, at + size) if at + size < at + cur else (False, 0)
                temp = prev = nxt = 0
                cand = []
            elif prev:
                out.append((start, prev))
                open_, start = (False, 0) if nxt < prev else (True, nxt)
                temp = prev = nxt = 0
                cand = []
            else:
                out.append((start, cur))
                open_, start, temp, prev, nxt, cand = False, 0, 0, 0, 0, []
                continue
        if x < low and open_:
            temp = temp or cur
            if not p.use_max_poss_sil_at_max_speech and cur - temp > quiet:
                prev = temp
            if cur - temp >= p.samples(p.min_silence_duration_ms):
                if temp - start > p.samples(p.min_speech_duration_ms):
                    out.append((start, temp))
                open_, start, temp, prev, nxt, cand = False, 0, 0, 0, 0, []
    total = BLOCK * len(probs)
    if open_ and total - start > p.samples(p.min_speech_duration_ms):
        out.append((start, total))
    return out


@pytest.mark.parametrize("use_max", [True, False])
def test_speech_segments(spark, use_max):
    p = VadParams(threshold=0.5, min_speech_duration_ms=60, min_silence_duration_ms=200, max_speech_duration_s=1.5, speech_pad_ms=0, min_silence_at_max_speech=60, use_max_poss_sil_at_max_speech=use_max)
    r = np.random.default_rng(1)
    tracks = {k: (np.clip(np.cumsum(r.normal(0, 0.25, 200)) % 2 - 0.5, 0, 1) if k % 2 else r.random(200)).round(3).tolist() for k in range(12)}
    rows = [(k, i, float(x)) for k, t in tracks.items() for i, x in enumerate(t)]
    got = {}
    for x in S.speech_segments(spark.createDataFrame(rows, "rec_id long, frame_no long, prob double"), p).orderBy("rec_id", "k").collect():
        got.setdefault(x.rec_id, []).append((x.start, x.end))
    for k, t in tracks.items():
        assert got.get(k, []) == speech(t, p), k


def test_packing_quirks(spark):
    rows = [(1, 0, 0, 50), (1, 1, 60, 70), (1, 2, 80, 90)]
    got = S.pack_intervals(spark.createDataFrame(rows, "rec_id long, k long, start long, end long"), 30, 1).orderBy("chunk_no").collect()
    assert [(r.offset, r.duration, [tuple(x) for x in r.segments]) for r in got] == [(0.0, 0.0, []), (0.0, 50.0, []), (50.0, 20.0, [(80, 90)])]


def test_times_at_boundaries(spark):
    chunks = S.time_map(spark.createDataFrame([(1, 0, 100, 200), (1, 1, 300, 400)], "rec_id long, k long, start long, end long"))
    times = spark.createDataFrame([(1, 0, 0.0, False), (1, 1, 100.0, False), (1, 2, 100.0, True), (1, 3, 500.0, True)], "rec_id long, t_no long, t double, is_end boolean")
    got = [(r.t_no, r.k, r.original) for r in S.original_times(times, chunks, 1).orderBy("t_no").collect()]
    assert got == [(0, 0, 100.0), (1, 1, 300.0), (2, 0, 200.0), (3, 1, 700.0)]


def test_words_at_characters_shows_broken_bytes(spark):
    pieces = [b" elle", b" est", b" l", b"'", b"\xff", "é".encode(), b"rit", b"oire"]
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate(pieces)], "rec_id long, pos long, bytes binary")
    assert [r.word for r in W.words_at_characters(df).orderBy("word_no").collect()] == [" elle", " est", " l", "'", "�", "é", "rit", "oire"]
    split = spark.createDataFrame([(1, 0, b"\xe6\x97"), (1, 1, b"\xa5"), (1, 2, b"x")], "rec_id long, pos long, bytes binary")
    assert [(r.word, r.n_tokens) for r in W.words_at_characters(split).orderBy("word_no").collect()] == [("日", 2), ("x", 1)]


def test_merge_punctuation(spark):
    rows = [(1, 0, i, w, 1) for i, w in enumerate([" hello", ",", " (", " world", ")", "."])]
    p = DecodeParams()
    got = W.merge_punctuation(spark.createDataFrame(rows, "rec_id long, seg_no long, word_no long, word string, n_tokens long"), p.prepend_punctuations, p.append_punctuations).orderBy("word_no").collect()
    assert [(r.word, r.n_tokens) for r in got] == [(" hello,", 2), ("", 0), ("", 0), (" ( world).", 4), ("", 0), ("", 0)]


def test_merge_punctuation_of_blank_ends(spark):
    """A mark behind a word that ends with a blank stays on its own and gathers the next; a last word that opens stays."""
    rows = [(1, 0, i, w, 1) for i, w in enumerate([" one ", ".", ",", " (", " (", " two", "!", " ("])]
    p = DecodeParams()
    got = W.merge_punctuation(spark.createDataFrame(rows, "rec_id long, seg_no long, word_no long, word string, n_tokens long"), p.prepend_punctuations, p.append_punctuations).orderBy("word_no").collect()
    assert [(r.word, r.n_tokens) for r in got] == [(" one ", 1), (".,", 2), ("", 0), ("", 0), ("", 0), (" ( ( two!", 4), ("", 0), (" (", 1)]


def test_repair_boundaries_segment_by_segment(spark):
    """Against the rules applied one segment after the other, in an order that lets every answer depend on the one before."""
    r = random.Random(11)
    words, segments, medians, expected = [], [], [], {}
    for rec in range(12):
        m = r.choice([0.1, 0.25, 0.4])
        medians.append((rec, m))
        spoken, at = 0.0, 0.0
        for seg in range(25):
            n = r.choice([1, 1, 2, 3, 4])
            t = []
            for _ in range(n):
                at += r.choice([0.0, 0.1, 1.5])
                t.append([at, at := at + r.choice([0.1, 0.3, 0.9, 2.5])])
            low, high = t[0][0] + r.choice([-0.3, 0.0, 0.7, 1.2]), t[-1][1] + r.choice([-1.4, -0.6, 0.0, 0.4])
            words += [(rec, seg, k, *x) for k, x in enumerate(t)]
            segments.append((rec, seg, low, high))
            too_long = t[0][1] - t[0][0] > 2 * m or (n > 1 and t[1][1] - t[0][0] > 4 * m)
            if too_long and t[0][1] - spoken > 4 * m:
                if n > 1 and t[1][1] - t[1][0] > 2 * m:
                    t[0][1] = t[1][0] = max(t[1][1] / 2, t[1][1] - 2 * m)
                t[0][0] = max(0.0, t[0][1] - 2 * m)
            if t[0][0] < low - 0.5 and low < t[0][1]:
                t[0][0] = max(0.0, min(t[0][1] - m, low))
            else:
                low = t[0][0]
            if t[-1][1] > high + 0.5 and high > t[-1][0]:
                t[-1][1] = max(t[-1][0] + m, high)
            else:
                high = t[-1][1]
            spoken = high
            expected |= {(rec, seg, k): (*x, low, high) for k, x in enumerate(t)}
    got = W.repair_boundaries(
        spark.createDataFrame(words, "rec_id long, seg_no long, word_no long, start double, end double"),
        spark.createDataFrame(segments, "rec_id long, seg_no long, seg_start double, seg_end double"),
        spark.createDataFrame(medians, "rec_id long, median_duration double"),
    )
    assert {(x.rec_id, x.seg_no, x.word_no): pytest.approx((x.start, x.end, x.seg_start, x.seg_end)) for x in got.collect()} == expected


def test_lower_quantiles_of_hot_values(spark):
    r = random.Random(3)
    rows = [(g, 7.0 if r.random() < 0.5 else round(r.random() * 20, 1)) for g in (True, False, None) for _ in range(400)] + [(True, None)]
    got = Q.lower_quantiles(spark.createDataFrame(rows, "g boolean, v double"), ["g"], "v", (0.0, 0.1, 0.5, 0.9, 1.0), parts=8).collect()
    for x in got:
        v = sorted(b for a, b in rows if a == x.g and b is not None)
        assert tuple(x)[1:] == tuple(v[int(q * (len(v) - 1))] for q in (0.0, 0.1, 0.5, 0.9, 1.0))
    assert len(got) == 3


def test_label_words(spark):
    w = spark.createDataFrame([(1, 0, 0, "ab"), (1, 0, 1, "."), (1, 0, 2, "cx"), (1, 1, 0, "f")], "rec_id long, seg_no long, word_no long, word string")
    got = Q.label_words(w, spark.createDataFrame([(1, "abcdef g")], "rec_id long, reference string")).orderBy("seg_no", "word_no").collect()
    assert [(r.correct, r.has_ref) for r in got] == [(True, True), (None, False), (False, True), (False, True)]


def test_label_words_moves_a_reference_once(spark):
    """A reference goes to the tasks once a recording, not with each of its words; each recording is labelled as alone."""
    w = spark.createDataFrame([(g, k // 50, k % 50, f"w{(k * 7 + g) % 23}") for g in range(6) for k in range(400)], "rec_id long, seg_no long, word_no long, word string")
    refs = spark.createDataFrame([(g, " ".join("x" if k % 9 == 0 else f"w{(k * 7 + g) % 23}" for k in range(400))) for g in range(6)], "rec_id long, reference string")
    labels = Q.label_words(w, refs)
    plan = labels._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :] and labels.count() == 6 * 400
    one = Q.label_words(w.where("rec_id = 4"), refs).orderBy("seg_no", "word_no").collect()
    assert one == labels.where("rec_id = 4").orderBy("seg_no", "word_no").collect()
    assert sum(r.correct is False for r in one) >= 400 // 9


def test_alignment_of_many_edits_equals_the_table(monkeypatch):
    r = random.Random(14)
    monkeypatch.setattr(T, "_ROWS", 4)
    for _ in range(12):
        a, b = r.choices("abcd", k=r.randint(50, 140)), r.choices("abcd", k=r.randint(50, 140))
        assert T.edit_ops("".join(a), "".join(b)) == table_ops("".join(a), "".join(b))


def test_leave_one_out_equals_refitting(spark):
    r = random.Random(5)
    rows = [(g, s, k, round(r.random(), 2), r.random() > 0.3) for g in range(4) for s in range(12) for k in range(3)]
    w = spark.createDataFrame([(g * 100 + s, 0, k, p, c, g) for g, s, k, p, c in rows], "rec_id long, seg_no long, word_no long, probability double, correct boolean, g long")
    grid = [t / 100 for t in range(10, 99, 4)]
    segs = {}
    for g, s, _, p, c in rows:
        a, b = segs.get((g, s), (1.0, False))
        segs[g, s] = (min(a, p), b or not c)

    def counts(keep, t):
        x = [v for (g, _), v in segs.items() if keep(g)]
        return sum(p < t and b for p, b in x), sum(p < t and not b for p, b in x), sum(p >= t and b for p, b in x)

    f1 = lambda c: 2 * c[0] / (2 * c[0] + c[1] + c[2]) if c[0] else 0
    got = {x.g: (x.t, x.tp, x.fp, x.fn) for x in Q.leave_one_out(w, Q.steps(spark, 10, 98, 4), "g").collect()}
    for g in range(4):
        t = max(grid, key=lambda t: (f1(counts(lambda h: h != g, t)), -t))
        assert got[g] == (t, *counts(lambda h: h == g, t))


def test_lower_quantile_index(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0)], "g long, v double")
    r = Q.lower_quantiles(df, ["g"], "v", (0.0, 0.75, 1.0)).first()
    assert (r.q0, r.q75, r.q100) == (1.0, 2.0, 3.0)


def test_ladder(spark):
    rows = [(1, 0, 0, 0.0, -2.0, 1.0, 0.1), (1, 0, 1, 0.2, -0.5, 1.0, 0.1), (2, 0, 0, 0.0, -1.5, 3.0, 0.1), (2, 0, 1, 0.2, -1.8, 2.0, 0.1), (3, 0, 0, 0.0, -2.0, 1.0, 0.9)]
    got = {r.rec_id: (r.attempt, r.tried) for r in D.choose_attempt(spark.createDataFrame(rows, "rec_id long, seg_no long, attempt long, temperature double, avg_logprob double, compression_ratio double, no_speech_prob double")).collect()}
    assert got == {1: (1, 0.2), 2: (1, 0.2), 3: (0, 0.0)}


def test_suppressed():
    assert D.suppressed([13]) == [13, 50258, 50358, 50359, 50360, 50361, 50362]
    assert D.start_sequence(DecodeParams(language="en", task="translate")) == [50258, 50259, 50358]


def power_of(samples, n_fft, hop):
    """Power of a whole signal mirrored at its ends, a frame a row."""
    x = np.pad(samples, n_fft // 2, mode="reflect") if len(samples) > n_fft // 2 else np.pad(samples, n_fft // 2)
    return np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop] * X.hann(n_fft), axis=1)) ** 2


def test_mel_filters():
    f = X.mel_filters()
    assert f.shape == (80, 201) and (f >= 0).all() and (f.sum(axis=1) > 0).all()
    assert power_of(np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000), 400, 160).mean(axis=0).argmax() == 25


@pytest.mark.parametrize("n_fft, hop, block", [(16, 4, 12), (16, 8, 24), (400, 160, 480)])
def test_power_of_blocks_equals_that_of_the_signal(spark, n_fft, hop, block):
    """Lengths about every border: shorter than half a frame, last blocks of a few samples, whole blocks."""
    r = np.random.default_rng(0)
    lengths = sorted({0, 1, 2, n_fft // 2, n_fft // 2 + 1, hop, n_fft, block - 1, block, block + 1, block + n_fft // 2, 2 * block - 3, 2 * block, 2 * block + 1, 5 * block + hop})
    signals = {k: r.normal(size=n).round(4) for k, n in enumerate(lengths)}
    df = spark.createDataFrame([(k, x.tolist()) for k, x in signals.items()] + [(99, None)], "rec_id long, samples array<double>")
    got = {}
    for x in X.stft_power(X.blocks_of(df, block), block, n_fft, hop).orderBy("rec_id", "frame_no").collect():
        got.setdefault(x.rec_id, []).append((x.frame_no, x.power))
    assert set(got) == {k for k, x in signals.items() if len(x)}
    for k, rows in got.items():
        want = power_of(signals[k], n_fft, hop)
        assert [i for i, _ in rows] == list(range(len(want))) and np.allclose([p for _, p in rows], want)
    mel = {}
    for x in X.log_mel(df, 16_000, n_fft, hop, 8, block).collect():
        mel.setdefault(x.rec_id, {})[x.frame_no, x.mel] = x.e
    filters = X.mel_filters(16_000, n_fft, 8)
    for k, x in signals.items():
        e = np.log10(np.maximum(filters @ power_of(x, n_fft, hop)[:-1].T, 1e-10)) if len(x) >= hop else np.empty((8, 0))
        heard = [m for m in range(8) if filters[m].any()]
        want = {(i, m): (max(e[m, i], e.max() - 8) + 4) / 4 for m in heard for i in range(e.shape[1])}
        assert mel.get(k, {}) == pytest.approx(want)


def test_power_of_a_long_signal(spark):
    """Ten minutes as blocks of a second; no row holds the signal."""
    blocks = spark.range(600).selectExpr("1L as rec_id", "id as block_no", "transform(sequence(0, 15999), i -> sin((id * 16000 + i) * 0.3D)) as samples")
    got = X.stft_power(blocks, 16_000)
    n, far, bins = got.agg(F.count("*"), F.max("frame_no"), F.max(F.size("power"))).first()
    assert (n, far, bins) == (60_001, 60_000, 201)
    with pytest.raises(ValueError):
        X.stft_power(blocks, 16_001)


def test_wav(spark, tmp_path):
    import wave

    for name, channels in (("a.wav", 1), ("b.wav", 2)):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(16_000)
            w.writeframes((np.arange(320 * channels) * 50).astype("<i2").tobytes())
    (tmp_path / "c.wav").write_bytes(b"broken")
    (tmp_path / "d.txt").write_text("no audio")
    got = scans.audio(spark, f"{tmp_path}/*.wav", split_stereo=True).orderBy("path", "channel").collect()
    assert [(r.channel, len(r.samples)) for r in got] == [(0, 320), (0, 320), (1, 320)]
    assert scans.files(spark, [str(tmp_path), "/nowhere"]).count() == 3


def test_report_rows(spark):
    lines = ["| x | y |", "| big-tiny | 53.0% | 50.0% | 51 | 7 | 0 | 1.3s | 20.9x |", "| big-small | 11.1% | 5.2% | 6 | 0 | 0 | 5.7s | 4.7x |"]
    got = {r.model: (r.cer_raw, r.cer, r["sub"], r.dele, r.ins, r.sec, r.speed) for r in P.parse_rows(spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "name string, line_no long, line string")).collect()}
    assert got == {"tiny": (53.0, 50.0, 51, 7, 0, 1.3, 20.9), "small": (11.1, 5.2, 6, 0, 0, 5.7, 4.7)}


def test_published_operating_point():
    """17 hits, 8 false alarms and 2 misses of 38: precision 0.68, recall 0.89, F1 0.773."""
    tp, fp, fn = 17, 8, 2
    assert (round(tp / (tp + fp), 2), round(tp / (tp + fn), 2), round(2 * tp / (2 * tp + fp + fn), 3)) == (0.68, 0.89, 0.773)


def test_parameters():
    for bad in (0, 1, -1):
        with pytest.raises(ValueError):
            check_threshold(bad)
    with pytest.raises(ValueError):
        check_device("cpu", "float16")
    with pytest.raises(ValueError):
        DecodeParams(task="sing")
    assert effective_language(False, "de") == "en"
    options = {"threshold": 0.4}
    assert VadParams.of(options).low == pytest.approx(0.25) and options == {"threshold": 0.4}


def test_word_error_rate(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("d", "d e"), ("", "f")], "ref string, hyp string")
    assert Q.corpus_word_error_rate(df).first().wer == pytest.approx(100 * 3 / 4)


def test_models_and_options_of_many_runs(spark):
    known = spark.createDataFrame([("a", "hub/a2"), ("a", "hub/a1"), ("b", "hub/b"), (None, "hub/none")], "alias string, repo string")
    asked = spark.createDataFrame([(1, "a"), (2, "own/x"), (3, "c"), (4, None), (5, "a")], "id int, name string")
    got = {r.id: r.repo for r in P.resolve_models(asked, known).collect()}
    assert got == {1: "hub/a1", 2: "own/x", 3: None, 4: None, 5: "hub/a1"}
    with pytest.raises(Exception, match="unknown model"):
        P.require_known(P.resolve_models(asked, known)).collect()
    runs = [(t, ref, dev, kind, multi, "de") for t in (None, 0.0, 0.3, 1.0) for ref in (True, False, None) for dev in ("cpu", "cuda") for kind in ("float16", "int8") for multi in (True, False, None)]
    for r in P.run_options(spark.createDataFrame(runs, "threshold double, has_reference boolean, device string, compute_type string, multilingual boolean, language string")).collect():
        threshold, wrong = 0.70 if r.threshold is None and r.has_reference else r.threshold, None
        try:
            check_threshold(threshold) if threshold is not None else None
            check_device(r.device, r.compute_type)
        except ValueError as e:
            wrong = str(e)
        assert (r.effective_threshold, r.problem, r.effective_language) == (threshold, wrong, effective_language(bool(r.multilingual), r.language))
