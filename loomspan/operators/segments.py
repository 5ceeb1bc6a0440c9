"""Intervals of speech: segmentation, padding, packing, and mapping of times between timelines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..params import BLOCK, SAMPLING_RATE, VadParams
from ..tables import Rounds
from .ordered import as_of, scanned

#: Cells that long recordings are cut into: samples (35 minutes at 16 kHz), intervals, frames.
CELL_SAMPLES, CELL_INTERVALS, CELL_FRAMES = 1 << 25, 1 << 14, 1 << 16
#: Positions that one row of the packing's jump table leaps over at first.
BLOCK_OF_JUMPS = 512


def _order():
    return Window.partitionBy("rec_id").orderBy("k")


def pad_intervals(intervals: DataFrame, pad: int, length: Column) -> DataFrame:
    """Widens disjoint intervals by ``pad``; where the gap is less than twice that, both sides get half of it. Clamped to [0, length]."""
    before, after = F.col("start") - F.lag("end").over(_order()), F.lead("start").over(_order()) - F.col("end")
    left = F.when(before < 2 * pad, F.floor(before / 2)).otherwise(F.lit(pad))
    right = F.when(after < 2 * pad, F.floor(after / 2)).otherwise(F.lit(pad))
    return intervals.select("rec_id", "k", F.greatest(F.lit(0), F.col("start") - left).cast("long").alias("start"), F.least(length, F.col("end") + right).cast("long").alias("end"))


def speech_totals(intervals: DataFrame, rate: int = SAMPLING_RATE) -> DataFrame:
    """Kept and removed seconds of each recording, up to its last interval."""
    g = intervals.groupBy("rec_id").agg(F.sum(F.col("end") - F.col("start")).alias("kept"), F.max("end").alias("last"))
    return g.select("rec_id", (F.col("kept") / rate).alias("kept_s"), ((F.col("last") - F.col("kept")) / rate).alias("removed_s"))


def time_map(intervals: DataFrame, mark_last: bool = True) -> DataFrame:
    """Chunks on the timeline without silence: ``rec_id, k, lo, hi, silence`` (samples); chunk k covers [lo, hi) and ``silence`` was removed before it.

    ``mark_last`` adds ``is_last``, which takes a join with each recording's last k.
    """
    size = F.col("end") - F.col("start")
    summed = scanned(intervals.select("rec_id", "k", "start", "end"), ["rec_id"], F.floor(F.col("k") / CELL_INTERVALS), ["k"], hi=(size, F.sum))
    chunks = summed.select("rec_id", "k", (F.col("hi") - size).alias("lo"), "hi", (F.col("start") - (F.col("hi") - size)).alias("silence"))
    if not mark_last:
        return chunks
    last = intervals.groupBy("rec_id").agg(F.max("k").alias("last"))
    return chunks.join(last, "rec_id").withColumn("is_last", F.col("k") == F.col("last")).drop("last")


def chunk_of(times: DataFrame, chunks: DataFrame, sample: Column) -> DataFrame:
    """Adds ``chunk`` (``k, silence``) to times at ``sample`` of the timeline without silence: the last chunk that begins at or before it, the first one before all.

    Times and chunk borders are sorted together; a recording's borders never meet all of its times. Null times, and times of recordings without chunks, are dropped.
    """
    found = as_of(times, chunks, ["rec_id"], F.greatest(sample, F.lit(0)), F.col("lo"), F.struct("k", "silence"), CELL_SAMPLES, "chunk")
    return found.where("chunk is not null")


def original_times(times: DataFrame, chunks: DataFrame, rate: int = SAMPLING_RATE, places: int = 2) -> DataFrame:
    """Maps ``rec_id, t_no, t (seconds), is_end`` to the original timeline: ``k`` and ``original``.

    A start at a boundary belongs to the chunk that begins there, an end to the one that ends there; what lies behind the last chunk
    belongs to it.
    """
    s = F.floor(F.col("t") * rate).cast("long")
    found = chunk_of(times, chunks, F.when(F.col("t").isNotNull(), F.when(F.col("is_end") & (s > 0), s - 1).otherwise(s)))
    return found.select(*times.columns, "chunk.k", F.bround(F.col("chunk.silence") / rate + F.col("t"), places).alias("original"))


def chunk_numbers(times: DataFrame, chunks: DataFrame, rate: int = SAMPLING_RATE) -> DataFrame:
    """``chunk`` for each of ``rec_id, t_no, t``: the number of chunks that end at or before it, the last one at most."""
    found = chunk_of(times, chunks, F.floor(F.col("t") * rate).cast("long"))
    return found.select(*times.columns, F.col("chunk.k").cast("long").alias("chunk"))


def restore_words(words: DataFrame, chunks: DataFrame, rate: int = SAMPLING_RATE, places: int = 2) -> DataFrame:
    """Words on the original timeline; both ends follow the chunk that holds the word's middle."""
    found = chunk_of(words, chunks, F.floor((F.col("start") + F.col("end")) / 2 * rate).cast("long"))
    shift = F.col("chunk.silence") / rate
    return found.select("rec_id", "seg_no", "word_no", "chunk.k", F.bround(F.col("start") + shift, places).alias("start"), F.bround(F.col("end") + shift, places).alias("end"))


def drop_silence(frames: DataFrame, intervals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Frames of ``block`` samples that begin within an interval; frames and intervals are sorted together, and intervals may overlap."""
    at = (F.col("frame_no") * block).cast("long")
    found = as_of(frames, intervals.where("start < end"), ["rec_id"], at, F.col("start"), F.col("end"), CELL_SAMPLES, "__until")
    return found.where(at < F.col("__until")).select(*frames.columns)


def pack_intervals(intervals: DataFrame, max_samples: int, rate: int = SAMPLING_RATE) -> DataFrame:
    """Packs intervals, in order, into chunks of at most ``max_samples``: ``rec_id, chunk_no, offset, duration, segments``.

    The interval that no longer fits begins the next chunk and counts to its length, but isn't listed among its segments; an interval over
    the limit at the very start leaves an empty chunk before it.

    Where a chunk that begins at some interval ends follows from prefix sums. These pointers are followed by doubling: each interval first leaps
    to where its chain leaves a block of BLOCK_OF_JUMPS intervals, then twice, four times as far, until no chain goes on. No row holds a recording.
    """
    spark = intervals.sparkSession
    rounds = Rounds(spark, "packing")
    size = F.col("end") - F.col("start")
    cell = F.floor(F.col("k") / CELL_INTERVALS)
    items = scanned(intervals.select("rec_id", "k", "start", "end"), ["rec_id"], cell, ["k"], hi=(size, F.sum), pos=(F.lit(1).cast("long"), F.sum))
    items = items.select("rec_id", (F.col("pos") - 1).alias("pos"), "start", "end", (F.col("hi") - size).alias("lo"), "hi")
    fits = as_of(items, items, ["rec_id"], F.col("lo") + max_samples, F.col("hi"), F.col("pos"), CELL_SAMPLES, "fits")
    items = rounds.write(fits.withColumn("nxt", F.greatest("fits", "pos") + 1).drop("fits"), "items")

    # where the chain of each interval leaves its block, and after how many chunks
    block = F.floor(F.col("pos") / BLOCK_OF_JUMPS)
    blocks = items.groupBy("rec_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "nxt"))).alias("b"))
    leave = """aggregate(reverse(b), cast(array() as array<struct<pos: bigint, `to`: bigint, n: bigint>>), (a, x) -> concat(array(
        if(x.nxt - x.pos > size(a), named_struct('pos', x.pos, 'to', x.nxt, 'n', 1L), named_struct('pos', x.pos, 'to', a[cast(x.nxt - x.pos - 1 as int)].`to`, 'n', a[cast(x.nxt - x.pos - 1 as int)].n + 1))), a))"""
    exits = blocks.selectExpr("rec_id", f"inline({leave}) as (pos, dest, n)")
    last = items.groupBy("rec_id").agg(F.max("pos").alias("last"))
    jumps = rounds.write(exits.join(last, "rec_id").where("dest <= last").drop("last"), "jumps")
    first = items.where("pos = 0").select("rec_id", "pos", F.when(size > max_samples, 1).otherwise(0).cast("long").alias("chunk_no"))
    reached = rounds.write(first, "entries")
    while not jumps.isEmpty():
        more = reached.join(jumps, ["rec_id", "pos"]).select("rec_id", F.col("dest").alias("pos"), (F.col("chunk_no") + F.col("n")).alias("chunk_no"))
        both = rounds.write(reached.unionByName(more), "entries")
        far = jumps.alias("a").join(jumps.alias("b"), F.expr("a.rec_id <=> b.rec_id and a.dest = b.pos")).selectExpr("a.rec_id", "a.pos", "b.dest", "a.n + b.n as n")
        far = rounds.write(far, "jumps")
        rounds.drop(reached, jumps)
        reached, jumps = both, far

    # the chunks that begin in a block, from its entry on
    entered = reached.withColumn("block", block).withColumnRenamed("pos", "entry").join(blocks, ["rec_id", "block"])
    walk = """aggregate(b, named_struct('nxt', entry, 'starts', cast(array() as array<bigint>)), (a, x) -> if(x.pos = a.nxt, named_struct('nxt', x.nxt, 'starts', concat(a.starts, array(x.pos))), a), a -> a.starts)"""
    starts = entered.select("rec_id", "chunk_no", F.posexplode(F.expr(walk)).alias("i", "pos")).select("rec_id", "pos", (F.col("chunk_no") + F.col("i")).alias("chunk_no"))
    placed = as_of(items, starts, ["rec_id"], F.col("pos"), F.col("pos"), F.struct(F.col("pos").alias("first"), "chunk_no"), CELL_INTERVALS, "c")
    listed = F.when((F.col("c.chunk_no") == 0) | (F.col("pos") > F.col("c.first")), F.struct("pos", "start", "end"))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    packed = placed.groupBy("rec_id", F.col("c.chunk_no").alias("chunk_no")).agg(F.min("lo").alias("lo"), F.sum(size).alias("size"), F.array_sort(F.collect_list(listed)).alias("s"))
    segments = F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    seconds = lambda c: (F.col(c).cast("double") / rate)
    packed = packed.select("rec_id", "chunk_no", seconds("lo").alias("offset"), seconds("size").alias("duration"), segments.alias("segments"))
    empty = first.where("chunk_no = 1").select("rec_id", F.lit(0).cast("long").alias("chunk_no"), F.lit(0.0).alias("offset"), F.lit(0.0).alias("duration"), none.alias("segments"))
    return packed.unionByName(empty)


def _segmentation(p: VadParams, rate: int) -> str:
    """The hysteresis machine as one fold over a recording's frame probabilities; 0 stands for an unset time."""
    limit = p.longest(rate)
    most = "double('inf')" if limit == float("inf") else f"{limit}D"
    quiet, silence, speech = (p.samples(x, rate) for x in (p.min_silence_at_max_speech, p.min_silence_duration_ms, p.min_speech_duration_ms))
    seg = "struct<start: bigint, end: bigint>"
    gap = "struct<at: bigint, len: bigint>"
    low = f"cast(array() as array<{gap}>)"
    st = lambda open_, start, temp, prev, nxt, cand, out: f"named_struct('open', {open_}, 'start', {start}, 'temp', {temp}, 'prev', {prev}, 'nxt', {nxt}, 'cand', {cand}, 'out', {out})"
    z = "cast(0 as bigint)"
    emit = lambda start, end: f"concat(a.out, array(named_struct('start', {start}, 'end', {end})))"
    cur = f"(x.i * {BLOCK})"
    longest = "filter(a.cand, g -> g.len = array_max(transform(a.cand, h -> h.len)))[0]"
    use = str(p.use_max_poss_sil_at_max_speech).lower()
    # 1: pending silence ends
    one = f"if(x.p >= {p.threshold} and a.temp > 0, " + st("a.open", "a.start", z, "a.prev", f"if(a.nxt < a.prev, {cur}, a.nxt)", f"if({cur} - a.temp > {quiet}, concat(a.cand, array(named_struct('at', a.temp, 'len', {cur} - a.temp))), a.cand)", "a.out") + ", a)"
    # 3: too long
    at_gap = f"transform(array({longest}), g -> if(g.at + g.len < g.at + {cur}, " + st("true", "g.at + g.len", z, z, z, low, emit("a.start", "g.at")) + ", " + st("false", z, z, z, z, low, emit("a.start", "g.at")) + "))[0]"
    at_prev = "if(a.nxt < a.prev, " + st("false", z, z, z, z, low, emit("a.start", "a.prev")) + ", " + st("true", "a.nxt", z, z, z, low, emit("a.start", "a.prev")) + ")"
    hard = st("false", z, z, z, z, low, emit("a.start", cur))
    # 4: below the lower threshold
    temp = f"if(a.temp > 0, a.temp, {cur})"
    prev = f"if(not {use} and {cur} - {temp} > {quiet}, {temp}, a.prev)"
    close = f"if({cur} - {temp} < {silence}, " + st("a.open", "a.start", temp, prev, "a.nxt", "a.cand", "a.out") + f", if({temp} - a.start > {speech}, " + st("false", z, z, z, z, low, emit("a.start", temp)) + ", " + st("false", z, z, z, z, low, "a.out") + "))"
    quiet_step = f"if(x.p < {p.low} and a.open, {close}, a)"
    best = f"({use} and size(a.cand) > 0)"
    # a hard cut ends the frame; other cuts go on to step 4
    long = f"if(a.open and {cur} - a.start > {most}, if(not {best} and a.prev = 0, {hard}, transform(array(if({best}, {at_gap}, {at_prev})), a -> {quiet_step})[0]), {quiet_step})"
    opened = f"if(x.p >= {p.threshold} and not a.open, " + st("true", cur, "a.temp", "a.prev", "a.nxt", "a.cand", "a.out") + f", {long})"
    body = f"transform(array({one}), a -> {opened})[0]"
    begin = st("false", z, z, z, z, low, f"cast(array() as array<{seg}>)")
    finish = f"a -> if(a.open and total - a.start > {speech}, " + emit("a.start", "total") + ", a.out)"
    return f"aggregate(items, {begin}, (a, x) -> {body}, {finish})"


def _unlimited(frames: DataFrame, p: VadParams, rate: int) -> DataFrame:
    """Speech without a limit on its length, as islands: a gap closes it whose quiet frames span the asked silence. ``rec_id, start, last_start, end`` (null: open)."""
    cell = F.floor(F.col("frame_no") / CELL_FRAMES)
    loud = F.col("prob") >= p.threshold
    runs = scanned(frames, ["rec_id"], cell, ["frame_no"], since=(F.when(loud, F.col("frame_no")), F.max)).where("since is not null")
    quiet = F.when(F.col("prob") < p.low, F.col("frame_no") * BLOCK)
    runs = runs.groupBy("rec_id", "since").agg(F.min(quiet).alias("first"), F.max(quiet).alias("last"))
    ends = F.col("last") - F.col("first") >= p.samples(p.min_silence_duration_ms, rate)
    runs = scanned(runs, ["rec_id"], F.floor(F.col("since") / CELL_FRAMES), ["since"], strict=True, segment=(F.when(ends, F.col("since")), F.max))
    found = runs.groupBy("rec_id", "segment").agg((F.min("since") * BLOCK).alias("start"), F.max(F.when(ends, F.col("first"))).alias("end"))
    return found.select("rec_id", "start", "end")


def _pieces(frames: DataFrame, p: VadParams, rate: int) -> DataFrame:
    """Frames with ``piece``, within which speech can be followed from a closed start; frames between pieces are left out.

    Where all of the last 2m + 2 frames were quiet, m frames being the asked silence, speech is closed whatever came before: a limit of length can
    restart the count of silence once, and a second one closes. The quiet frames are counted within a cell, which finds such places later, never wrongly.
    """
    m = math.ceil(p.samples(p.min_silence_duration_ms, rate) / BLOCK)
    cell = F.floor(F.col("frame_no") / CELL_FRAMES)
    inside = Window.partitionBy("rec_id", "__c").orderBy("frame_no")
    rows = frames.withColumn("__c", cell)
    broken = (F.col("prob") >= min(p.low, p.threshold)) | F.coalesce(F.col("frame_no") - F.lag("frame_no").over(inside) != 1, F.lit(True))
    rows = rows.withColumn("__b", F.when(broken, F.col("frame_no")))
    rows = rows.withColumn("__still", F.col("frame_no") - F.max("__b").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) >= 2 * m + 2)
    rows = scanned(rows, ["rec_id"], F.col("__c"), ["frame_no"], piece=(F.when(F.col("__still"), F.col("frame_no")), F.max))
    return rows.where("not __still").select("rec_id", F.coalesce("piece", F.lit(-1).cast("long")).alias("piece"), "frame_no", "prob")


def speech_segments(frames: DataFrame, params: VadParams | dict | None = None, rate: int = SAMPLING_RATE, lengths: DataFrame | None = None) -> DataFrame:
    """Speech intervals from frame probabilities (``rec_id, frame_no, prob``): ``rec_id, k, start, end`` in samples, padded.

    ``lengths`` (``rec_id, samples``) tells how long recordings are; all frames are taken as whole otherwise. Without a limit on the length of
    speech, intervals are found as islands by running maxima over cells of frames. With one, a recording is cut where speech is closed whatever
    came before, and each piece is followed on its own; what one row holds is speech without a pause of twice the asked silence.
    """
    p = VadParams.of(params)
    frames = frames.select("rec_id", F.col("frame_no").cast("long").alias("frame_no"), "prob").where("prob is not null")
    totals = frames.groupBy("rec_id").agg((F.count("*") * BLOCK).alias("total")) if lengths is None else lengths.select("rec_id", F.col("samples").cast("long").alias("total"))
    if p.longest(rate) == float("inf") and p.low <= p.threshold:
        found = _unlimited(frames, p, rate).join(totals, "rec_id").withColumn("end", F.coalesce("end", "total"))
        found = found.where(F.col("end") - F.col("start") > p.samples(p.min_speech_duration_ms, rate))
    else:
        items = _pieces(frames, p, rate).groupBy("rec_id", "piece").agg(F.array_sort(F.collect_list(F.struct(F.col("frame_no").alias("i"), F.col("prob").alias("p")))).alias("items"))
        found = items.join(totals, "rec_id").select("rec_id", "total", F.inline(F.expr(_segmentation(p, rate))))
    found = found.select("rec_id", "total", "start", "end", (F.row_number().over(Window.partitionBy("rec_id").orderBy("start", "end")) - 1).cast("long").alias("k"))
    pad = int(p.samples(p.speech_pad_ms, rate))
    return pad_intervals(found, pad, F.col("total"))


def clip_pairs(spec: Column, content_frames: Column, frames_per_second: int = 100) -> Column:
    """``"s,e,s,e"`` in seconds to frame pairs; an open end is the end of the content, an empty list starts at 0."""
    points = F.transform(F.filter(F.split(spec, ","), lambda x: F.trim(x) != ""), lambda x: F.bround(x.cast("double") * frames_per_second).cast("long"))
    points = F.when(F.size(points) == 0, F.array(F.lit(0).cast("long"))).otherwise(points)
    full = F.when(F.size(points) % 2 == 1, F.concat(points, F.array(content_frames))).otherwise(points)
    even = lambda k: F.filter(full, lambda _, i: i % 2 == k)
    return F.zip_with(even(0), even(1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def clip_samples(start: Column, end: Column, rate: int = SAMPLING_RATE) -> Column:
    """Clip seconds to samples, and whether the clip is longer than a window of 30 s."""
    return F.struct(F.floor(start * rate).cast("long").alias("start"), F.floor(end * rate).cast("long").alias("end"), (end - start > 30).alias("too_long"))


def monotone_violations(segments: DataFrame) -> DataFrame:
    """Rows whose end lies before their start or after the next start."""
    w = Window.partitionBy("rec_id").orderBy("seg_no")
    return segments.withColumn("next_start", F.lead("start").over(w)).where((F.col("end") < F.col("start")) | (F.col("next_start") < F.col("end")))
