"""What surrounds a recogniser: its interface and a deterministic stand-in, the retry ladder, filters, votes and prompts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..params import WINDOW_FRAMES, DecodeParams, SpecialTokens

S = SpecialTokens()


class AsrBackend(Protocol):
    """A recogniser of windows of features. Implementations are pickled to executors and hold no session."""

    def generate(self, rec_id: int, seek: int, prompt: list[int], temperature: float) -> dict:
        """``tokens, text, avg_logprob, compression_ratio, no_speech_prob`` of one window."""

    def detect_language(self, rec_id: int, chunk: int) -> list[tuple[str, float]]:
        """Languages with probabilities, best first."""


class StubBackend:
    """Stands in for a model: everything follows from a checksum of the arguments."""

    languages = ("en", "zh", "de", "fr")

    def generate(self, rec_id: int, seek: int, prompt: list[int], temperature: float) -> dict:
        h = zlib.crc32(f"{rec_id}/{seek}/{len(prompt)}/{temperature:.1f}".encode())
        n = 3 + h % 5
        body = [(h >> k) % 5000 + 100 for k in range(n)]
        tokens = [S.timestamp_begin, *body, S.timestamp_begin + 200 + h % 1200]
        text = " ".join(f"w{t}" for t in body)
        return {"tokens": tokens, "text": text, "avg_logprob": -(h % 15) / 10, "compression_ratio": 1 + (h >> 4) % 20 / 10, "no_speech_prob": (h >> 8) % 10 / 10}

    def detect_language(self, rec_id: int, chunk: int) -> list[tuple[str, float]]:
        h = zlib.crc32(f"{rec_id}/{chunk}".encode())
        k, p = h % len(self.languages), 0.3 + h % 7 / 10
        rest = (1 - p) / (len(self.languages) - 1)
        return [(self.languages[k], p), *((x, rest) for x in self.languages if x != self.languages[k])]


def too_repetitive(p: DecodeParams) -> Column:
    limit = p.compression_ratio_threshold
    return F.lit(False) if limit is None else F.col("compression_ratio") > limit


def too_unsure(p: DecodeParams) -> Column:
    limit = p.log_prob_threshold
    return F.lit(False) if limit is None else F.col("avg_logprob") < limit


def silent(p: DecodeParams) -> Column:
    """Probably no speech, and nothing that the decoder is sure of."""
    if p.no_speech_threshold is None:
        return F.lit(False)
    unsure = F.lit(True) if p.log_prob_threshold is None else F.col("avg_logprob") < p.log_prob_threshold
    return (F.col("no_speech_prob") > p.no_speech_threshold) & unsure


def acceptable(p: DecodeParams) -> Column:
    return silent(p) & (F.lit(True) if p.log_prob_threshold is not None else F.lit(False)) | ~(too_repetitive(p) | too_unsure(p))


def choose_attempt(attempts: DataFrame, p: DecodeParams | None = None) -> DataFrame:
    """Per segment the first acceptable attempt; without one the likeliest of those that aren't too repetitive, else of all.

    ``tried`` is the temperature that is reported: that of the chosen attempt, or of the last where none was acceptable.
    """
    p = p or DecodeParams()
    key = ["rec_id", "seg_no"]
    a = attempts.withColumn("ok", acceptable(p)).withColumn("plain", ~too_repetitive(p))
    # acceptable first by attempt; then plain ones and the rest by likelihood, the earlier of equals
    rank = F.when(F.col("ok"), F.struct(F.lit(0).alias("a"), F.col("attempt").cast("double").alias("b"), F.col("attempt").alias("c"))).otherwise(
        F.struct(F.when(F.col("plain"), 1).otherwise(2).alias("a"), (-F.col("avg_logprob")).alias("b"), F.col("attempt").alias("c"))
    )
    g = a.groupBy(*key).agg(F.min(F.struct(rank.alias("rank"), F.col("attempt"), F.col("temperature"), F.col("avg_logprob"), F.col("compression_ratio"), F.col("no_speech_prob"))).alias("m"), F.max("temperature").alias("last"))
    return g.select(*key, "m.attempt", F.when(F.col("m.rank.a") == 0, F.col("m.temperature")).otherwise(F.col("last")).alias("tried"), "m.avg_logprob", "m.compression_ratio", "m.no_speech_prob")


def drop_silent(segments: DataFrame, p: DecodeParams | None = None) -> DataFrame:
    """Segments that are not silence."""
    return segments.where(~silent(p or DecodeParams()))


def drop_empty(segments: DataFrame) -> DataFrame:
    """Segments with text and length, numbered anew from 1."""
    kept = segments.where((F.col("start") != F.col("end")) & (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return kept.withColumn("id", F.row_number().over(Window.partitionBy("rec_id").orderBy("seg_no")).cast("long"))


def language_vote(chunks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per recording the language of the first chunk that is sure; without one the commonest, of equals the first seen. Columns: ``rec_id, chunk, lang, p``."""
    sure = F.min(F.when(F.col("p") > threshold, F.struct("chunk", "lang", "p"))).alias("sure")
    per = chunks.groupBy("rec_id", "lang").agg(F.count("*").alias("n"), F.min("chunk").alias("first"), F.max("p").alias("p"))
    top = per.groupBy("rec_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "lang", "p")).alias("top"))
    return chunks.groupBy("rec_id").agg(sure).join(top, "rec_id").select("rec_id", F.coalesce("sure.lang", "top.lang").alias("lang"), F.coalesce("sure.p", "top.p").alias("p"))


def average_log_probability(score: Column, n_tokens: Column, length_penalty: float = 1.0) -> Column:
    """From a beam's score: undoes the length penalty and counts the end token."""
    return score * F.pow(n_tokens, F.lit(length_penalty)) / (n_tokens + 1)


def prompt_tokens(segments: DataFrame, keep: int = 223) -> DataFrame:
    """For each segment (``rec_id, seg_no, tokens, reset``) the last ``keep`` tokens said before it since the last reset.

    A segment with ``reset`` clears what was said up to and including it. Null tokens are none, a null reset is no reset. What is held for
    a segment are the segments that its last ``keep`` tokens come from, however long the recording.
    """
    w = Window.partitionBy("rec_id").orderBy("seg_no")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    said = F.slice("tokens", F.greatest(F.lit(1), F.size("tokens") - keep + 1), keep)  # more of a segment is never asked for
    marked = segments.select("rec_id", "seg_no", F.coalesce(said, F.array().cast(segments.schema["tokens"].dataType)).alias("said"), before(F.coalesce("reset", F.lit(False)).cast("int"), w).alias("island"))
    counted = marked.withColumn("n", before(F.size("said"), Window.partitionBy("rec_id", "island").orderBy("seg_no")))
    # each segment asks at the number of tokens before it and speaks at the number up to its end; the frame reaches back ``keep`` tokens, not segments
    ends = F.array(F.struct(F.col("n").alias("at"), F.lit(None).cast(segments.schema["tokens"].dataType).alias("said")), F.struct((F.col("n") + F.size("said")).alias("at"), F.when(F.size("said") > 0, F.col("said")).alias("said")))
    both = counted.select("rec_id", "seg_no", "island", F.posexplode(ends).alias("speaks", "end")).select("rec_id", "seg_no", "island", "speaks", "end.at", "end.said").where("speaks = 0 or said is not null")
    frame = Window.partitionBy("rec_id", "island").orderBy("at").rangeBetween(1 - keep, 0)
    heard = both.withColumn("heard", F.flatten(F.collect_list("said").over(frame))).where("speaks = 0")
    return heard.select("rec_id", "seg_no", F.slice("heard", F.greatest(F.lit(1), F.size("heard") - keep + 1), keep).alias("prompt"))


def full_prompt(previous: Column, p: DecodeParams, s: SpecialTokens = S, hotwords: Column | None = None, prefix: Column | None = None, keep: int = 223) -> Column:
    """Start sequence with what went before it: marker, hot words (only without a prefix), the last tokens; then the prefix."""
    ints = lambda *x: F.array(*(F.lit(v) for v in x)).cast("array<bigint>")
    none = F.array().cast("array<bigint>")
    hot = F.slice(hotwords, 1, keep) if hotwords is not None and prefix is None else none
    has = (F.size(previous) > 0) | (F.size(hot) > 0)
    last = F.slice(previous, F.greatest(F.lit(1), F.size(previous) - keep + 1), keep)
    head = F.when(has, F.concat(ints(s.sot_prev), hot, last)).otherwise(none)
    start = ints(*start_sequence(p, s))
    out = F.concat(head, start, ints(s.no_timestamps) if p.without_timestamps else none)
    if prefix is not None:
        out = F.concat(out, none if p.without_timestamps else ints(s.timestamp_begin), F.slice(prefix, 1, keep))
    return out


def start_sequence(p: DecodeParams, s: SpecialTokens = S, language_token: int | None = None) -> list[int]:
    """Start, language and task; a model of one language has the start alone."""
    if not p.multilingual and p.language is None:
        return [s.sot]
    return [s.sot, language_token or s.english, s.transcribe if p.task == "transcribe" else s.translate]


def suppressed(tokens: list[int], s: SpecialTokens = S) -> list[int]:
    """Ids never to be generated: -1 stands for all that aren't speech; task and marker tokens always belong to them."""
    asked = [t for t in tokens if t != -1] + (list(s.non_speech) if -1 in tokens else [])
    return sorted({*asked, s.transcribe, s.translate, s.sot, s.sot_prev, s.sot_lm, s.no_speech})


def suppressed_column(tokens: Column, s: SpecialTokens = S) -> Column:
    ints = lambda v: F.array(*(F.lit(x) for x in v)).cast("array<bigint>")
    speech = F.when(F.array_contains(tokens, -1), ints(s.non_speech)).otherwise(F.array().cast("array<bigint>"))
    always = ints([s.transcribe, s.translate, s.sot, s.sot_prev, s.sot_lm, s.no_speech])
    return F.array_sort(F.array_distinct(F.concat(F.filter(tokens, lambda t: t != -1), speech, always)))


_OUT = "rec_id long, seg_no long, seek long, start double, end double, text string, tokens array<int>, avg_logprob double, compression_ratio double, no_speech_prob double, temperature double"


def sequential(recordings: DataFrame, backend: AsrBackend, p: DecodeParams | None = None) -> DataFrame:
    """The seek loop over ``rec_id, n_frames``: windows whose advance depends on what was decoded, with prompt carry. Recordings run in parallel, each in one task."""
    p = p or DecodeParams()

    def ok(r: dict) -> bool:
        repetitive = p.compression_ratio_threshold is not None and r["compression_ratio"] > p.compression_ratio_threshold
        unsure = p.log_prob_threshold is not None and r["avg_logprob"] < p.log_prob_threshold
        quiet = p.no_speech_threshold is not None and r["no_speech_prob"] > p.no_speech_threshold and p.log_prob_threshold is not None and unsure
        return quiet or not (repetitive or unsure)

    def ladder(rec: int, seek: int, prompt: list[int]) -> tuple[dict, float]:
        tried = []
        for t in p.temperatures:
            r = backend.generate(rec, seek, prompt, t)
            tried.append(r)
            if ok(r):
                return r, t
        plain = [r for r in tried if p.compression_ratio_threshold is not None and r["compression_ratio"] <= p.compression_ratio_threshold]
        return max(plain or tried, key=lambda r: r["avg_logprob"]), p.temperatures[-1]

    def loop(pdf: pd.DataFrame) -> pd.DataFrame:
        rec, total = int(pdf["rec_id"].iloc[0]), int(pdf["n_frames"].iloc[0])
        out, said, since, seek = [], [], 0, 0
        while seek < total:
            size = min(WINDOW_FRAMES, total - seek)
            r, t = ladder(rec, seek, said[since:][-223:])
            if p.no_speech_threshold is not None and r["no_speech_prob"] > p.no_speech_threshold and not (p.log_prob_threshold is not None and r["avg_logprob"] > p.log_prob_threshold):
                seek += size
                continue
            offset, tokens = seek / 100, r["tokens"]
            single = len(tokens) >= 2 and tokens[-2] < S.timestamp_begin <= tokens[-1]
            breaks = [k for k in range(1, len(tokens)) if tokens[k] >= S.timestamp_begin and tokens[k - 1] >= S.timestamp_begin]
            if breaks:
                parts, last = [], 0
                for k in breaks + ([len(tokens)] if single else []):
                    parts.append(tokens[last:k])
                    last = k
                spans = [(offset + (x[0] - S.timestamp_begin) * 0.02, offset + (x[-1] - S.timestamp_begin) * 0.02, x) for x in parts]
                advance = size if single else (tokens[last - 1] - S.timestamp_begin) * 2
            else:
                times = [x for x in tokens if x >= S.timestamp_begin]
                length = (times[-1] - S.timestamp_begin) * 0.02 if times and times[-1] != S.timestamp_begin else size / 100
                spans, advance = [(offset, offset + length, tokens)], size
            for a, b, x in spans:
                text = " ".join(f"w{v}" for v in x if v < S.eot)
                if a != b and text.strip():
                    out.append((rec, len(out) + 1, seek, round(a, 2), round(b, 2), text, x, r["avg_logprob"], r["compression_ratio"], r["no_speech_prob"], t))
                    said += x
            if not p.condition_on_previous_text or t > p.prompt_reset_on_temperature:
                since = len(said)
            seek += max(1, advance)
        return pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return recordings.select("rec_id", "n_frames").groupBy("rec_id").applyInPandas(loop, _OUT)


def batched(chunks: DataFrame, backend: AsrBackend, p: DecodeParams | None = None) -> DataFrame:
    """Chunks (``rec_id, chunk_no, offset, duration``) are decoded apart, ``batch_size`` at a time, without carry: no shuffle before the numbering."""
    p = (p or DecodeParams()).batched()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), p.batch_size):
                rows = []
                for c in pdf.iloc[i : i + p.batch_size].itertuples():
                    r = backend.generate(int(c.rec_id), int(c.chunk_no), [], p.temperatures[0])
                    rows.append((c.rec_id, c.chunk_no, round(c.offset, 3), round(c.offset + c.duration, 3), r["text"], [t for t in r["tokens"] if t < S.timestamp_begin], r["avg_logprob"], r["no_speech_prob"]))
                yield pd.DataFrame(rows, columns=["rec_id", "chunk_no", "start", "end", "text", "tokens", "avg_logprob", "no_speech_prob"])

    out = chunks.select("rec_id", "chunk_no", "offset", "duration").mapInPandas(run, "rec_id long, chunk_no long, start double, end double, text string, tokens array<int>, avg_logprob double, no_speech_prob double")
    numbered = out.withColumn("id", F.row_number().over(Window.partitionBy("rec_id").orderBy("chunk_no")).cast("long"))
    return numbered.withColumn("compression_ratio", T.compression_ratio("text"))


def detect_languages(spark: SparkSession, recordings: DataFrame, backend: AsrBackend, segments: int = 1) -> DataFrame:
    """The best language of each of the first windows: ``rec_id, chunk, lang, p``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                for chunk in range(min(segments, max(1, -(-int(r.n_frames) // WINDOW_FRAMES)))):
                    lang, p = backend.detect_language(int(r.rec_id), chunk)[0]
                    rows.append((r.rec_id, chunk, lang, p))
            yield pd.DataFrame(rows, columns=["rec_id", "chunk", "lang", "p"])

    return recordings.select("rec_id", "n_frames").mapInPandas(run, "rec_id long, chunk long, lang string, p double")
