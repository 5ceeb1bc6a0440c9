"""Signal features: windows, overlapping frames, spectra and mel energies.

Samples travel in blocks, never a row a sample. Blocks exchange their ends, so that spectra are computed block by block in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..params import WINDOW_FRAMES

#: Frames of spectra that a task holds before it hands them on, about.
FRAMES_AT_ONCE = 4096


def window_of(frame: Column, length: int = WINDOW_FRAMES) -> Column:
    return F.floor(frame / length).cast("long")


def pad_or_trim(values: Column, length: int) -> Column:
    """An array brought to ``length``: cut behind, or filled with zeros."""
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(values))
    return F.concat(F.slice(values, 1, length), F.array_repeat(F.lit(0.0), missing))


def hopping_frames(signals: DataFrame, length: int, hop: int, samples: str = "samples") -> DataFrame:
    """``rec_id, frame_no, frame``: overlapping slices, as many as fit whole."""
    n = F.floor((F.size(samples) - length) / hop) + 1
    exploded = signals.where(F.size(samples) >= length).select("rec_id", samples, F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("frame_no"))
    return exploded.select("rec_id", "frame_no", F.slice(samples, F.col("frame_no") * hop + 1, length).alias("frame"))


def blocks_with_context(signals: DataFrame, block: int = 512, context: int = 64, samples: str = "samples") -> DataFrame:
    """Blocks with the end of their predecessor in front; the first has zeros. The signal is filled to whole blocks, by one more where it is whole already.

    The last ``context`` samples of the final block are zero.
    """
    n = F.floor(F.size(samples) / block) + 1
    padded = signals.select("rec_id", pad_or_trim_to(F.col(samples), n * block).alias("x"), n.cast("int").alias("n"))
    e = padded.select("rec_id", "n", "x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block_no"))
    own = F.slice("x", F.col("block_no") * block + 1, block)
    own = F.when(F.col("block_no") == F.col("n") - 1, F.concat(F.slice(own, 1, block - context), F.array_repeat(F.lit(0.0), context))).otherwise(own)
    before = F.when(F.col("block_no") == 0, F.array_repeat(F.lit(0.0), context)).otherwise(F.slice("x", F.greatest(F.lit(1), F.col("block_no") * block - context + 1), context))
    return e.select("rec_id", "block_no", F.concat(before, own).alias("block"))


def pad_or_trim_to(values: Column, length: Column) -> Column:
    return F.concat(F.slice(values, F.lit(1), length.cast("int")), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), length - F.size(values)).cast("int")))


def deinterleave(samples: Column, channel: int) -> Column:
    """One channel of a two-channel signal."""
    return F.filter(samples, lambda _, i: i % 2 == channel)


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def mel_filters(rate: int = 16_000, n_fft: int = 400, n_mels: int = 80) -> np.ndarray:
    """Triangular filters of equal area on a scale that is linear below 1 kHz and logarithmic above: (n_mels, n_fft / 2 + 1)."""
    step, knee, log_step = 200 / 3, 1000.0, math.log(6.4) / 27
    to_mel = lambda f: f / step if f < knee else knee / step + math.log(f / knee) / log_step
    points = np.linspace(to_mel(0.0), to_mel(rate / 2), n_mels + 2)
    edge = np.where(points < knee / step, points * step, knee * np.exp(log_step * (points - knee / step)))
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)
    rise = (f - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    fall = (edge[2:, None] - f) / (edge[2:] - edge[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edge[2:] - edge[:-2]))[:, None]


def blocks_of(signals: DataFrame, block: int, samples: str = "samples") -> DataFrame:
    """``rec_id, block_no, samples``: successive blocks, the last as long as it is; an empty signal has none."""
    n = F.ceil(F.size(samples) / block).cast("int")
    e = signals.where(F.size(samples) > 0).select("rec_id", F.col(samples).alias("x"), F.explode(F.sequence(F.lit(0), n - 1)).alias("block_no"))
    return e.select("rec_id", F.col("block_no").cast("long").alias("block_no"), F.slice("x", F.col("block_no") * block + 1, F.lit(block)).alias("samples"))


def with_halos(blocks: DataFrame, reach: int) -> DataFrame:
    """Blocks (``rec_id, block_no, samples``) with ``reach`` samples of their neighbours on either side, mirrored at the ends of the signal.

    All blocks but the last have one length, of more than ``reach``. Each block sends its ends to its neighbours, so that only those move between rows.
    A signal of at most ``reach`` samples has zeros around it. Adds ``is_last``; null samples drop out.
    """
    own = blocks.where(F.size("samples") > 0).select("rec_id", "block_no", F.col("samples").cast("array<double>").alias("samples"))
    size = F.size("samples")
    before = own.select("rec_id", (F.col("block_no") + 1).alias("block_no"), F.slice("samples", F.greatest(size - reach + 1, F.lit(1)), F.lit(reach)).alias("before"))
    after = own.select("rec_id", (F.col("block_no") - 1).alias("block_no"), F.slice("samples", F.lit(1), F.lit(reach)).alias("after"))
    met = own.join(before, ["rec_id", "block_no"], "left").join(after, ["rec_id", "block_no"], "left")
    zeros = F.array_repeat(F.lit(0.0), reach)
    tiny = F.col("before").isNull() & F.col("after").isNull() & (size <= reach)
    left = F.coalesce(F.col("before"), F.when(tiny, zeros).otherwise(F.reverse(F.slice("samples", F.lit(2), F.lit(reach)))))
    met = met.select("rec_id", "block_no", tiny.alias("tiny"), F.col("after").isNull().alias("is_last"), size.alias("n"), F.concat(left, "samples", F.coalesce("after", F.array().cast("array<double>"))).alias("x"))
    # where the signal ends within reach, what lacks is mirrored about its last sample
    lacks = F.col("n") + 2 * reach - F.size("x")
    mirrored = F.slice(F.reverse("x"), F.lit(2), lacks)
    return met.select("rec_id", "block_no", "is_last", "n", F.concat("x", F.when(F.col("tiny"), zeros).otherwise(mirrored)).alias("x"))


def stft_power(blocks: DataFrame, block: int, n_fft: int = 400, hop: int = 160) -> DataFrame:
    """Power of Hann-windowed frames about every ``hop``-th sample: ``rec_id, frame_no, power`` (n_fft / 2 + 1 values), one frame more than whole hops.

    A frame is computed in the row of the block that its middle lies in, from the block and its halos; ``block`` is a multiple of ``hop``.
    """
    if block % hop or block <= n_fft // 2 or n_fft % 2:
        raise ValueError("blocks are whole hops, longer than half a frame, and frames are even")
    window = hann(n_fft)

    def table(parts: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
        numbers = np.concatenate([first + np.arange(len(power)) for _, first, power in parts])
        return pd.DataFrame({"rec_id": np.repeat([rec for rec, *_ in parts], [len(power) for *_, power in parts]), "frame_no": numbers, "power": [row for *_, power in parts for row in power]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts, held = [], 0
            for rec, no, last, n, x in zip(pdf["rec_id"], pdf["block_no"], pdf["is_last"], pdf["n"], pdf["x"], strict=True):
                frames = np.lib.stride_tricks.sliding_window_view(np.asarray(x, dtype=float), n_fft)[::hop]
                frames = frames[: n // hop + 1 if last else block // hop]
                parts.append((rec, no * (block // hop), np.abs(np.fft.rfft(frames * window, axis=1)) ** 2))
                held += len(frames)
                if held >= FRAMES_AT_ONCE:
                    yield table(parts)
                    parts, held = [], 0
            if parts:
                yield table(parts)

    return with_halos(blocks, n_fft // 2).mapInPandas(run, "rec_id long, frame_no long, power array<double>")


def power_rows(power: DataFrame) -> DataFrame:
    return power.select("rec_id", "frame_no", F.posexplode("power").alias("bin", "power")).withColumn("bin", F.col("bin").cast("long"))


def mel_energies(spark: SparkSession, power: DataFrame, rate: int = 16_000, n_fft: int = 400, n_mels: int = 80) -> DataFrame:
    """``rec_id, frame_no, mel, power``: rows of power (``bin, power``) joined with the filters' weights above zero, which are few as filters are narrow."""
    filters = mel_filters(rate, n_fft, n_mels)
    weights = spark.createDataFrame([(int(m), int(b), float(filters[m, b])) for m, b in zip(*np.nonzero(filters), strict=True)], "mel long, bin long, weight double")
    heard = power.join(F.broadcast(weights), "bin").groupBy("rec_id", "frame_no", "mel").agg(F.sum(F.col("power") * F.col("weight")).alias("power"))
    return heard


def log_energies(power: DataFrame) -> DataFrame:
    """Replaces ``power`` by ``e``: log10, floored at 1e-10 and at 8 below the recording's maximum, then (x + 4) / 4."""
    logged = power.withColumn("e", F.log10(F.greatest("power", F.lit(1e-10)))).drop("power")
    top = logged.groupBy("rec_id").agg(F.max("e").alias("top"))
    return logged.join(top, "rec_id").withColumn("e", (F.greatest(F.col("e"), F.col("top") - 8) + 4) / 4).drop("top")


def log_mel(signals: DataFrame, rate: int = 16_000, n_fft: int = 400, hop: int = 160, n_mels: int = 80, block: int = 480_000, samples: str = "samples") -> DataFrame:
    """``rec_id, frame_no, mel, e``: log mel energies of all frames but the last, at most 8 below the recording's maximum, shifted and scaled to about -1..1."""
    blocks = blocks_of(signals, block, samples)
    ends = signals.select("rec_id", F.floor(F.size(samples) / hop).alias("frames"))
    power = stft_power(blocks, block, n_fft, hop).join(ends, "rec_id").where("frame_no < frames").drop("frames")
    return log_energies(mel_energies(signals.sparkSession, power_rows(power), rate, n_fft, n_mels))


@dataclass(frozen=True)
class Resampler:
    """A filter bank from one rate to another: windowed-sinc low pass below the lower rate's half, one set of taps for each phase of the output.

    ``lobes`` are the sinc's on either side, under a Hann window. Each phase's taps sum to one, so that a constant stays itself.
    """

    rate: int
    to: int
    lobes: int = 16

    def __post_init__(self) -> None:
        if min(self.rate, self.to, self.lobes) < 1:
            raise ValueError("rates and lobes are positive")

    @property
    def up(self) -> int:
        return self.to // math.gcd(self.rate, self.to)

    @property
    def down(self) -> int:
        return self.rate // math.gcd(self.rate, self.to)

    @property
    def reach(self) -> int:
        """Samples on either side that an output depends on."""
        return math.ceil(self.lobes * max(1.0, self.down / self.up)) + 1

    def bank(self) -> np.ndarray:
        """Taps by phase and by place from ``-reach`` to ``reach`` about the sample at or before the output: (up, 2 * reach + 1)."""
        cut = min(1.0, self.up / self.down)
        t = (np.arange(self.up)[:, None] / self.up - np.arange(-self.reach, self.reach + 1)) * cut
        taps = np.where(np.abs(t) < self.lobes, np.sinc(t) * (0.5 + 0.5 * np.cos(np.pi * t / self.lobes)), 0.0)
        return taps / taps.sum(axis=1, keepdims=True)

    def first(self, sample: int) -> int:
        """The first output whose middle is at ``sample`` or behind."""
        return -(-sample * self.up // self.down)

    def apply(self, x: np.ndarray, start: int, n: int, bank: np.ndarray) -> np.ndarray:
        """Outputs with their middle in the ``n`` samples from ``start`` on; ``x`` holds them with ``reach`` more on either side."""
        frames = np.lib.stride_tricks.sliding_window_view(x, 2 * self.reach + 1)
        out = []
        lo, end = self.first(start), self.first(start + n)
        while lo < end:
            m = np.arange(lo, min(end, lo + 65_536), dtype=np.int64) * self.down
            out.append(np.einsum("ij,ij->i", frames[m // self.up - start], bank[m % self.up]))
            lo += len(m)
        return np.concatenate(out) if out else np.zeros(0)


def resampled(blocks: DataFrame, block: int, rate: int, to: int, lobes: int = 16) -> DataFrame:
    """Blocks (``rec_id, block_no, samples``) at another rate: ``rec_id, block_no, first, samples``, ``first`` being the number of the first output.

    An output is computed in the row of the block that its middle lies in, from the block and its halos, with the phase that its number gives;
    so the cut into blocks changes nothing, and the last block flushes what is left. Signals are mirrored at their ends (at most ``reach`` samples: zeros).
    """
    r = Resampler(rate, to, lobes)
    if block <= r.reach:
        raise ValueError(f"blocks are longer than {r.reach} samples")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bank = r.bank()
        for pdf in batches:
            for rec, no, n, x in zip(pdf["rec_id"], pdf["block_no"], pdf["n"], pdf["x"], strict=True):
                y = r.apply(np.asarray(x, dtype=float), no * block, n, bank)
                yield pd.DataFrame({"rec_id": [rec], "block_no": [no], "first": [r.first(no * block)], "samples": [y]})

    if r.up == r.down:
        return blocks.where(F.size("samples") > 0).select("rec_id", "block_no", (F.col("block_no") * block).alias("first"), F.col("samples").cast("array<double>").alias("samples"))
    return with_halos(blocks, r.reach).mapInPandas(run, "rec_id long, block_no long, first long, samples array<double>")


def resample(samples: np.ndarray, rate: int, to: int = 16_000, lobes: int = 16) -> np.ndarray:
    """A whole signal at another rate, as ``resampled`` gives it block by block."""
    r = Resampler(rate, to, lobes)
    if r.up == r.down or not len(samples):
        return samples
    x = np.pad(np.asarray(samples, dtype=float), r.reach, mode="reflect" if len(samples) > r.reach else "constant")
    return r.apply(x, 0, len(samples), r.bank())


def regroup(chunks: Column, least: int = 500_000) -> Column:
    """Sizes of successive chunks to groups of at least ``least`` samples (the last as it is): array of group sizes."""
    start = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        total = a["held"] + x
        return F.when(total >= least, F.struct(F.lit(0).cast("long").alias("held"), F.concat(a["out"], F.array(total)).alias("out"))).otherwise(F.struct(total.alias("held"), a["out"].alias("out")))

    return F.aggregate(chunks, start, step, lambda a: F.when(a["held"] > 0, F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]))
