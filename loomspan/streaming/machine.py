"""Speech segmentation over a stream, with kept state for each recording: the whole machine, its limit on length, and padding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..params import BLOCK, SAMPLING_RATE, VadParams

Interval = tuple[int, int]


class SpeechMachine:
    """Follows the frames of one recording; a time of 0 is unset. ``gap`` is the longest silence so far, the first of equals, as (place, length)."""

    def __init__(self, params: VadParams, rate: int = SAMPLING_RATE):
        self.p = params
        self.longest, self.silence, self.speech = params.longest(rate), params.samples(params.min_silence_duration_ms, rate), params.samples(params.min_speech_duration_ms, rate)
        self.brief = params.samples(params.min_silence_at_max_speech, rate)
        self.restore((False, 0, 0, 0, 0, 0, 0))

    def restore(self, state: tuple) -> None:
        self.open, self.start, self.quiet, self.cut, self.again, self.gap = *state[:5], (state[5], state[6])

    def state(self) -> tuple:
        return (self.open, self.start, self.quiet, self.cut, self.again, *self.gap)

    def _begin(self, at: int | None) -> None:
        self.restore((at is not None, at or 0, 0, 0, 0, 0, 0))

    def frame(self, at: int, prob: float) -> Iterator[Interval]:
        """What a frame at a sample completes."""
        if prob >= self.p.threshold:
            if self.quiet:
                if at - self.quiet > max(self.brief, self.gap[1]):
                    self.gap = (self.quiet, at - self.quiet)
                self.quiet = 0
                if self.again < self.cut:
                    self.again = at
            if not self.open:
                self.open, self.start = True, at
                return
        if self.open and at - self.start > self.longest:
            if self.p.use_max_poss_sil_at_max_speech and self.gap[1]:
                yield self.start, self.gap[0]
                self._begin(sum(self.gap))
            elif self.cut:
                yield self.start, self.cut
                self._begin(self.again if self.again >= self.cut else None)
            else:
                yield self.start, at
                self._begin(None)
                return
        if self.open and prob < self.p.low:
            self.quiet = self.quiet or at
            if not self.p.use_max_poss_sil_at_max_speech and at - self.quiet > self.brief:
                self.cut = self.quiet
            if at - self.quiet >= self.silence:
                if self.quiet - self.start > self.speech:
                    yield self.start, self.quiet
                self._begin(None)

    def end(self, total: int) -> Iterator[Interval]:
        if self.open and total - self.start > self.speech:
            yield self.start, total
        self._begin(None)


class SpeechProcessor(StatefulProcessor):
    """Keeps the machine, the interval that waits for its successor, and how far the recording has come, each as a state variable of its own.

    An interval is given out once the next one or the end is known, as both share a short gap between them. A null probability ends a recording
    at its frame; with ``idle_ms``, so does a pause of that long in its arrival, by a timer.
    """

    def __init__(self, params: VadParams, rate: int, idle_ms: int | None):
        self.params, self.rate, self.idle_ms, self.pad = params, rate, idle_ms, int(params.samples(params.speech_pad_ms, rate))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("machine", "open boolean, start long, quiet long, cut long, again long, gap_at long, gap_length long")
        self.waiting = handle.getValueState("waiting", "k long, start long, end long")
        self.come = handle.getValueState("come", "samples long")

    def close(self) -> None:
        pass

    def _give(self, held: tuple | None, found: Iterator[Interval], out: list) -> tuple | None:
        """The interval that waits from now on; the one that waited goes out."""
        for start, end in found:
            if held is None:
                held = (0, max(0, start - self.pad), end)
                continue
            gap = start - held[2]
            half = gap // 2 if gap < 2 * self.pad else self.pad
            out.append((held[0], held[1], held[2] + half))
            held = (held[0] + 1, max(0, start - half), end)
        return held

    def _finish(self, machine: SpeechMachine, held: tuple | None, total: int, out: list) -> None:
        held = self._give(held, machine.end(total), out)
        if held:
            out.append((held[0], held[1], min(total, held[2] + self.pad)))
        self.kept.clear()
        self.waiting.clear()
        self.come.clear()

    def _load(self) -> tuple[SpeechMachine, tuple | None, int]:
        machine = SpeechMachine(self.params, self.rate)
        if self.kept.exists():
            machine.restore(tuple(self.kept.get()))
        return machine, tuple(self.waiting.get()) if self.waiting.exists() else None, self.come.get()[0] if self.come.exists() else 0

    @staticmethod
    def _rows(key: tuple, out: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in out], columns=["rec_id", "k", "start", "end"]).astype({"k": "int64", "start": "int64", "end": "int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine, held, come = self._load()
        out: list = []
        frames = pd.concat(list(rows)).sort_values("frame_no")
        ended = False
        for no, prob in zip(frames["frame_no"].tolist(), frames["prob"].tolist(), strict=True):
            ended = pd.isna(prob)
            if ended:
                self._finish(machine, held, BLOCK * no, out)
                held, come = None, 0
            else:
                held, come = self._give(held, machine.frame(BLOCK * no, prob), out), BLOCK * (no + 1)
        if not ended:
            self.kept.update(machine.state())
            self.come.update((come,))
            if held:
                self.waiting.update(held)
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine, held, come = self._load()
        out: list = []
        self._finish(machine, held, come, out)
        yield self._rows(key, out)


#: State variables of their own need this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def speech_stream(frames: DataFrame, params: VadParams | dict | None = None, rate: int = SAMPLING_RATE, idle_ms: int | None = None) -> DataFrame:
    """Padded speech intervals from a stream of ``rec_id, frame_no, prob``: ``rec_id, k, start, end`` in samples, as ``speech_segments`` finds them in a table.

    Frames of a recording come in order over any number of batches, and in any order within one.
    """
    processor = SpeechProcessor(VadParams.of(params), rate, idle_ms)
    mode = "None" if idle_ms is None else "ProcessingTime"
    return frames.select("rec_id", "frame_no", "prob").groupBy("rec_id").transformWithStateInPandas(processor, "rec_id long, k long, start long, end long", "Append", mode)
