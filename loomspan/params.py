"""Parameters of queries. They live on the driver and are never data."""

from __future__ import annotations

from dataclasses import dataclass, field

SAMPLING_RATE = 16_000
FRAMES_PER_SECOND = 100
TOKENS_PER_SECOND = 50
SECONDS_PER_TOKEN = 0.02
WINDOW_FRAMES = 3000
BLOCK = 512  # samples in a speech-probability frame


@dataclass(frozen=True)
class VadParams:
    """Speech segmentation. Durations in milliseconds unless named otherwise; None derives the lower threshold."""

    threshold: float = 0.5
    neg_threshold: float | None = None
    min_speech_duration_ms: int = 0
    max_speech_duration_s: float = float("inf")
    min_silence_duration_ms: int = 2000
    speech_pad_ms: int = 400
    min_silence_at_max_speech: int = 98
    use_max_poss_sil_at_max_speech: bool = True

    @classmethod
    def of(cls, value: "VadParams | dict | None") -> "VadParams":
        """Takes a mapping as well; the caller's is left as it is."""
        return value if isinstance(value, cls) else cls(**(value or {}))

    @property
    def low(self) -> float:
        return max(self.threshold - 0.15, 0.01) if self.neg_threshold is None else self.neg_threshold

    def samples(self, ms: float, rate: int = SAMPLING_RATE) -> float:
        return rate * ms / 1000

    def longest(self, rate: int = SAMPLING_RATE) -> float:
        return rate * self.max_speech_duration_s - BLOCK - 2 * self.samples(self.speech_pad_ms, rate)


@dataclass(frozen=True)
class DecodeParams:
    """Decoding and what follows it."""

    language: str | None = None
    task: str = "transcribe"
    beam_size: int = 5
    best_of: int = 5
    patience: float = 1
    length_penalty: float = 1
    repetition_penalty: float = 1
    no_repeat_ngram_size: int = 0
    temperatures: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
    compression_ratio_threshold: float | None = 2.4
    log_prob_threshold: float | None = -1.0
    no_speech_threshold: float | None = 0.6
    condition_on_previous_text: bool = True
    prompt_reset_on_temperature: float = 0.5
    initial_prompt: str | None = None
    prefix: str | None = None
    hotwords: str | None = None
    suppress_blank: bool = True
    suppress_tokens: tuple[int, ...] = (-1,)
    without_timestamps: bool = False
    max_initial_timestamp: float = 1.0
    word_timestamps: bool = False
    prepend_punctuations: str = "\"'“¿([{-"
    append_punctuations: str = "\"'.。,，!！?？:：”)]}、"
    multilingual: bool = False
    max_new_tokens: int | None = None
    chunk_length: int | None = None
    clip_timestamps: str | list = "0"
    hallucination_silence_threshold: float | None = None
    language_detection_threshold: float = 0.5
    language_detection_segments: int = 1
    batch_size: int = 8

    def __post_init__(self):
        if self.task not in ("transcribe", "translate"):
            raise ValueError(f"unknown task {self.task!r}")

    def batched(self) -> "DecodeParams":
        """What the batched plan uses: one temperature, no fallback, no prompt carry."""
        from dataclasses import replace

        return replace(self, temperatures=self.temperatures[:1], condition_on_previous_text=False, without_timestamps=True, max_initial_timestamp=0.0, hallucination_silence_threshold=None)


@dataclass(frozen=True)
class SpecialTokens:
    """Ids at which tokens change their meaning; ``eot`` and above are special, ``timestamp_begin`` and above are times."""

    eot: int = 50257
    sot: int = 50258
    english: int = 50259
    translate: int = 50358
    transcribe: int = 50359
    sot_lm: int = 50360
    sot_prev: int = 50361
    no_speech: int = 50362
    no_timestamps: int = 50363
    timestamp_begin: int = 50364
    non_speech: tuple[int, ...] = field(default=(1, 2, 7, 8, 9, 10, 14, 25, 26, 27))


def check_threshold(value: float) -> float:
    """A review threshold lies strictly between 0 and 1."""
    if not 0 < value < 1:
        raise ValueError("threshold must lie between 0 and 1")
    return value


def check_device(device: str, compute_type: str) -> None:
    if device == "cpu" and compute_type == "float16":
        raise ValueError("float16 is not available on cpu")


def effective_language(multilingual_model: bool, language: str | None) -> str | None:
    """A model for English only knows no other language."""
    return language if multilingual_model else "en"
