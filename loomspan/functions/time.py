"""Times, sizes and their printed forms, as column expressions.

Halves round to even (``bround``), which agrees with exact binary rounding except where the decimal rendering
of a double hides on which side of the half it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..params import FRAMES_PER_SECOND, SAMPLING_RATE, SECONDS_PER_TOKEN, TOKENS_PER_SECOND


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def clock(seconds: Column, always_include_hours: bool = False, decimal_marker: str = ".") -> Column:
    """``[HH:]MM:SS.mmm``; hours where there are any or always."""
    ms = F.bround(seconds * 1000).cast("long")
    hours, minutes, secs, rest = (F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000), F.floor(ms % 60_000 / 1000), ms % 1000)
    tail = F.concat(_two(minutes), F.lit(":"), _two(secs), F.lit(decimal_marker), F.lpad(rest.cast("string"), 3, "0"))
    # lpad cuts, so hours of three digits are kept as they are
    head = F.concat(F.when(hours < 10, F.lit("0")).otherwise(F.lit("")), hours.cast("string"), F.lit(":"))
    return F.concat(head, tail) if always_include_hours else F.when(hours > 0, F.concat(head, tail)).otherwise(tail)


def subtitle_clock(seconds: Column) -> Column:
    return clock(seconds, True, ",")


def human_size(n: Column, largest: str = "TB") -> Column:
    """Bytes in the largest unit that leaves at least 1, one decimal place from KB on; nothing goes beyond the unit ``largest``."""
    units = ["KB", "MB", "GB", "TB"]
    top = units.index(largest) + 1
    out = F.format_string(f"%.1f {largest}", F.bround(n / float(1024**top), 1))
    for k in range(top - 1, 0, -1):
        out = F.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {units[k - 1]}", F.bround(n / float(1024**k), 1))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def samples_of(seconds: Column) -> Column:
    return F.floor(seconds * SAMPLING_RATE).cast("long")


def frames_of(seconds: Column) -> Column:
    return F.floor(seconds * FRAMES_PER_SECOND).cast("long")


def tokens_of(seconds: Column) -> Column:
    return F.floor(seconds * TOKENS_PER_SECOND).cast("long")


def token_seconds(token: Column, timestamp_begin: int) -> Column:
    return (token - timestamp_begin) * SECONDS_PER_TOKEN


def real_time_factor(duration: Column, elapsed: Column) -> Column:
    return duration / F.greatest(elapsed, F.lit(1e-6))
