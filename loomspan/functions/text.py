"""Text normalisation, numbers in Chinese script, edit distance and ratios."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from .forms import composed

# Characters that an error rate does not count, digits and units of Chinese numerals,
# and the characters before which a numeral is rewritten.
IGNORED = r"[\s，。、；：？！“”‘’（）《》〈〉【】「」,.!?;:\"'()\[\]<>~—…·\-_/\\|]+"
BLANKS = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"  # white space
DIGITS = "零一二三四五六七八九"
TWO = "两"
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}
NUMERAL = "[零一二三四五六七八九十百千万两]"
BEFORE = "[点分个元年月日时秒倍天周号层]"
PERCENT, MARK = "百分之", "\x00"


def normalised(text: Column) -> Column:
    """Lower case without ignored characters; exact where compatibility forms don't occur (``normalise`` folds those too)."""
    return F.lower(F.regexp_replace(text, IGNORED.replace(r"\s", BLANKS), ""))


def _mapped(f, kind: str, *columns) -> Column:
    """A vectorised function of whole values; null where any argument is null. Made when it is asked for, as workers import this module too."""

    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*parts, strict=True)], dtype=object)

    if len(columns) == 1:
        return F.pandas_udf(lambda a: run(a), kind)(*columns)
    return F.pandas_udf(lambda a, b: run(a, b), kind)(*columns)


def normalise(text) -> Column:
    """Compatibility composition, then as ``normalised``."""
    return normalised(composed(F.col(text) if isinstance(text, str) else text))


def numeral_value(s: Column) -> Column:
    """Value of a Chinese numeral as text. Digits in a row overwrite each other, a bare ten counts 10, a bare ten thousand 0."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("section"), F.lit(0).cast("long").alias("number"))

    def step(acc: Column, ch: Column) -> Column:
        digit = F.when(ch == TWO, 2).otherwise(F.instr(F.lit(DIGITS), ch) - 1).cast("long")
        unit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in UNITS.items() for x in (k, v))), ch), F.lit(0)).cast("long")
        nothing = F.lit(0).cast("long")
        large = (acc["section"] + acc["number"]) * unit
        small = acc["section"] + F.when(acc["number"] == 0, F.lit(1).cast("long")).otherwise(acc["number"]) * unit
        return (
            F.when(unit == 0, F.struct(acc["total"].alias("total"), acc["section"].alias("section"), digit.alias("number")))
            .when(unit == 10000, F.struct((acc["total"] + large).alias("total"), nothing.alias("section"), nothing.alias("number")))
            .otherwise(F.struct(acc["total"].alias("total"), small.alias("section"), nothing.alias("number")))
        )

    return F.aggregate(F.split(s, ""), zero, step, lambda a: (a["total"] + a["section"] + a["number"]).cast("string"))


def normalise_numbers(text) -> Column:
    """Percentages, and numerals before a counting word, in digits. A percent phrase without numeral leaves a NUL."""
    marked = F.replace(F.col(text) if isinstance(text, str) else text, F.lit(PERCENT), F.lit(MARK))
    split = F.struct(F.split(marked, f"{NUMERAL}+", -1).alias("between"), F.regexp_extract_all(marked, F.lit(f"{NUMERAL}+"), F.lit(0)).alias("numerals"))

    def rewritten(s: Column, gap: Column, i: Column) -> Column:
        numeral, percent = F.get(s["numerals"], i), F.endswith(gap, F.lit(MARK))
        value = F.when(percent, F.concat(F.left(gap, F.length(gap) - 1), numeral_value(numeral), F.lit("%"))).when(F.get(s["between"], i + 1).rlike(f"^{BEFORE}"), F.concat(gap, numeral_value(numeral)))
        return F.when(numeral.isNull(), gap).otherwise(F.coalesce(value, F.concat(gap, numeral)))

    # the text is split once, and bound to a name
    parts = F.transform(F.array(split), lambda s: F.array_join(F.transform(s["between"], lambda gap, i: rewritten(s, gap, i)), ""))
    return F.when(marked.isNotNull(), parts[0])


def flatten(text) -> Column:
    """Text as words are labelled on: normalised, numbers in digits, no NUL."""
    return F.replace(normalise_numbers(normalise(text)), F.lit(MARK), F.lit(""))


OK, SUB, DEL, INS = "ok", "sub", "del", "ins"
_FAR = 1 << 29
#: Elements compared at once where two sequences go on alike; rows of so few edits are all kept.
_STRIDE, _ROWS = 32, 1024


class _Reach:
    """How far along each diagonal of the edit table of two sequences of codes so many edits lead.

    Distances never fall along a diagonal, so that row d tells of every cell whether its distance is at most d. Diagonals are told by column
    less row; a row is the first diagonal and, from it on, the last row number within reach.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.n, self.m = len(a), len(b)
        # foreign codes beyond the ends stop every run
        self.a, self.b = (np.append(x, np.full(_STRIDE + 1, -1 - k, dtype=np.int32)) for k, x in enumerate((a, b)))
        self.wide_a, self.wide_b = (np.lib.stride_tricks.sliding_window_view(x, _STRIDE) for x in (self.a, self.b))

    def _slid(self, low: int, at: np.ndarray) -> tuple[int, np.ndarray]:
        along = np.arange(low, low + len(at), dtype=np.int32)
        at = np.minimum(at, np.minimum(self.n, self.m - along))
        on = np.flatnonzero(self.a[at] == self.b[at + along])
        while len(on):
            same = self.wide_a[at[on]] == self.wide_b[at[on] + along[on]]
            run = np.where(same.all(axis=1), _STRIDE, same.argmin(axis=1)).astype(np.int32)
            at[on] += run
            on = on[run == _STRIDE]
        return low, at

    def first(self) -> tuple[int, np.ndarray]:
        return self._slid(0, np.zeros(1, dtype=np.int32))

    def next(self, row: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
        low, at = row
        edge = np.full(2, -_FAR, dtype=np.int32)
        wide = np.concatenate([edge, at, edge])  # from diagonal low - 2 on
        new = np.maximum(np.maximum(wide[1:-1], wide[2:]) + 1, wide[:-2])  # a substitution, a deletion, an insertion
        start, end = max(low - 1, -self.n), min(low + len(at), self.m)
        return self._slid(start, new[start - low + 1 : end - low + 2])

    def ends(self, row: tuple[int, np.ndarray]) -> bool:
        return self.holds(row, self.n, self.m)

    @staticmethod
    def holds(row: tuple[int, np.ndarray], i: int, j: int) -> bool:
        k = j - i - row[0]
        return 0 <= k < len(row[1]) and i <= row[1][k]


def _coded(ref, hyp) -> tuple[np.ndarray, np.ndarray]:
    code: dict = {}
    return tuple(np.array([code.setdefault(x, len(code)) for x in s], dtype=np.int32) for s in (ref, hyp))


def edit_distance(ref, hyp) -> int:
    reach = _Reach(*_coded(ref, hyp))
    row, distance = reach.first(), 0
    while not reach.ends(row):
        row, distance = reach.next(row), distance + 1
    return distance


def edit_ops(ref, hyp) -> tuple[int, list[tuple[str, object, object]]]:
    """Distance and operations between two sequences, by backward walk: diagonal first, then deletion, then insertion.

    Equal elements are a step along the diagonal; at others, the row of one edit less tells which steps are cheapest. Of many rows those of square
    numbers are kept, and the ones between two of them are made again when the walk gets there. Time grows with the lengths and the square of the distance.
    """
    a, b = _coded(ref, hyp)
    reach = _Reach(a, b)
    row, distance, kept = reach.first(), 0, {}
    while not reach.ends(row):
        if distance < _ROWS or math.isqrt(distance) ** 2 == distance:
            kept[distance] = row
        row, distance = reach.next(row), distance + 1
    a, b = a.tolist(), b.tolist()
    i, j, left, ops = len(a), len(b), distance, []
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            ops.append((OK, ref[i], hyp[j]))
            continue
        left -= 1
        if left not in kept:
            k = math.isqrt(left) ** 2
            while k < left:
                kept[k + 1] = reach.next(kept[k])
                k += 1
        row = kept.pop(left)
        if i and j and reach.holds(row, i - 1, j - 1):
            i, j = i - 1, j - 1
            ops.append((SUB, ref[i], hyp[j]))
        elif i and reach.holds(row, i - 1, j):
            i -= 1
            ops.append((DEL, ref[i], None))
        else:
            j -= 1
            ops.append((INS, None, hyp[j]))
    return distance, ops[::-1]


def edit_counts(ref, hyp) -> Column:
    """Substitutions, deletions and insertions of the preferred alignment of two texts, as an array."""

    def counts(r: str, h: str) -> list[int]:
        tags = [tag for tag, *_ in edit_ops(r, h)[1]]
        return [tags.count(tag) for tag in (SUB, DEL, INS)]

    return _mapped(counts, "array<bigint>", ref, hyp)


def alignment(ref, hyp) -> Column:
    """Operations between two texts, character by character."""
    return _mapped(lambda r, h: [{"tag": t, "ref": a, "hyp": b} for t, a, b in edit_ops(r, h)[1]], "array<struct<tag: string, ref: string, hyp: string>>", ref, hyp)


def word_distance(ref, hyp) -> Column:
    """Edits between the blank-separated words of two texts."""
    return _mapped(lambda r, h: edit_distance(r.split(), h.split()), "long", ref, hyp)


def compressed_ratio(t: str) -> float:
    b = t.encode("utf-8", "surrogatepass")
    return len(b) / len(zlib.compress(b))


def compression_ratio(text) -> Column:
    """Bytes over compressed bytes."""
    return _mapped(compressed_ratio, "double", text)


def character_error_rate(distance: Column, ref_length: Column) -> Column:
    return distance / F.greatest(ref_length, F.lit(1))


def ratio_text(value: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, F.format_string("%.2f", F.bround(value, 2))).otherwise(F.lit("-"))


def without_stars(t: Column) -> Column:
    return F.trim(F.replace(t, F.lit("*"), F.lit("")))


def language_of_token(t: Column) -> Column:
    """``<|en|>`` to ``en``."""
    return F.substr(t, F.lit(3), F.length(t) - 4)
