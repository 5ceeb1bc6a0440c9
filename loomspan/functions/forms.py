"""Compatibility composition of text (NFKC) in built-in functions, by tables that the character database of Python gives."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

PLANES = range(0x30000)  # beyond them no character changes or combines
SEPARATOR = "\x1f"
HANGUL = range(0xAC00, 0xD7A4)
_LEADS, _VOWELS, _TAILS = range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)
_PAGE = 256


@functools.cache
def _sets() -> tuple[dict[str, str], set[int], set[int]]:
    """Pairs that compose, code points that may join what is before them, and others that change by themselves."""
    pairs = {}
    for c in map(chr, PLANES):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", pair) == c:
                pairs[pair] = c
    seconds = {p[1] for p in pairs} | {chr(c) for c in (*_VOWELS, *_TAILS)}
    first = {c: unicodedata.normalize("NFKD", chr(c))[0] for c in PLANES}
    joining = {c for c, f in first.items() if unicodedata.combining(f) or f in seconds}
    changing = {c for c in PLANES if c not in joining and unicodedata.normalize("NFKC", chr(c)) != chr(c)}
    return pairs, joining, changing


def _ranges(codes: Iterable[int], gap: int = 1) -> str:
    """Inside of a character class; ranges at most ``gap`` apart become one."""
    out: list[list[int]] = []
    for c in sorted(codes):
        if out and c - out[-1][1] <= gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


@functools.cache
def _classes() -> tuple[str, str, str]:
    """Classes of what joins, of what changes, and of marks. The first two hold more than they must: what needn't change comes out as it was."""
    _, joining, changing = _sets()
    marks = [c for c in PLANES if unicodedata.combining(chr(c))]
    return _ranges(joining, 8), _ranges(changing, 8), _ranges(marks)


def _by_code(values: dict[int, str]) -> Callable[[Column], Column]:
    """A lookup of characters in constant time: the page of a code point, then its place there; empty where there is nothing."""
    pages = sorted({c // _PAGE for c in values})
    at = {p: i for i, p in enumerate(pages)}
    index = SEPARATOR.join(str(at.get(p, -1)) for p in range(PLANES.stop // _PAGE))
    content = SEPARATOR.join(values.get(p * _PAGE + i, "") for p in pages for i in range(_PAGE))

    def look(ch: Column) -> Column:
        code = F.ascii(ch)
        page = F.get(F.split(F.lit(index), SEPARATOR).cast("array<int>"), F.shiftright(code, 8))
        return F.when(page >= 0, F.get(F.split(F.lit(content), SEPARATOR), page * _PAGE + code.bitwiseAND(_PAGE - 1))).otherwise(F.lit(""))

    return look


@functools.cache
def _values(kind: str) -> dict[int, str]:
    if kind == "class":
        return {c: str(unicodedata.combining(chr(c))) for c in PLANES if unicodedata.combining(chr(c))}
    return {c: t for c in PLANES if c not in HANGUL and (t := unicodedata.normalize(kind, chr(c))) != chr(c)}


def _or_itself(look: Callable[[Column], Column], ch: Column) -> Column:
    found = look(ch)
    return F.when(found == "", ch).otherwise(F.coalesce(found, ch))


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _pair(starter: Column, ch: Column) -> Column:
    """What two characters compose to, or null; syllables of jamo by their arithmetic."""
    pairs = _sets()[0]
    known = F.map_from_arrays(F.split(F.lit(SEPARATOR.join(pairs)), SEPARATOR), F.split(F.lit(SEPARATOR.join(pairs.values())), SEPARATOR))
    a, b = F.ascii(starter), F.ascii(ch)
    within = lambda x, r: x.between(r.start, r.stop - 1)
    syllable = F.lit(HANGUL.start) + ((a - _LEADS.start) * len(_VOWELS) + (b - _VOWELS.start)) * 28
    return (
        F.when(within(a, _LEADS) & within(b, _VOWELS), _character(syllable))
        .when(within(a, HANGUL) & ((a - HANGUL.start) % 28 == 0) & within(b, _TAILS), _character(a + (b - _TAILS.start + 1)))
        .otherwise(F.try_element_at(known, F.concat(starter, ch)))
    )


def _cluster(text: Column) -> Column:
    """A character and what may join it: taken apart, marks in canonical order, put together again."""
    apart, order = _by_code(_values("NFKD")), _by_code(_values("class"))
    marks = _classes()[2]
    rank = lambda ch: F.coalesce(order(ch).try_cast("int"), F.lit(0))
    whole = F.array_join(F.transform(F.split(text, ""), lambda ch: _or_itself(apart, ch)), "")
    runs = F.regexp_extract_all(whole, F.lit(f"[^{marks}][{marks}]*|[{marks}]+"), F.lit(0))
    ranked = F.flatten(F.transform(runs, lambda r: F.array_sort(F.transform(F.split(r, ""), lambda ch, i: F.struct(rank(ch).alias("rank"), i.alias("i"), ch.alias("ch"))))))
    state = lambda done, starter, tail, last: F.struct(done.alias("done"), starter.alias("starter"), tail.alias("tail"), last.alias("last"))
    none = F.lit("")

    def step(s: Column, x: Column) -> Column:
        joined = F.when((s["starter"] != "") & ((s["last"] == 0) | (s["last"] < x["rank"])), _pair(s["starter"], x["ch"]))
        return F.transform(
            F.array(joined),
            lambda j: F.when(j.isNotNull(), state(s["done"], F.coalesce(j, none), s["tail"], s["last"]))
            .when(x["rank"] == 0, state(F.concat(s["done"], s["starter"], s["tail"]), x["ch"], none, F.lit(0)))
            .otherwise(state(s["done"], s["starter"], F.concat(s["tail"], x["ch"]), x["rank"])),
        )[0]

    return F.aggregate(ranked, state(none, none, none, F.lit(0)), step, lambda s: F.concat(s["done"], s["starter"], s["tail"]))


def composed(text: Column) -> Column:
    """Compatibility composition (NFKC) as of the character database of the driver's Python.

    Null stays null, and texts without a character that changes or joins another are returned as they are. Elsewhere only such characters and
    those before them are looked at; the work is linear in the text, but for a character's marks: it grows with the square of their number.
    """
    joining, changing, _ = _classes()
    touched = f"[^{joining}]?[{joining}]+|[{changing}]"
    single = _by_code(_values("NFKC"))
    new = F.transform(F.regexp_extract_all(text, F.lit(touched), F.lit(0)), lambda c: F.when(F.length(c) == 1, _or_itself(single, c)).otherwise(_cluster(c)))
    parts = F.zip_with(F.split(text, touched, -1), new, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit(""))))
    return F.when(text.rlike(f"[{joining}{changing}]"), F.array_join(parts, "")).otherwise(text)
