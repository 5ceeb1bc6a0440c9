"""SQL access: derived relations as temporary views, and functions by name."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import SparkSession, functions as F

from .functions import text as T
from .sources import relations as R

RELATIONS = ("words", "segments", "frames", "intervals", "tokens", "attempts", "report_rows")


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """Names the derived relations for SQL; nothing is computed until a query asks."""
    for name in RELATIONS:
        getattr(R, name)(spark, sf_dir).createOrReplaceTempView(name)
    return list(RELATIONS)


def numeral(s: str) -> int:
    done = part = digit = 0
    for ch in s:
        unit = T.UNITS.get(ch)
        if unit is None:
            digit = 2 if ch == T.TWO else T.DIGITS.index(ch)
            continue
        if unit == 10_000:
            done, part = done + (part + digit) * unit, 0
        else:
            part += max(digit, 1) * unit
        digit = 0
    return done + part + digit


def normalised(t: str) -> str:
    return re.sub(T.IGNORED, "", unicodedata.normalize("NFKC", t)).lower()


def numbers_in_digits(t: str) -> str:
    t = re.sub(f"{T.MARK}({T.NUMERAL}+)", lambda m: f"{numeral(m[1])}%", t.replace(T.PERCENT, T.MARK))
    return re.sub(f"{T.NUMERAL}+(?={T.BEFORE})", lambda m: str(numeral(m[0])), t)


def flat(t: str) -> str:
    return numbers_in_digits(normalised(t)).replace(T.MARK, "")


def register_functions(spark: SparkSession) -> list[str]:
    """Vectorised functions for SQL text, which can't name column functions; DataFrames have the latter, in built-in functions."""
    functions = {"normalise_text": (normalised, "string"), "numbers_in_digits": (numbers_in_digits, "string"), "flatten_text": (flat, "string"), "compression_ratio": (T.compressed_ratio, "double")}
    for name, (f, kind) in functions.items():
        spark.udf.register(name, F.pandas_udf(lambda s, f=f: s.map(lambda t: None if t is None else f(t)), kind))
    return list(functions)
