"""Secrets in texts: assignments, access keys and hexadecimal digests by pattern, and other random strings by character Markov models.

Two chains over characters, one of random strings and one of ordinary identifiers, are counted from labelled samples; a token is a secret where
its log-likelihood ratio is above a margin. All of it is built-in functions: places come from the lengths of what a pattern matches and of what
lies between, ratios from a literal table that is summed over a token's characters. Nothing but the samples' counts shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import text_or_empty

#: Kinds in the order of their listing: pattern, the group whose length counts, its least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),
}
RANDOM = "random"
NAMES = (*KINDS, RANDOM)
#: What the chains judge: long runs of the alphabet, with padding, that hold a digit and a letter.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_WIDTH = len(ALPHABET) + 1
#: A token counts where random is likelier than ordinary by this many nats: one token in e^12 (160,000) is taken for a secret beforehand.
MARGIN = 12.0
#: Rows whose words are the ordinary sample, about, and generated strings in the random sample: the bounds of the labelled samples.
SAMPLE_ROWS, SAMPLE_STRINGS = 3000, 6000
_BLOCK = 256


def running(values: Column, join: Callable[[Column, Column], Column], zero: int) -> Column:
    """Running results of an associative ``join`` over a column of integer arrays, by blocks, so that no long array is copied for each element."""

    def inside(block: Column, begin: Column) -> Column:
        return F.slice(F.aggregate(block, F.array(begin), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x)))), F.lit(2), F.size(block))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda j: F.slice(values, j * _BLOCK + 1, F.lit(_BLOCK)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), join))
    begins = F.concat(F.array(F.lit(zero)), inside(totals, F.lit(zero)))
    many = F.flatten(F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(begins) - 1), inside))
    return F.when(F.size(values) <= _BLOCK, inside(values, F.lit(zero))).otherwise(many)


def _matches(text: Column, pattern: str, counted: Column) -> Column:
    """What a pattern finds, null where it finds nothing: lengths of the matches, of what lies before each, and what counts of each."""
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.when(text.rlike(pattern), F.struct(lengths.alias("lengths"), gaps.alias("gaps"), counted.alias("counted")))


def _spans(kind: int, counts: Callable[[Column], Column]) -> Column:
    """Spans of a kind by the ends of its matches, for those that ``counts`` holds for."""
    name = NAMES[kind]
    found = F.arrays_zip(F.col(f"m_{name}.lengths").alias("length"), F.col(f"e_{name}").alias("end"), F.col(f"m_{name}.counted").alias("counted"))
    kept = F.filter(found, lambda m: counts(m["counted"]))
    return F.transform(kept, lambda m: F.struct((m["end"] - m["length"]).alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def ratio(token: Column, table: Column) -> Column:
    """Log-likelihood ratio of a token, random against ordinary, by a literal table of transitions."""
    code = lambda c: F.position(c, F.lit(ALPHABET))
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.struct(code(c).alias("last"), (a["sum"] + F.element_at(table, a["last"] * _WIDTH + code(c) + 1)).alias("sum"))
    return F.aggregate(chars, start, step, lambda a: a["sum"])


class MarkovModel:
    """Log ratios of transitions, random against ordinary, in the order of (last character, character); 0 is the start, or a foreign character."""

    def __init__(self, table: Sequence[float]):
        self.table = list(table)

    def column(self) -> Column:
        """A literal once the optimizer has folded it."""
        return F.split(F.lit(",".join(f"{x:.6f}" for x in self.table)), ",").cast("array<double>")


def random_strings(spark: SparkSession, n: int) -> DataFrame:
    """``value``: generated strings as keys and digests are written: base64, its URL form, lower-case hexadecimal, capitals and digits."""
    digest = F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")), 256)
    text = F.base64(F.unhex(digest))
    capitals = F.upper(F.regexp_replace(text, "[+/=]", ""))
    forms = F.when(F.col("id") % 4 == 0, text).when(F.col("id") % 4 == 1, F.translate(F.regexp_replace(text, "=", ""), "+/", "-_")).when(F.col("id") % 4 == 2, F.substring(digest, 1, 40))
    return spark.range(n).select(forms.otherwise(F.substring(capitals, 1, 32)).alias("value"))


def labelled_sample(spark: SparkSession, docs: DataFrame, rows: int = SAMPLE_ROWS, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """``value, random``: generated strings and what the patterns find are random; other words, alone and joined as identifiers are, are ordinary.

    About ``rows`` rows are drawn by a hash of their text and doc_id.
    """
    part = min(1.0, rows / max(1, docs.count()))
    drawn = docs.select(text_or_empty().alias("text"), F.xxhash64(text_or_empty(), *(["doc_id"] if "doc_id" in docs.columns else [])).alias("h"))
    drawn = drawn.where(F.pmod("h", F.lit(1_000_000_000)) < part * 1_000_000_000).select("text")
    rest, known = F.col("text"), []
    for pattern, group, _ in KINDS.values():
        known.append(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)))
        rest = F.regexp_replace(rest, pattern, " ")
    taken = drawn.select(F.flatten(F.array(*known)).alias("known"), F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_-]{4,}"), F.lit(0)).alias("words"))
    signs = F.array(F.lit("_"), F.lit("-"), F.lit("/"))
    joined = F.transform(F.slice("words", F.lit(2), F.size("words")), lambda w, i: F.when(i % 4 == 3, F.concat(F.initcap(F.get("words", i)), F.initcap(w))).otherwise(F.concat(F.get("words", i), F.get(signs, i % 4), w)))
    ordinary = taken.select(F.explode(F.concat("words", joined)).alias("value"), F.lit(False).alias("random"))
    random = taken.select(F.explode("known").alias("value")).where(F.length("value") >= 16).union(random_strings(spark, strings))
    return ordinary.union(random.withColumn("random", F.lit(True)))


def fit(labelled: DataFrame) -> MarkovModel:
    """Counts the transitions of labelled strings (``value, random``); half a count is added to each. At most 2 * 67 * 67 counts reach the driver."""
    chars = labelled.where("value is not null").select("random", F.filter(F.split("value", ""), lambda c: c != "").alias("c"))
    code = lambda c: F.position(c, F.lit(ALPHABET))
    steps = F.transform("c", lambda c, i: F.struct(F.when(i == 0, 0).otherwise(code(F.get("c", i - 1))).alias("a"), code(c).alias("b")))
    pairs = chars.select("random", F.explode(steps).alias("s")).groupBy("random", F.col("s.a").alias("a"), F.col("s.b").alias("b")).agg(F.count("*").alias("n"))
    n = {True: [0.5] * _WIDTH**2, False: [0.5] * _WIDTH**2}
    for r in pairs.collect():
        n[r.random][r.a * _WIDTH + r.b] += r.n
    share = {k: [x / sum(v[a : a + _WIDTH]) for a in range(0, _WIDTH**2, _WIDTH) for x in v[a : a + _WIDTH]] for k, v in n.items()}
    return MarkovModel([math.log(p / q) for p, q in zip(share[True], share[False], strict=True)])


def scan(spark: SparkSession, docs: DataFrame, model: MarkovModel | None = None, margin: float = MARGIN, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, and ``base, spans`` of every row: arrays of (start, kind, end) in code points, ends exclusive, by start.

    ``base`` has the spans of KINDS (kinds 0 to 2), leftmost and not overlapping within a kind; ``spans`` also those that the chains find
    (kind 3) outside them. Without a model one is fitted on a bounded sample of ``docs``. Null and empty texts have no spans; texts are read
    whole and of any length; repeated rows get equal spans; an empty table gives no rows. Columns of ``keep`` that are called as the results are replaced.
    """
    model = model or fit(labelled_sample(spark, docs))
    named = [c for c in keep if c.lower() not in ("doc_id", "base", "spans")]
    rows = docs.select("doc_id", F.struct(*named).alias("kept") if named else F.lit(None).alias("kept"), text_or_empty().alias("text"))
    text, carried = F.col("text"), ["doc_id", "kept"]
    sizes = {name: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) for name, (pattern, group, _) in KINDS.items()}
    found = [_matches(text, KINDS[name][0], sizes[name]).alias(f"m_{name}") for name in KINDS]
    rows = rows.select(*carried, *found, _matches(text, TOKEN, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias(f"m_{RANDOM}"))
    steps = [F.zip_with(F.slice(f"m_{n}.gaps", F.lit(1), F.size(f"m_{n}.lengths")), f"m_{n}.lengths", lambda a, b: a + b).alias(f"e_{n}") for n in NAMES]
    rows = rows.select("*", *steps)
    rows = rows.select(*carried, *(f"m_{n}" for n in NAMES), *(running(F.col(f"e_{n}"), lambda a, b: a + b, 0).alias(f"e_{n}") for n in NAMES))
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    long_enough = [_spans(k, lambda size, least=least: size >= least) for k, (_, _, least) in enumerate(KINDS.values())]
    table = model.column()
    likely = _spans(len(KINDS), lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]") & (ratio(t, table) >= margin))
    rows = rows.select(*carried, F.array_sort(F.concat(*(F.coalesce(x, none) for x in long_enough))).alias("base"), F.coalesce(likely, none).alias("likely"))
    # tokens that touch no base span: none before them ends behind their start, none after them starts before their end
    rows = rows.withColumn("all", F.when(F.size("likely") > 0, F.array_sort(F.concat("base", "likely"))))
    rows = rows.withColumn("ends", F.transform("all", lambda s: F.when(s["kind"] < len(KINDS), s["end"]).otherwise(0)))
    rows = rows.withColumn("starts", F.transform(F.reverse("all"), lambda s: F.when(s["kind"] < len(KINDS), -s["start"]).otherwise(-(1 << 31) + 1)))
    rows = rows.select(*carried, "base", "all", running(F.col("ends"), lambda a, b: F.greatest(a, b), 0).alias("ends"), F.reverse(running(F.col("starts"), lambda a, b: F.greatest(a, b), -(1 << 31) + 1)).alias("starts"))
    apart = F.filter(F.arrays_zip("all", "ends", "starts"), lambda z: (z["all"]["kind"] == len(KINDS)) & (z["ends"] <= z["all"]["start"]) & (-z["starts"] >= z["all"]["end"]))
    rows = rows.select(*carried, "base", F.array_sort(F.concat("base", F.coalesce(F.transform(apart, lambda z: z["all"]), none))).alias("spans"))
    return rows.select("doc_id", *(F.col("kept")[c].alias(c) for c in named), "base", "spans")


def listed(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, NAMES)), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: str, name: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == NAMES.index(name))).cast("long")
