"""Fuzzy line dedup by MinHash, with DataFrame operations only.

A line's shingles are its windows of ``WINDOW`` characters (UTF-16 units), at every character; a shorter line is one shingle. One 64-bit hash
a shingle serves all signatures: component i is the least of the hashes after a bitwise xor with a constant of its own, which
is the shingle nearest to that constant, equal in two sets with the probability of their similarity.
The 16 components are the points of an affine plane of order 4, and its 20 lines, four points each, are the bands: similar lines
have some band in common (0.98 at similarity 0.75, more above), others seldom (0.15 at 0.3).

Each band's lines are verified against its smallest by the exact Jaccard similarity of the shingle sets. Where that leaves a band in
several components, its lines are verified against the shortest too: what many lines hold is most of the shortest of them. Lines of bands
that are then still open meet by prefixes: of the shingles, rarest first, two sets that reach the threshold have one in common before a place that their
sizes tell, unless sketches tell that they differ in too many. That loses no pair of such a band, and what very many lines hold stands last.
Distributed union-find joins what was verified, and one line of each component stays: the first by (doc_id, line).

Equal lines are one content from the start, whatever their number. For signatures, windows are rows of generated code, never arrays.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch, text_or_empty, unused
from .graph import connected_components, joined_components

WINDOW = 12
THRESHOLD = 0.75
#: Order of the affine plane: ORDER ** 2 components, ORDER * (ORDER + 1) bands.
ORDER = 4
#: Pairs that one task verifies, about.
PAIRS = 2000
#: Bands that are dealt out at a time.
PASS = 10
#: Words of 64 bits in a sketch, a power of two, and early shingles that a row remembers.
SKETCH, BEFORE = 16, 4


def _times(a: int, b: int) -> int:
    """Product in the field of four elements."""
    r = a * (b & 1) ^ (a << 1) * (b >> 1)
    return r ^ 7 if r & 4 else r


#: The lines of the plane: columns, and for each slope and intercept the points (x, slope * x + intercept).
BANDS = [[x * ORDER + y for y in range(ORDER)] for x in range(ORDER)] + [[x * ORDER + (_times(m, x) ^ b) for x in range(ORDER)] for m in range(ORDER) for b in range(ORDER)]


def _constants(n: int, seed: int) -> list[int]:
    """Signed 64-bit numbers whose leading bits are spread evenly."""
    bits, draw = max(1, math.ceil(math.log2(n))), random.Random(seed)
    lead = (int(format(i, f"0{bits}b")[::-1], 2) for i in range(n))
    return [(x << 64 - bits | draw.getrandbits(64 - bits)) - (1 << 63) for x in lead]


def lines_of(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id, line_no (from 0), line``: lines end at U+000A; spaces, tabs and carriage returns around them don't count. Null and empty texts have one empty line."""
    split = docs.select("doc_id", *more, F.posexplode(F.split(text_or_empty(), "\n")).alias("line_no", "line"))
    return split.withColumn("line", F.btrim("line", F.lit(" \t\r")))


def shingles(lines: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``h``, the hash of a window, for each window of ``line``: a row each, repeated windows repeatedly."""
    units = lines.select(*keep, F.encode("line", "UTF-16BE").alias("line"))
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.octet_length("line") / 2).cast("int") - WINDOW))
    return units.select(*keep, "line", F.explode(places).alias("at")).select(*keep, F.expr(f"xxhash64(substring(line, 2 * at + 1, {2 * WINDOW}))").alias("h"))


def _components(h: Column, constants: list[int]) -> list[Column]:
    return [F.min(h.bitwiseXOR(F.lit(c))).alias(f"m{i}") for i, c in enumerate(constants)]


def with_bands(lines: DataFrame) -> DataFrame:
    """``lid`` and the bands ``b0, b1, ...`` of rows ``lid, line``."""
    signed = shingles(lines, "lid").groupBy("lid").agg(*_components(F.col("h"), _constants(ORDER**2, 1)))
    return signed.select("lid", *(F.xxhash64(*(f"m{p}" for p in band), F.lit(k)).alias(f"b{k}") for k, band in enumerate(BANDS)))


def _hashes(units: str) -> Column:
    """The hashes of all windows of a line in UTF-16BE, as an array. The line is a variable of an outer function: a column would be copied whole for each window."""
    return F.expr(f"transform(array({units}), u -> transform(sequence(0, greatest(0, int(octet_length(u) div 2) - {WINDOW})), i -> xxhash64(substring(u, 2 * i + 1, {2 * WINDOW}))))[0]")


def verified(scratch: Scratch, pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of distinct pairs (a, b) of ``lid``, those whose shingle sets reach the threshold. Texts move, which are far smaller than their sets."""
    a, b = (texts.select(F.col("lid").alias(x), F.encode("line", "UTF-16BE").alias(f"line_{x}")) for x in "ab")
    met = pairs.join(a, "a").join(b, "b").repartition(1 + pairs.count() // PAIRS)
    sets = met.select("a", "b", *(_hashes(f"line_{x}").alias(f"s{x}") for x in "ab"))
    sizes = sets.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("both"), F.size(F.array_union("sa", "sb")).alias("either"))
    # written before it is filtered, so that no set is made twice
    return scratch.write(sizes, "sizes").where(F.col("both") >= F.lit(threshold) * F.col("either")).select("a", "b")


def _shared(dealt: DataFrame, key: str, *more: Column) -> DataFrame:
    """Rows of ``dealt`` whose ``key`` several rows have, with ``n``, how many do. Rows are dealt out once: what counts them and what they are joined with read one shuffle."""
    dealt = dealt.repartition(key)
    several = dealt.groupBy(key).agg(F.count("*").alias("n"), *more).where("n > 1")
    return dealt.join(several.hint("shuffle_hash"), key)


def _sketched(sets: DataFrame) -> DataFrame:
    """``lid, k0, k1, ...``: of each of 64 * SKETCH buckets of hashes, whether it holds an odd number of the set ``s``. Two sketches differ in no more bits than their sets in elements."""
    word, bit = F.col("h").bitwiseAND(F.lit(SKETCH - 1)), F.expr(f"shiftleft(1L, cast(shiftright(h, {SKETCH.bit_length() - 1}) & 63 as int))")
    words = (F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"k{k}") for k in range(SKETCH))
    return sets.select("lid", F.explode("s").alias("h")).groupBy("lid").agg(*words)


def _met(scratch: Scratch, lines: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of different components among ``lid, comp, line``; every such pair whose similarity reaches the threshold is among them.

    Shingles stand in one order everywhere: those of one component alone first, as they bring no pair, then the rarest. Sets that are alike have their first common shingle early in both, so that enough
    of either is left behind it; no other places meet. Sets whose sketches differ in too many bits don't meet, and a pair meets no further where one of
    the ``BEFORE`` early shingles before is common to both: there it met already, with more left behind it.
    """
    # written, so that the encoding isn't put into the function of each window
    units = scratch.write(lines.select("lid", "comp", F.encode("line", "UTF-16BE").alias("units")), "units")
    # sizes are taken before the sets are exploded, so that no row carries a set
    sets = units.select("lid", "comp", F.array_distinct(_hashes("units")).alias("s")).select("lid", "comp", F.size("s").alias("size"), "s")
    rows = sets.select("lid", "comp", "size", F.explode("s").alias("h"))
    apart = (F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    held = scratch.write(_shared(rows, "h", *apart).where("c0 <> c1").select(*rows.columns, "n"), "held")
    scratch.release()
    # shingles of one component alone are told by the size
    order = Window.partitionBy("lid").orderBy("n", "h")
    placed = held.withColumn("place", F.row_number().over(order) + F.col("size") - F.count("*").over(Window.partitionBy("lid")))
    early = placed.where(F.col("size") - F.col("place") + 1 >= F.lit(threshold) * F.col("size")).select("lid", "comp", "size", "h", "place")
    # written, so that places are told once for what counts them and what they are joined with
    early = placed = scratch.write(early, "placed")
    # what stands early in lines of one component alone brings no pair
    several = scratch.write(_shared(early, "h", *apart).where("c0 <> c1").select(*early.columns), "several")
    scratch.drop(held, placed)
    scratch.release()
    before = F.collect_list("h").over(Window.partitionBy("lid").orderBy("place").rowsBetween(-BEFORE, -1))
    met = units.join(several.select("lid").distinct(), "lid", "left_semi").select("lid", F.array_distinct(_hashes("units")).alias("s"))
    early = scratch.write(several.withColumn("before", before).join(scratch.write(_sketched(met), "sketches"), "lid"), "early")
    scratch.drop(several)
    scratch.release()
    x, y = early.alias("x"), early.alias("y")
    left = "least(x.size - x.place, y.size - y.place) + 1"
    differ = " + ".join(f"bit_count(x.k{k} ^ y.k{k})" for k in range(SKETCH))
    on = f"""x.h = y.h and x.lid < y.lid and x.comp <> y.comp and {left} >= {threshold / (1 + threshold) - 1e-9!r}D * (x.size + y.size)
        and {differ} <= {(1 - threshold) / (1 + threshold) + 1e-9!r}D * (x.size + y.size) and not arrays_overlap(x.before, y.before)"""
    return x.join(y, F.expr(on)).select(F.col("x.lid").alias("a"), F.col("y.lid").alias("b")).distinct()


def _groups(scratch: Scratch, signed: DataFrame) -> DataFrame:
    """``band, lid, n, lo`` of the bands that several lines share: how many do, and the smallest of them. Some bands go at a time, for the sake of the disk."""
    rows = None
    for first in range(0, len(BANDS), PASS):
        dealt = signed.select("lid", F.explode(F.array(*(f"b{k}" for k in range(first, min(first + PASS, len(BANDS)))))).alias("band"))
        more = scratch.write(_shared(dealt, "band", F.min("lid").alias("lo")), "groups")
        rows = more if rows is None else rows.unionByName(more)
        scratch.release()
    return rows


def _open(groups: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of the bands (``band, lid, n, lo``) whose lines lie in several components, with ``comp``."""
    named = groups.where("n > 2").join(comps.withColumnRenamed("node", "lid"), "lid", "left").select(*groups.columns, F.coalesce("component", "lid").alias("comp"))
    apart = named.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("band")
    return named.join(apart, "band")


def content_classes(spark: SparkSession, scratch: Scratch, docs: DataFrame, threshold: float) -> DataFrame:
    """A row for each distinct line that isn't blank: ``k1, k2`` (its key), ``head`` (doc_id and line_no of its component's first line), ``n_alike``."""
    at = F.struct("doc_id", "line_no")
    keyed = lines_of(docs).where("line <> ''").select("doc_id", "line_no", F.xxhash64("line").alias("k1"), F.xxhash64("line", F.lit(1)).alias("k2"), "line")
    unique = keyed.groupBy("k1", "k2").agg(F.min(at).alias("at"), F.count("*").alias("n"), F.first("line").alias("line"))
    unique = scratch.write(unique.select(F.monotonically_increasing_id().alias("lid"), "*"), "unique")
    scratch.release()
    signed = scratch.write(with_bands(unique.select("lid", "line")), "bands")
    scratch.release()
    groups = _groups(scratch, signed)
    scratch.drop(signed)
    pairs = scratch.write(groups.where("lid <> lo").select(F.col("lo").alias("a"), F.col("lid").alias("b")).distinct(), "pairs")
    texts = scratch.write(unique.select("lid", "line").join(groups.select("lid").distinct(), "lid", "left_semi"), "texts")
    scratch.release()
    links = verified(scratch, pairs, texts, threshold)
    comps = scratch.write(connected_components(spark, links, scratch), "components")

    def add(links: DataFrame) -> DataFrame:
        return comps if links.isEmpty() else scratch.write(joined_components(spark, comps, links, scratch), "components")

    rest = scratch.write(_open(groups, comps).join(texts.select("lid", F.length("line").alias("size")), "lid"), "open")
    centres = rest.groupBy("band").agg(F.min(F.struct("size", "lid", "comp")).alias("c"))
    second = rest.join(centres, "band").where("comp <> c.comp").select(F.least("lid", "c.lid").alias("a"), F.greatest("lid", "c.lid").alias("b")).distinct()
    comps = add(verified(scratch, scratch.write(second.join(pairs, ["a", "b"], "left_anti"), "second"), texts, threshold))

    rest = _open(groups, comps).select("lid", "comp").distinct()
    apart = scratch.write(_met(scratch, texts.join(rest, "lid"), threshold), "apart")
    scratch.release()
    comps = add(verified(scratch, apart, texts, threshold))

    of = unique.select("lid", "k1", "k2", "n", "at").join(comps.withColumnRenamed("node", "lid"), "lid", "left").withColumn("comp", F.coalesce("component", "lid"))
    heads = of.groupBy("comp").agg(F.min("at").alias("head"), F.sum("n").alias("n_alike"))
    classes = scratch.write(of.select("k1", "k2", "comp").join(heads, "comp").select("k1", "k2", "head", "n_alike"), "classes")
    scratch.keep_only(classes)
    scratch.release()
    return classes


def _judged(docs: DataFrame, classes: DataFrame, *more: Column) -> DataFrame:
    """Every line with its class; blank lines get keys of their own, which match nothing."""
    blank, at = F.col("line") == "", F.struct("doc_id", "line_no")
    k1, k2 = (F.when(blank, F.xxhash64("doc_id", "line_no", F.lit(seed))).otherwise(F.xxhash64("line") if not seed else F.xxhash64("line", F.lit(seed))) for seed in (0, 1))
    keep = [c for c in lines_of(docs, *more).columns if c != "line"]
    every = lines_of(docs, *more).select(*keep, blank.alias("blank"), k1.alias("k1"), k2.alias("k2")).join(classes, ["k1", "k2"], "left")
    head = F.when(F.col("blank") | F.col("head").isNull(), at).otherwise(F.col("head"))
    alike = F.when(F.col("blank"), F.lit(1)).otherwise(F.col("n_alike")).cast("long")
    return every.select(*keep, head.alias("head"), alike.alias("n_alike")).withColumn("kept", at.eqNullSafe(F.col("head")))


def line_components(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per line: ``doc_id, line_no, component_doc, component_line, n_alike, kept``.

    The component is named by its first line; ``n_alike`` counts the lines of the component and ``kept`` marks the first. Empty lines stay, each a
    component of its own. Rows that repeat a doc_id keep their lines apart, but lines that are the first of a component at the same
    place of such rows are all kept; a null doc_id is the smallest. Null texts have one empty line; an empty
    table gives no rows; other columns are ignored; lines of any length are read whole.
    """
    classes = content_classes(spark, Scratch(spark, "lines"), docs, threshold)
    return _judged(docs, classes).select("doc_id", "line_no", F.col("head.doc_id").alias("component_doc"), F.col("head.line_no").alias("component_line"), "n_alike", "kept")


def dedup_lines(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one (see ``line_components``); documents that lose every line that isn't blank go.

    Lines keep their own blanks and order. Documents that lost nothing keep their text as it is; other columns stay as they are,
    whatever their names. Rows are told apart by doc_id and text.
    """
    classes = content_classes(spark, Scratch(spark, "lines"), docs, threshold)
    row, lost, mine = (unused(docs, x) for x in ("row", "lost", "mine"))
    key = F.struct("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"))
    gone = _judged(docs, classes, key.alias("row")).where("not kept").groupBy(F.col("row").alias(row)).agg(F.collect_set("line_no").alias(lost))
    # a text is split once; a long one has many lines to look up
    cut = F.expr(f"transform(array(split(text, '\n')), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), `{lost}`), i -> ls[i]), '\n'))[0]")
    whole = F.col(lost).isNull()
    out = docs.withColumn(mine, key).join(gone, F.col(mine).eqNullSafe(F.col(row)), "left").withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    return out.where(whole | (F.btrim("text", F.lit(" \t\r\n")) != "")).select(*docs.columns)
