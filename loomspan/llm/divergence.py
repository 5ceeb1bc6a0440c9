"""Audit of sources: how far the term shares of a language's sources lie apart, and which terms set a source off from its language.

The divergence of two sources sums over all kept terms of their language, but only terms that both hold are looked at one by one. Over the
supports of two sources, a sum over all terms is: the terms of the one against a zero of the other, from the histogram of its counts; the
same the other way round; a constant for the terms of neither; and for terms of both, found by a join of postings, what corrects the other three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch, text_or_empty

SCALE = 1_000_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between terms: all of ASCII but letters.
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df``: occurrences, and rows that hold the term. A row's terms are sorted and counted as runs before anything is exploded."""
    # in a text of ASCII alone the fast lower-casing does the same
    text = F.when(F.octet_length("text") == F.char_length("text"), F.lower("text")).otherwise(F.translate(text_or_empty(), _UPPER, _LOWER))
    rows = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), F.sort_array(F.split(text, _BETWEEN)).alias("t"))
    firsts = F.filter(F.transform("t", lambda x, i: F.when((i == 0) | (F.get("t", i - 1) != x), i)), lambda i: i.isNotNull())
    rows = rows.select("lang", "source", "t", firsts.alias("at"))
    runs = F.transform("at", lambda b, j: F.struct(F.get("t", b).alias("term"), (F.coalesce(F.get("at", j + 1), F.size("t")) - b).alias("n")))
    return rows.select("lang", "source", F.explode(runs).alias("r")).where("r.term <> ''").groupBy("lang", "source", F.col("r.term").alias("term")).agg(F.sum("r.n").alias("n"), F.count("*").alias("df"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)) in decimals, as the product may pass 64 bits; null where no term is kept."""
    scaled = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(11,0)")
    return F.when(kept > 0, F.call_function("div", scaled, F.greatest(total + kept, F.lit(1)).cast("decimal(20,0)")) + 1)


def _apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def divergence_audit(spark: SparkSession, docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every source of every language, from ``text, lang, source``.

    Part ``pair``: each other source of the language, by its divergence summed over the terms that ``least_docs`` rows of the language hold.
    Part ``term``: terms whose share in the source is above that in the language, the ``top`` first. Ranks run by falling value, then by item.
    Nulls read as ''; a row without terms still makes its group; repeated rows count each; without a kept term pairs have value 0; an empty
    table gives no rows; a lone source has no pairs. All arithmetic is on integers: a sum stays below 5 * 10^18, as shares sum to SCALE.

    Postings meet by (lang, term), at most one row a source and term, so a hot source, language or term is one row among others there. Small tables
    (groups, totals) are read back from the shared folder, so that the planner knows their size and broadcasts them only where they are small.
    """
    scratch = Scratch(spark, "divergence")
    counts = term_counts(docs)
    of_term = Window.partitionBy("lang", "term")
    kept = counts.select("*", F.sum("df").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("lang_n"), (F.row_number().over(of_term.orderBy("source")) == 1).alias("once"))
    kept = scratch.write(kept.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "once"), "postings")
    langs = kept.groupBy("lang").agg(F.sum(F.col("once").cast("long")).alias("kept"), F.sum("n").alias("lang_total"))
    groups = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source")).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "support", "kept", "lang_total"])
    zero = F.lit(0).cast("long")
    groups = scratch.write(groups.withColumn("p0", _share(zero, F.col("total"), F.col("kept"))), "groups", compact=True)

    # what a posting's share is, in its source and in its language
    rows = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "p0", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))

    # terms of one source against the zero of another, by the histogram of the counts of the one
    steps = scratch.write(rows.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")), "histogram", compact=True)
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"))
    mine = groups.select("lang", "source", "p0")
    sided = steps.join(mine, ["lang", "source"]).join(other, "lang").where("source <> item")
    here = sided.selectExpr("lang", "source", "item", f"terms * {_apart('p', 'o0')} as value")
    there = sided.selectExpr("lang", "item as source", "source as item", f"terms * {_apart('o0', 'p')} as value")
    # all terms less those of either, at zero against zero; those of both are counted off twice here
    pairs = groups.alias("a").join(groups.alias("b"), F.expr("a.lang = b.lang and a.source <> b.source"))
    neither = pairs.selectExpr("a.lang", "a.source", "b.source as item", f"coalesce((a.kept - a.support - b.support) * {_apart('a.p0', 'b.p0')}, 0L) as value")
    # terms of both
    left, right = rows.select("lang", "term", "source", "p", "p0"), rows.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("o"), F.col("p0").alias("o0"))
    both = left.join(right, ["lang", "term"]).where("source < item")
    fix = lambda p, p0, o, o0: f"{_apart(p, o)} - {_apart(p, o0)} - {_apart(p0, o)} + {_apart(p0, o0)}"
    both = both.groupBy("lang", "source", "item").agg(F.expr(f"sum({fix('p', 'p0', 'o', 'o0')})").alias("to"), F.expr(f"sum({fix('o', 'o0', 'p', 'p0')})").alias("fro"))
    both = both.selectExpr("lang", "inline(array(named_struct('source', source, 'item', item, 'value', to), named_struct('source', item, 'item', source, 'value', fro)))")
    parts = here.unionByName(there).unionByName(neither).unionByName(both)
    pair = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    term = rows.where("p > q").selectExpr("lang", "source", "term as item", f"{_apart('p', 'q')} as value", "'term' as part")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    out = ranked(pair).unionByName(ranked(term).where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
