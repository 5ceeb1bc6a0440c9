"""Importance resampling towards a target distribution over hashed word n-grams.

Every document keeps its n-grams in one row: higher-order functions turn its words into an array of bucket numbers, and its weight is an
aggregate over that array of a literal array of gains. What shuffles is one count for each bucket and task, and the ids of drawn documents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch, unused

BUCKETS = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words: all of ASCII but digits and lower-case letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and all that is beyond ASCII, of which A-Z only are lower-cased; none in a null text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def bucket_array(words: Column, longest: int, buckets: int) -> Column:
    """The bucket of each run of 1 to ``longest`` words, repeats included; ``words`` is a column that exists, as it is read for each run."""

    def of(k: int) -> Column:
        return F.transform(F.slice(words, k, F.size(words)), lambda w, i: (F.crc32(F.concat_ws(" ", *(F.get(words, i + j) for j in range(k - 1)), w)) % buckets).cast("int"))

    return F.concat(*(of(k) for k in range(1, longest + 1)))


def bucket_totals(texts: DataFrame, longest: int, buckets: int) -> list[int]:
    """How many n-grams of all texts fall into each bucket; tasks count before they send."""
    runs = texts.select(words(F.col("text")).alias("w")).select(F.explode(bucket_array(F.col("w"), longest, buckets)).alias("bucket"))
    out = [0] * buckets
    for r in runs.groupBy("bucket").agg(F.count("*").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: Sequence[int], target: Sequence[int]) -> list[int]:
    """Thousandths of the log ratio of a bucket's shares in target and source, each with one added to every bucket; floors go down."""
    b = len(source)
    s_all, t_all = float(sum(source) + b), float(sum(target) + b)
    return [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source, target, strict=True)]


def _literal(values: Sequence[int]) -> Column:
    """One array that the optimizer folds to a literal; it travels with the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def scored(docs: DataFrame, gain: Sequence[int], longest: int = 2, seed: int = 7, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, and ``n_words, n_features, weight, score`` of every row; no shuffle and no rows but the documents'.

    The weight is the floored mean gain of a document's n-grams. The score adds Gumbel noise drawn from a digest of seed and doc_id, so that
    the highest scores are a sample without replacement in proportion to the exponential of the weight.
    """
    own = ("n_words", "n_features", "weight", "score", "rank")
    named = [c for c in keep if c.lower() not in (*own, "doc_id")]
    rows = docs.select("doc_id", F.struct(*named).alias("kept") if named else F.lit(None).alias("kept"), words(F.col("text")).alias("w"))
    table = _literal(gain)
    rows = rows.select("doc_id", "kept", F.size("w").cast("long").alias("n_words"), bucket_array(F.col("w"), longest, len(gain)).alias("b"))
    total = F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + F.element_at(table, x + 1))
    rows = rows.select("doc_id", "kept", "n_words", F.size("b").cast("long").alias("n_features"), total.alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return rows.withColumn("weight", weight).select("doc_id", *([F.col("kept")[c].alias(c) for c in named]), "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = BUCKETS, seed: int = 7, keep: Sequence[str] = ()) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text``) with ``n_words, n_features, weight, score, rank``; rank is null where a row isn't drawn.

    Of the N rows with ``least_words`` words, floor(percent * N / 100) of the highest scores are drawn, ties to the smaller doc_id (null: last).
    ``keep`` names columns to carry along; those called as the operator's own are replaced. Null and empty texts have no n-grams and weight 0;
    copies get equal weights and noise of their own; rows that repeat a doc_id and its weight share a score, in any order; an empty table gives
    no rows, an empty target gains from counts of 0. Texts of any length are read whole.

    To the driver come ``buckets`` totals of either table and the counts of distinct scores. A score is a sum of two floored logarithms, so it has
    some 10^5 values whatever the input, and the noise leaves 1 of 2700 copies at one score: ranks within a score are small groups.
    """
    scratch = Scratch(spark, "resample")
    gain = gains(bucket_totals(docs, longest, buckets), bucket_totals(target, longest, buckets))
    rows = scratch.write(scored(docs, gain, longest, seed, keep), "scored")
    fit = F.col("n_words") >= least_words
    counts = sorted(((r.score, r.n) for r in rows.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    quota, before, above = percent * sum(n for _, n in counts) // 100, 0, []
    for score, n in counts:
        if before >= quota:
            break
        above.append((score, before))
        before += n
    if not above:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    offset = unused(rows, "before")
    offsets = spark.createDataFrame(above, f"score long, {offset} long")
    drawn = rows.where(fit & (F.col("score") >= above[-1][0]))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")) + F.col(offset)
    drawn = drawn.join(F.broadcast(offsets), "score").withColumn("rank", F.when(place <= quota, place.cast("long"))).select(*rows.columns, "rank")
    rest = rows.where(~fit | (F.col("score") < above[-1][0])).withColumn("rank", F.lit(None).cast("long"))
    return rest.unionByName(drawn)
