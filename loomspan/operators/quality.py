"""Review flags, confusion counts, threshold sweeps, leave-one-group-out choice, error rates and word labels."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T

SEGMENT = ["rec_id", "seg_no"]


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0."""
    return F.when(b > 0, a / b)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """Harmonic mean of precision and recall; 0 where there is nothing to average."""
    return F.when(tp > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))


def confusion(flag: str, truth: str) -> list[Column]:
    """tp, fp, fn, tn as aggregates over boolean columns."""
    f, t = F.col(flag), F.col(truth)
    return [F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & t).alias("fn"), F.count_if(~f & ~t).alias("tn")]


def metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"), (tp + fp).alias("flagged"), (tp + fn).alias("truth"))


def sentence_flags(words: DataFrame, threshold: float) -> DataFrame:
    """Per segment: any word below the threshold, any word labelled wrong. All words with a probability count."""
    return words.groupBy(*SEGMENT).agg(F.coalesce(F.bool_or(F.col("probability") < threshold), F.lit(False)).alias("flagged"), F.coalesce(F.bool_or(~F.col("correct")), F.lit(False)).alias("has_error"))


def least_sure_word(words: DataFrame, threshold: float) -> DataFrame:
    """Per flagged segment its first least probable word."""
    low = words.where(F.col("probability") < threshold)
    return low.groupBy(*SEGMENT).agg(F.min(F.struct("probability", "word_no", "word")).alias("m"), F.count("*").alias("n_low")).select(*SEGMENT, "m.probability", "m.word_no", "m.word", "n_low")


def steps(spark: SparkSession, first: int, last: int, step: int) -> DataFrame:
    """Thresholds in hundredths, as doubles; few by construction."""
    return spark.range(first, last + 1, step).select((F.col("id") / 100.0).alias("t"))


def _segments_of(words: DataFrame, group: list[str]) -> DataFrame:
    """Words that take part, collapsed to what a sweep needs of a segment: its least probability and whether a word is wrong."""
    return words.where("correct is not null").groupBy(*group, *[c for c in SEGMENT if c not in group]).agg(F.min("probability").alias("p"), F.bool_or(~F.col("correct")).alias("bad"))


def sweep(words: DataFrame, thresholds: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Word and segment confusion counts for each threshold (and group). Thresholds are a bounded, broadcast list.

    Probabilities are histogrammed between thresholds first: what meets the thresholds has a row for each group, threshold and truth, not one for each word.
    """
    group = group or []
    used = words.where("correct is not null").select(*group, F.col("probability").alias("p"), (~F.col("correct")).alias("bad"), F.lit("w").alias("level"))
    both = used.unionByName(_segments_of(words, group).select(*group, "p", "bad", F.lit("s").alias("level")))
    grid = F.broadcast(thresholds.agg(F.array_sort(F.collect_list("t")).alias("grid")))
    # index of the first threshold above p: flagged from there on
    slot = F.size(F.filter("grid", lambda t: t <= F.col("p")))
    hist = both.crossJoin(grid).groupBy(*group, "level", slot.alias("slot"), "bad").agg(F.count("*").alias("n"))
    numbered = F.broadcast(thresholds.crossJoin(grid).select("t", (F.array_position("grid", F.col("t")) - 1).alias("at")))
    flagged = F.col("slot") <= F.col("at")

    def count(level: str, flag: Column, bad: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when((F.col("level") == level) & flag & bad, F.col("n"))), F.lit(0)).alias(name)

    bad = F.col("bad")
    return hist.crossJoin(numbered).groupBy(*group, "t").agg(*(count(lv, fl, b, f"{lv}{n}") for lv in "ws" for n, fl, b in (("tp", flagged, bad), ("fp", flagged, ~bad), ("fn", ~flagged, bad))))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The threshold with the best segment F1, then word F1, then the smallest."""
    s, w = (f1(F.col(f"{x}tp"), F.col(f"{x}fp"), F.col(f"{x}fn")) for x in "sw")
    return swept.select("*", s.alias("sf1"), w.alias("wf1")).orderBy(F.desc("sf1"), F.desc("wf1"), "t").limit(1)


def leave_one_out(words: DataFrame, thresholds: DataFrame, group: str) -> DataFrame:
    """For each group the threshold that is best on all others, and its counts on the group itself.

    Counts add up, so the others' are the total less the group's own: no group meets another.
    """
    own = sweep(words, thresholds, [group]).select(group, "t", "stp", "sfp", "sfn")
    # as many rows as thresholds
    every = own.groupBy("t").agg(*(F.sum(c).alias(f"a{c}") for c in ("stp", "sfp", "sfn")))
    rest = own.join(F.broadcast(every), "t").select(*own.columns, *((F.col(f"a{c}") - F.col(c)).alias(f"r{c}") for c in ("stp", "sfp", "sfn")))
    order = Window.partitionBy(group).orderBy(F.desc(f1(F.col("rstp"), F.col("rsfp"), F.col("rsfn"))), "t")
    return rest.withColumn("r", F.row_number().over(order)).where("r = 1").select(group, "t", F.col("stp").alias("tp"), F.col("sfp").alias("fp"), F.col("sfn").alias("fn"))


def lower_quantiles(df: DataFrame, by: list[str], value: str, quantiles: Iterable[float], parts: int = 64) -> DataFrame:
    """Value at index floor(q * (n - 1)) of the sorted values of each group.

    Values are counted first, in a pre-aggregated shuffle. Their range is cut into ``parts`` at approximate quantiles (the same cuts for all groups, so they only move
    work); counts add up within a part, and the parts' totals, a short list for each group, lift them to the ranks of the whole.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    cuts = F.broadcast(counted.agg(F.coalesce(F.array_distinct(F.percentile_approx("v", [k / parts for k in range(1, parts)])), F.array()).alias("cuts")))
    placed = counted.crossJoin(cuts).withColumn("part", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")
    inside = Window.partitionBy(*by, "part").orderBy("v")
    within = placed.withColumn("upto", F.sum("c").over(inside))
    earlier = Window.partitionBy(*by).orderBy("part")
    totals = placed.groupBy(*by, "part").agg(F.sum("c").alias("t"))
    totals = totals.select(*by, "part", F.coalesce(F.sum("t").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("t").over(Window.partitionBy(*by)).alias("n"))
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by] + [F.col("x.part") == F.col("y.part")]
    ranked = within.alias("x").join(totals.alias("y"), on).select(*(F.col(f"x.{c}").alias(c) for c in by), "v", (F.col("upto") + F.col("base")).alias("last"), (F.col("upto") + F.col("base") - F.col("c")).alias("first"), "n")
    at = lambda q: F.floor(F.lit(q) * (F.col("n") - 1))
    return ranked.groupBy(*by).agg(*(F.max(F.when((F.col("first") <= at(q)) & (at(q) < F.col("last")), F.col("v"))).alias(f"q{round(q * 100)}") for q in quantiles))


def review_workload(flags: DataFrame) -> DataFrame:
    """What a reviewer gets: flagged and wrong, false alarms, missed, clean."""
    return flags.agg(*confusion("flagged", "has_error")).selectExpr("tp as caught", "fp as false_alarm", "fn as missed", "tn as clean", "tp + fp as to_review", "tp + fp + fn + tn as total")


def error_rates(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Distance and character error rate; ``s, d, i`` sum to the distance."""
    distance = F.levenshtein(ref, hyp).cast("long")
    counts = T.edit_counts(F.col(ref), F.col(hyp))
    return pairs.withColumns({"distance": distance, "ops": counts}).select("*", *(F.get("ops", k).alias(n) for k, n in enumerate("sdi")), T.character_error_rate(F.col("distance"), F.length(ref)).alias("cer")).drop("ops")


def corpus_word_error_rate(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """100 * edits / reference words, over all pairs together."""
    n = F.size(F.split(F.trim(F.regexp_replace(ref, r"\s+", " ")), " "))
    words = F.when(F.trim(ref) == "", 0).otherwise(n)
    return pairs.agg((100.0 * F.sum(T.word_distance(F.col(ref), F.col(hyp))) / F.sum(words)).alias("wer"))


LABELS = "rec_id long, seg_no long, word_no long, has_ref boolean, correct boolean"


def label_words(words: DataFrame, references: DataFrame) -> DataFrame:
    """Labels each word of a recording by the alignment of its text with the reference (``rec_id, reference``).

    A word is correct if all of its characters match; one without characters takes no part. A missing character counts
    against the word that follows, at the end against the last. One task aligns one recording.
    """

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rec, reference, said = (batch.column(c)[k].as_py() for c in ("rec_id", "reference", "said"))
                chars = [(c, n) for n, w in enumerate(said) for c in w["word"] or ""]
                marks: list[list[bool]] = [[] for _ in said]
                at = 0
                for tag, *_ in T.edit_ops(reference or "", [c for c, _ in chars])[1]:
                    if not chars:
                        break
                    marks[chars[min(at, len(chars) - 1)][1]].append(tag == T.OK)
                    at += tag != T.DEL
                columns = [[rec] * len(said), [w["seg_no"] for w in said], [w["word_no"] for w in said], [bool(m) for m in marks], [all(m) if m else None for m in marks]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.bool_()] * 2, strict=True)], names=["rec_id", "seg_no", "word_no", "has_ref", "correct"])

    # a reference meets its recording as one row, not each of its words; words without a place come last
    place = [x for c in ("seg_no", "word_no") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c).cast("long").alias(c))]
    said = words.select("rec_id", F.struct(*place, T.flatten(F.col("word")).alias("word")).alias("w")).groupBy("rec_id").agg(F.sort_array(F.collect_list("w")).alias("said"))
    joined = said.join(references.select("rec_id", T.flatten(F.col("reference")).alias("reference")), "rec_id")
    return joined.select("rec_id", "reference", "said").mapInArrow(labelled, LABELS)


def attach_labels(words: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join of character labels (``ok`` per character) on their word; a word without any stays unlabelled."""
    per = labels.groupBy(*SEGMENT, "word_no").agg(F.bool_and("ok").alias("correct"))
    return words.join(per, [*SEGMENT, "word_no"], "left").withColumn("has_ref", F.col("correct").isNotNull())


def false_alarms_and_misses(flags: DataFrame, words: DataFrame) -> DataFrame:
    """Segments judged wrongly, with their least probability (1 where no word takes part)."""
    least = words.where("correct is not null").groupBy(*SEGMENT).agg(F.min("probability").alias("p"))
    wrong = flags.where("flagged <> has_error").join(least, SEGMENT, "left")
    return wrong.select(*SEGMENT, F.when(F.col("flagged"), "false alarm").otherwise("missed").alias("kind"), F.coalesce("p", F.lit(1.0)).alias("p"))
