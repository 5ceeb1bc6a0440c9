"""Queries on review flags, sweeps, error rates and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions.time import real_time_factor
from ..operators import quality as Q
from ..sources import relations as R
from .registry import query

_F1 = "CASE WHEN {p}tp > 0 THEN 2.0::DOUBLE * {p}tp / (2 * {p}tp + {p}fp + {p}fn) ELSE 0 END"
_FLAGS = "SELECT rec_id, seg_no, coalesce(bool_or(probability < 0.7), false) AS flagged, coalesce(bool_or(NOT correct), false) AS has_error FROM words GROUP BY ALL"
_COUNTS = "count(*) FILTER (flagged AND has_error) AS tp, count(*) FILTER (flagged AND NOT has_error) AS fp, count(*) FILTER (NOT flagged AND has_error) AS fn, count(*) FILTER (NOT flagged AND NOT has_error) AS tn"
_T = "SELECT (x / 100.0::DOUBLE) AS t FROM range(10, 99, 2) r(x)"
_SWEEP = f"""SELECT {{g}} t, count(*) FILTER (l = 'w' AND p < t AND bad) AS wtp, count(*) FILTER (l = 'w' AND p < t AND NOT bad) AS wfp, count(*) FILTER (l = 'w' AND p >= t AND bad) AS wfn,
    count(*) FILTER (l = 's' AND p < t AND bad) AS stp, count(*) FILTER (l = 's' AND p < t AND NOT bad) AS sfp, count(*) FILTER (l = 's' AND p >= t AND bad) AS sfn
    FROM (SELECT {{g}} 'w' AS l, probability AS p, NOT correct AS bad FROM words WHERE correct IS NOT NULL
      UNION ALL SELECT {{g}} 's', min(probability), bool_or(NOT correct) FROM words WHERE correct IS NOT NULL GROUP BY {{g}} rec_id, seg_no), ({_T}) GROUP BY {{g}} t"""


def _steps(spark: SparkSession) -> DataFrame:
    return Q.steps(spark, 10, 98, 2)


@query("A1_confusion", R.oracle(f"SELECT tp, fp, fn, tn, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round({_F1.format(p='')}, 6) AS f1 FROM (SELECT {_COUNTS} FROM ({_FLAGS}))", "words"))
def a1(spark, d):
    m = Q.metrics(Q.sentence_flags(R.words(spark, d), 0.7).agg(*Q.confusion("flagged", "has_error")))
    return m.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("A2_sentence_flags", R.oracle(_FLAGS, "words"))
def a2(spark, d):
    return Q.sentence_flags(R.words(spark, d), 0.7)


@query("P9_least_sure_word", R.oracle("SELECT rec_id, seg_no, probability, word_no, word, n_low FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_no ORDER BY probability, word_no) AS r, count(*) OVER (PARTITION BY rec_id, seg_no) AS n_low FROM words WHERE probability < 0.3) WHERE r = 1", "words"))
def p9(spark, d):
    return Q.least_sure_word(R.words(spark, d), 0.3)


@query("A3_sweep", R.oracle(_SWEEP.format(g=""), "words"))
def a3(spark, d):
    return Q.sweep(R.words(spark, d), _steps(spark))


@query("J4_threshold_cross", R.oracle(f"SELECT t, count(*) FILTER (probability < t) AS below FROM words, ({_T}) GROUP BY t", "words"))
def j4(spark, d):
    s = Q.sweep(R.words(spark, d).withColumn("correct", F.lit(True)), _steps(spark))
    return s.select("t", F.col("wfp").alias("below"))


@query("A5_best_threshold", R.oracle(f"SELECT *, round({_F1.format(p='s')}, 9) AS sf1, round({_F1.format(p='w')}, 9) AS wf1 FROM ({_SWEEP.format(g='')}) ORDER BY sf1 DESC, wf1 DESC, t LIMIT 1", "words"))
def a5(spark, d):
    b = Q.best_threshold(Q.sweep(R.words(spark, d), _steps(spark)))
    return b.withColumn("sf1", F.round("sf1", 9)).withColumn("wf1", F.round("wf1", 9))


_LOO = f"""SELECT role, t, stp AS tp, sfp AS fp, sfn AS fn FROM (SELECT g.role, o.t, o.stp, o.sfp, o.sfn, row_number() OVER (PARTITION BY g.role ORDER BY {_F1.format(p='g.')} DESC, o.t) AS r
    FROM (SELECT a.role, b.t, sum(b.stp) AS tp, sum(b.sfp) AS fp, sum(b.sfn) AS fn FROM (SELECT DISTINCT role FROM swept) a JOIN swept b ON a.role <> b.role GROUP BY ALL) g JOIN swept o ON o.role = g.role AND o.t = g.t) WHERE r = 1"""
_GROUPED = f"WITH words0 AS ({R.ORACLE['words']}), words AS (SELECT *, rec_id % 20 AS role FROM words0), swept AS ({_SWEEP.format(g='role,')}) "


def _grouped(spark, d):
    return Q.leave_one_out(R.words(spark, d).withColumn("role", F.col("rec_id") % 20), _steps(spark), "role")


@query("A4_leave_one_out", _GROUPED + _LOO)
def a4(spark, d):
    return _grouped(spark, d)


@query("J5_pooled_held_out", _GROUPED + f"SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ({_LOO})")
def j5(spark, d):
    return _grouped(spark, d).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


@query("A10_lower_quantiles", R.oracle("SELECT correct, " + ", ".join(f"list_sort(list(probability))[floor({q} * (count(*) - 1))::INT + 1] AS q{round(q * 100)}" for q in (0.0, 0.25, 0.5, 0.75, 1.0)) + " FROM words WHERE correct IS NOT NULL GROUP BY correct", "words"))
def a10(spark, d):
    return Q.lower_quantiles(R.words(spark, d).where("correct is not null"), ["correct"], "probability", (0.0, 0.25, 0.5, 0.75, 1.0))


@query("A21_review_workload", R.oracle(f"SELECT tp AS caught, fp AS false_alarm, fn AS missed, tn AS clean, tp + fp AS to_review, tp + fp + fn + tn AS total FROM (SELECT {_COUNTS} FROM ({_FLAGS}))", "words"))
def a21(spark, d):
    return Q.review_workload(Q.sentence_flags(R.words(spark, d), 0.7))


@query("L1_false_alarms_and_misses", R.oracle(f"SELECT rec_id, seg_no, CASE WHEN flagged THEN 'false alarm' ELSE 'missed' END AS kind, coalesce(p, 1.0::DOUBLE) AS p FROM ({_FLAGS}) LEFT JOIN (SELECT rec_id, seg_no, min(probability) AS p FROM words WHERE correct IS NOT NULL GROUP BY ALL) USING (rec_id, seg_no) WHERE flagged <> has_error", "words"))
def l1(spark, d):
    w = R.words(spark, d)
    return Q.false_alarms_and_misses(Q.sentence_flags(w, 0.7), w)


@query("J3_words_and_labels", R.oracle("""SELECT w.rec_id, w.seg_no, w.word_no, l.correct, l.correct IS NOT NULL AS has_ref FROM words w LEFT JOIN
    (SELECT rec_id, seg_no, word_no, bool_and((rec_id + word_no * 5 + i) % 11 > 0) AS correct FROM (SELECT *, unnest(range(length(word) % 3)) AS i FROM words) GROUP BY ALL) l USING (rec_id, seg_no, word_no)""", "words"))
def j3(spark, d):
    w = R.words(spark, d).select("rec_id", "seg_no", "word_no", "word")
    n = F.length("word") % 3
    labels = w.where(n > 0).select("rec_id", "seg_no", "word_no", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).withColumn("ok", F.expr("(rec_id + word_no * 5 + i) % 11 > 0"))
    return Q.attach_labels(w, labels).select("rec_id", "seg_no", "word_no", "correct", "has_ref")


# --- text -------------------------------------------------------------------------------------

_PAIRS = "SELECT p_partkey AS id, p_name AS ref, p_type || ' ' || p_brand AS hyp FROM part"


def _pairs(spark, d):
    return R.table(spark, d, "part").selectExpr("p_partkey as id", "p_name as ref", "concat(p_type, ' ', p_brand) as hyp")


@query("A6_character_error_rate", f"SELECT id, levenshtein(ref, hyp) AS distance, round(levenshtein(ref, hyp)::DOUBLE / greatest(length(ref), 1), 6) AS cer FROM ({_PAIRS})")
def a6(spark, d):
    e = Q.error_rates(_pairs(spark, d))
    return e.select("id", "distance", F.round("cer", 6).alias("cer"))


@query("X5_edit_distance", f"SELECT id, levenshtein(ref, hyp) AS distance FROM ({_PAIRS})")
def x5(spark, d):
    return _pairs(spark, d).select("id", F.levenshtein("ref", "hyp").cast("long").alias("distance"))


_EDITS = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT id, ref, hyp FROM ({_PAIRS})),
    r AS (SELECT id, ref, hyp, 0::BIGINT AS k, list_transform(range(length(hyp) + 1), lambda j: {{'c': j, 's': 0::BIGINT, 'd': 0::BIGINT, 'i': j, 'o': list_reduce(list_prepend('', list_transform(range(1, j + 1), lambda q: '|ins::' || hyp[q])), lambda x, y: x || y)}}) AS up FROM p
      UNION ALL SELECT id, ref, hyp, k + 1, list_reduce(list_prepend([{{'c': up[1].c + 1, 's': up[1].s, 'd': up[1].d + 1, 'i': up[1].i, 'o': up[1].o || '|del:' || ref[k + 1] || ':'}}], list_transform(range(1, length(hyp) + 1), lambda j: [{{'c': j, 's': 0::BIGINT, 'd': 0::BIGINT, 'i': 0::BIGINT, 'o': ''}}])), lambda done, cell: list_append(done,
          CASE WHEN up[cell[1].c].c + CASE WHEN ref[k + 1] = hyp[cell[1].c] THEN 0 ELSE 1 END <= least(up[cell[1].c + 1].c, done[-1].c) + 1 THEN
            {{'c': up[cell[1].c].c + CASE WHEN ref[k + 1] = hyp[cell[1].c] THEN 0 ELSE 1 END, 's': up[cell[1].c].s + CASE WHEN ref[k + 1] = hyp[cell[1].c] THEN 0 ELSE 1 END, 'd': up[cell[1].c].d, 'i': up[cell[1].c].i, 'o': up[cell[1].c].o || CASE WHEN ref[k + 1] = hyp[cell[1].c] THEN '|ok:' ELSE '|sub:' END || ref[k + 1] || ':' || hyp[cell[1].c]}}
          WHEN up[cell[1].c + 1].c <= done[-1].c THEN {{'c': up[cell[1].c + 1].c + 1, 's': up[cell[1].c + 1].s, 'd': up[cell[1].c + 1].d + 1, 'i': up[cell[1].c + 1].i, 'o': up[cell[1].c + 1].o || '|del:' || ref[k + 1] || ':'}}
          ELSE {{'c': done[-1].c + 1, 's': done[-1].s, 'd': done[-1].d, 'i': done[-1].i + 1, 'o': done[-1].o || '|ins::' || hyp[cell[1].c]}} END)) FROM r WHERE k < length(ref))
    SELECT id, up[-1] AS x FROM r WHERE k = length(ref)"""


@query("X6_edit_counts", f"SELECT id, x.s AS s, x.d AS d, x.i AS i, x.c AS distance FROM ({_EDITS})")
def x6(spark, d):
    return Q.error_rates(_pairs(spark, d)).select("id", "s", "d", "i", "distance")


@query("F10_alignment", f"SELECT id, x.o AS ops FROM ({_EDITS})")
def f10(spark, d):
    step = lambda o: F.concat(F.lit("|"), o["tag"], F.lit(":"), F.coalesce(o["ref"], F.lit("")), F.lit(":"), F.coalesce(o["hyp"], F.lit("")))
    return _pairs(spark, d).select("id", F.array_join(F.transform(T.alignment("ref", "hyp"), step), "").alias("ops"))


@query("A7_word_error_rate")
def a7(spark, d):
    return Q.corpus_word_error_rate(_pairs(spark, d))


@query("A8_real_time_factor", R.oracle("SELECT name, model, round(speed / greatest(sec, 1e-6), 6) AS rtf FROM report_rows", "report_rows"))
def a8(spark, d):
    return R.report_rows(spark, d).select("name", "model", F.round(real_time_factor(F.col("speed"), F.col("sec")), 6).alias("rtf"))


@query("F11_word_labels")
def f11(spark, d):
    w = R.words(spark, d)
    refs = w.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "word_no", F.when(F.expr("(rec_id + word_no) % 9 > 0"), F.col("word")).otherwise(F.lit("x")).alias("w")))), lambda x: x["w"]), " ").alias("reference"))
    return Q.label_words(w, refs)


@query("X1_normalised", "SELECT p_partkey, lower(regexp_replace(p_name || ', ' || p_type || '! (' || p_brand || ')', '[\\s,.!?;:()\\[\\]<>~_/\\\\|\"''-]+', '', 'g')) AS t FROM part")
def x1(spark, d):
    t = F.concat("p_name", F.lit(", "), "p_type", F.lit("! ("), "p_brand", F.lit(")"))
    return R.table(spark, d, "part").select("p_partkey", T.normalised(t).alias("t"))


_IGNORED = "[\\s\\x1c-\\x1f\\x{85}\\x{a0}，。、；：？！“”‘’（）《》〈〉【】「」,.!?;:\\()\\[\\]<>~—…·_/\\\\|\"''-]+"  # white space and marks, for DuckDB


@query("X1_normalise_all_forms", f"SELECT conv_id, turn, lower(regexp_replace(nfc_normalize(text), '{_IGNORED}', '', 'g')) AS t FROM conversations")
def x1u(spark, d):
    return R.table(spark, d, "conversations").select("conv_id", "turn", T.normalise("text").alias("t"))


# Fullwidth forms of the small letters.
_WIDE = "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"


@query("X1_compatibility_forms", "SELECT p_partkey, replace(lower(p_name), ' ', '') || 'éfi1カ가ᄀ' || lower(replace(p_type, ' ', '')) AS t FROM part")
def x1c(spark, d):
    """Names in fullwidth letters, an accent that stands alone, a ligature, a number in a circle, a halfwidth letter, jamo."""
    wide = F.translate(F.lower("p_name"), "abcdefghijklmnopqrstuvwxyz", _WIDE)
    odd = F.lit("e\u0301\ufb01\u2460\uff76\u1100\u1161\u3131")
    return R.table(spark, d, "part").select("p_partkey", T.normalise(F.concat(wide, odd, "p_type")).alias("t"))


_CN = "list_reduce(list_prepend('', string_split(lpad(k::VARCHAR, 4, '0'), '')), lambda a, x: a)"


def _numerals(spark, d):
    digits = F.array(*(F.lit(x) for x in T.DIGITS))
    k = F.col("n")
    part = lambda p, u: F.when(F.floor(k / p) % 10 > 0, F.concat(F.element_at(digits, (F.floor(k / p) % 10 + 1).cast("int")), F.lit(u))).otherwise(F.lit(""))
    return R.table(spark, d, "part").select((F.col("p_partkey") % 10000).alias("n")).select("n", F.concat(part(1000, "千"), part(100, "百"), part(10, "十"), part(1, "")).alias("s"))


@query("X2_numeral_value", "SELECT p_partkey % 10000 AS n, (p_partkey % 10000)::VARCHAR AS value FROM part WHERE p_partkey % 10000 > 0")
def x2(spark, d):
    return _numerals(spark, d).where("n > 0").select("n", T.numeral_value(F.col("s")).alias("value"))


@query("X3_numbers_in_digits", "SELECT p_partkey % 10000 AS n, '第' || (p_partkey % 10000)::VARCHAR || '天' AS t FROM part WHERE p_partkey % 10000 > 0")
def x3(spark, d):
    return _numerals(spark, d).where("n > 0").select("n", T.normalise_numbers(F.concat(F.lit("第"), "s", F.lit("天"))).alias("t"))


@query("X4_flatten_numerals", "SELECT n, '占' || n::VARCHAR || '%共' || n::VARCHAR || '个x' AS t FROM (SELECT p_partkey % 10000 AS n FROM part) WHERE n > 0")
def x4n(spark, d):
    return _numerals(spark, d).where("n > 0").select("n", T.flatten(F.concat(F.lit("占 百分之"), "s", F.lit("，共"), "s", F.lit("个！百分之Ｘ"))).alias("t"))


@query("X4_flatten", f"SELECT conv_id, turn, lower(regexp_replace(nfc_normalize(text), '{_IGNORED}', '', 'g')) AS t FROM conversations")
def x4(spark, d):
    return R.table(spark, d, "conversations").select("conv_id", "turn", T.flatten("text").alias("t"))


@query("X7_compression_ratio")
def x7(spark, d):
    return R.table(spark, d, "documents").select("doc_id", T.compression_ratio(F.coalesce("text", F.lit(""))).alias("ratio"))


@query("X11_metric_text", R.oracle(f"SELECT rec_id, CASE WHEN tp + fp > 0 THEN printf('%.2f', tp::DOUBLE / (tp + fp)) ELSE '-' END AS precision, CASE WHEN tp + fn > 0 THEN printf('%.2f', tp::DOUBLE / (tp + fn)) ELSE '-' END AS recall FROM (SELECT rec_id, {_COUNTS} FROM ({_FLAGS}) GROUP BY rec_id)", "words"))
def x11(spark, d):
    m = Q.metrics(Q.sentence_flags(R.words(spark, d), 0.7).groupBy("rec_id").agg(*Q.confusion("flagged", "has_error")))
    return m.select("rec_id", T.ratio_text(F.col("precision"), F.col("flagged")).alias("precision"), T.ratio_text(F.col("recall"), F.col("truth")).alias("recall"))


@query("X14_without_stars", "SELECT page_id, trim(replace('  ' || url || '** ', '*', '')) AS t FROM pages")
def x14(spark, d):
    return R.table(spark, d, "pages").select("page_id", T.without_stars(F.concat(F.lit("  "), "url", F.lit("** "))).alias("t"))


@query("X15_language_of_token", "SELECT doc_id, lang FROM documents")
def x15(spark, d):
    return R.table(spark, d, "documents").select("doc_id", T.language_of_token(F.concat(F.lit("<|"), "lang", F.lit("|>"))).alias("lang"))
