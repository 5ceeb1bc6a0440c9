"""Queries on sources, reports, set operations, sorts and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators import features as X, quality as Q, reports as P
from ..sources import relations as R, scans
from ..sources.published import folders, name_of, publish, read_published
from ..params import VadParams
from ..streaming import sessions as ST
from ..streaming.machine import STORE, speech_stream
from ..tables import shared_folder
from . import oracles
from .registry import query


def _publish(files: DataFrame, kind: str) -> list[str]:
    """Publishes files in a folder of their own in the shared folder; the folders that hold them."""
    base = f"{shared_folder(files.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    publish(files, base)
    return folders(base)


@query("S2_skip_invalid", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (props::JSON ->> 'k')::BIGINT END AS k FROM events WHERE event_id % 7 > 0")
def s2(spark, d):
    broken = F.expr("if(event_id % 7 = 0, substring(props, 1, 4), props)")
    return R.table(spark, d, "events").select("event_id", scans.config(broken, "k long")["k"].alias("k")).where("k is not null")


@query("S8_known_keys", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def s8(spark, d):
    return R.table(spark, d, "events").select("event_id", scans.config(F.col("props"), "k long, unknown string")["k"].alias("k"))


_EXT = "('mp3', 'wav', 'm4a', 'flac', 'ogg', 'aac', 'wma', 'mp4', 'webm')"


@query("S6_collect_files", f"SELECT path FROM (SELECT DISTINCT '/' || (page_id % 9)::VARCHAR || '/' || page_id::VARCHAR || '.' || ['wav', 'MP3', 'txt', 'md'][page_id % 4 + 1] AS path FROM pages) WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN {_EXT}")
def s6(spark, d):
    """Files are written under folders, and those of the given kinds found again."""
    path = F.expr("concat(page_id % 9, '/', page_id, '.', array('wav', 'MP3', 'txt', 'md')[cast(page_id % 4 as int)])")
    where = _publish(R.table(spark, d, "pages").select(path.alias("name"), F.col("url").alias("content")).distinct(), "files")
    return scans.files(spark, [*where, "/nowhere"]).select(F.concat(F.lit("/"), name_of("path")).alias("path"))


@query("S7_stripped_text", "SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE text <> ''")
def s7(spark, d):
    """Each turn is a text file with blanks around it."""
    turns = R.table(spark, d, "conversations").where("text <> ''").select(F.concat("conv_id", F.lit("-"), "turn", F.lit(".txt")).alias("name"), F.concat(F.lit(" \n"), "text", F.lit("\n")).alias("content"))
    n = F.split(F.regexp_extract("name", r"^(.*)\.txt$", 1), "-")
    return scans.texts(spark, _publish(turns, "texts")).select(n[0].cast("long").alias("conv_id"), n[1].cast("long").alias("turn"), "text")


_S1 = "SELECT vec_id AS rec_id, round_even(greatest(least(unnest(embedding)::DOUBLE, 1), -1) * 32767, 0)::BIGINT AS v FROM embeddings"


@query("S1_decode_audio", f"SELECT rec_id, 32000 AS rate, count(*) AS n, sum(v)::BIGINT AS total, max(abs(v)) AS peak FROM ({_S1}) GROUP BY rec_id")
def s1(spark, d):
    """Recordings are written as PCM files and read in byte ranges; two files that are no recordings are passed over."""
    signals = R.table(spark, d, "embeddings").selectExpr("vec_id as rec_id", "embedding as samples")
    broken = R.table(spark, d, "region").where("r_regionkey < 2").selectExpr("concat('x', r_regionkey, '.wav') as name", "encode(r_name, 'UTF-8') as content")
    (base,) = {x.rsplit("/", 1)[0] for x in _publish(scans.recordings(signals, 32_000).unionByName(broken), "recordings")}
    heard = scans.audio(spark, base, blockSamples="24", partitionBytes="1000000")
    rows = heard.select(F.regexp_extract("path", r"/(-?\d+)\.wav$", 1).cast("long").alias("rec_id"), "rate", F.explode("samples").alias("x"))
    v = F.bround(F.col("x") * 32768).cast("long")
    return rows.groupBy("rec_id", "rate").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.max(F.abs(v)).alias("peak"))


#: 64 samples at 3/4 of their rate through 8 lobes: taps reach 32/3 samples, and ends are mirrored.
_S4 = """SELECT rec_id, count(*) AS n, round(sum(y), 6) AS total, round(sum(y * m), 5) AS moment FROM (
    SELECT rec_id, m, sum(w * x[CASE WHEN k < 0 THEN -k WHEN k > 63 THEN 126 - k ELSE k END + 1]) / sum(w) AS y FROM (
      SELECT m, k, CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t) / (pi() * t) END * (0.5 + 0.5 * cos(pi() * t / 8)) AS w FROM (
        SELECT m, k, (m * 4 - k * 3) / 4.0::DOUBLE AS t FROM (SELECT unnest(range(48)) AS m), (SELECT unnest(range(-12, 76)) AS k)) WHERE abs(t) < 8),
    (SELECT vec_id AS rec_id, embedding::DOUBLE[] AS x FROM embeddings) GROUP BY rec_id, m) GROUP BY rec_id"""


@query("S4_resample", _S4)
def s4(spark, d):
    """Blocks of 20 samples at three quarters of their rate."""
    signals = R.table(spark, d, "embeddings").selectExpr("vec_id as rec_id", "cast(embedding as array<double>) as samples")
    y = X.resampled(X.blocks_of(signals, 20), 20, 64, 48, lobes=8).select("rec_id", "first", F.posexplode("samples"))
    return y.groupBy("rec_id").agg(F.count("*").alias("n"), F.round(F.sum("col"), 6).alias("total"), F.round(F.sum(F.col("col") * (F.col("first") + F.col("pos"))), 5).alias("moment"))


@query("S14_lowest_bitrate", "SELECT l_orderkey, stream_id, bitrate FROM (SELECT l_orderkey, stream_id, bitrate, row_number() OVER (PARTITION BY l_orderkey ORDER BY bitrate, stream_id DESC) AS r FROM (SELECT l_orderkey, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS stream_id, l_quantity::BIGINT AS bitrate, l_returnflag AS kind FROM lineitem) WHERE kind IN ('A', 'N')) WHERE r = 1")
def s14(spark, d):
    s = R.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber * 1000000000L + l_partkey * 10000 + l_suppkey as stream_id", "cast(l_quantity as bigint) as bitrate", "l_returnflag as kind")
    return scans.lowest_bitrate(s, ["l_orderkey"], ("A", "N")).select("l_orderkey", "stream_id", "bitrate")


@query("S17_missing_files", "SELECT p_partkey AS name, p_size AS size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) AND NOT (p_partkey % 3 = 0)")
def s17(spark, d):
    part = R.table(spark, d, "part").selectExpr("p_partkey as name", "p_size as size")
    wanted = R.table(spark, d, "lineitem").selectExpr("l_partkey as name").distinct()
    return scans.missing_files(wanted, part, part.where("name % 3 = 0"))


@query("U3_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def u3(spark, d):
    """Customers without an urgent order."""
    urgent = R.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_custkey as k")
    return R.table(spark, d, "customer").selectExpr("c_custkey as k").join(urgent, "k", "left_anti")


@query("S18_models", "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def s18(spark, d):
    return R.table(spark, d, "supplier").join(R.table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"), "left").select("s_suppkey", "s_name", "n_name")


@query("S18_resolve_models", """SELECT c_custkey, name, CASE WHEN contains(name, '/') THEN name ELSE 'hub/' || lower(replace(n_name, ' ', '-')) END AS repo
    FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'own/' || c_name WHEN 1 THEN 'no model' ELSE n_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey) LEFT JOIN nation ON n_name = name""")
def s18r(spark, d):
    nation = R.table(spark, d, "nation")
    asked = R.table(spark, d, "customer").join(nation, F.expr("c_nationkey = n_nationkey")).selectExpr("c_custkey", "case c_custkey % 4 when 0 then concat('own/', c_name) when 1 then 'no model' else n_name end as name")
    return P.resolve_models(asked, nation.selectExpr("n_name as alias", "concat('hub/', lower(replace(n_name, ' ', '-'))) as repo"))


_ASKED = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN round(l_discount * 12, 2) END AS threshold, l_linenumber % 2 = 0 AS has_reference, CASE WHEN l_partkey % 2 = 0 THEN 'cpu' ELSE 'cuda' END AS device,
    CASE WHEN l_suppkey % 3 = 0 THEN 'float16' ELSE 'int8' END AS compute_type, l_partkey % 5 > 0 AS multilingual, CASE WHEN l_suppkey % 4 > 0 THEN 'de' END AS language FROM lineitem"""


@query("P10_P11_run_options", f"""SELECT l_orderkey, l_linenumber, t AS effective_threshold, CASE WHEN multilingual THEN language ELSE 'en' END AS effective_language,
    CASE WHEN t <= 0 OR t >= 1 THEN 'threshold must lie between 0 and 1' WHEN device = 'cpu' AND compute_type = 'float16' THEN 'float16 is not available on cpu' END AS problem
    FROM (SELECT *, CASE WHEN threshold IS NULL AND has_reference THEN 0.70::DOUBLE ELSE threshold END AS t FROM ({_ASKED}))""")
def p10(spark, d):
    return P.run_options(spark.sql(_ASKED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=R.table(spark, d, "lineitem"))).select("l_orderkey", "l_linenumber", "effective_threshold", "effective_language", "problem")


@query("J8_dimension_lookup", "SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j8(spark, d):
    t = lambda n: R.table(spark, d, n)
    return t("customer").join(t("nation"), F.expr("c_nationkey = n_nationkey")).join(t("region"), F.expr("n_regionkey = r_regionkey")).select("c_custkey", "r_name")


@query("P12_prompt_lookup", "SELECT o_orderkey, n_name FROM orders JOIN nation ON o_custkey % 25 = n_nationkey")
def p12(spark, d):
    j = R.table(spark, d, "orders").join(R.table(spark, d, "nation"), F.expr("o_custkey % 25 = n_nationkey"), "left")
    return j.select("o_orderkey", F.coalesce("n_name", F.raise_error(F.lit("no such prompt"))).alias("n_name"))


@query("J2_positional_zip", "SELECT doc_id, list_aggregate(list_transform(list_zip(string_split(source, 'c'), string_split(lang, ''), true), lambda z: z[1] || '-' || z[2]), 'string_agg', ',') AS z FROM documents")
def j2(spark, d):
    pairs = F.filter(F.arrays_zip(F.split("source", "c").alias("a"), F.split("lang", "").alias("b")), lambda z: z["a"].isNotNull() & z["b"].isNotNull())
    return R.table(spark, d, "documents").select("doc_id", F.array_join(F.transform(pairs, lambda z: F.concat_ws("-", z["a"], z["b"])), ",").alias("z"))


# --- reports ----------------------------------------------------------------------------------

_LINE = "'| big-' || CASE o_orderkey % 3 WHEN 0 THEN 'tiny' WHEN 1 THEN 'small' ELSE 'medium' END || ' | ' || printf('%.1f', (o_orderkey % 1000) / 10.0::DOUBLE) || '% | ' || printf('%.1f', (o_orderkey % 777) / 10.0::DOUBLE) || '% | ' || (o_orderkey % 7)::VARCHAR || ' | 2 | 3 | 1.5s | 20.9x |'"


def _report_lines(spark: SparkSession, d: str) -> DataFrame:
    k = "o_orderkey"
    line = f"concat('| big-', case {k} % 3 when 0 then 'tiny' when 1 then 'small' else 'medium' end, ' | ', format_string('%.1f', ({k} % 1000) / 10.0D), '% | ', format_string('%.1f', ({k} % 777) / 10.0D), '% | ', {k} % 7, ' | 2 | 3 | 1.5s | 20.9x |')"
    return R.table(spark, d, "orders").selectExpr("concat('r', o_custkey) as name", "o_orderkey as line_no", f"{line} as line")


@query("S9_parse_reports", "SELECT name, model, cer_raw, cer, sub, 2::BIGINT AS dele, 3::BIGINT AS ins, 1.5::DOUBLE AS sec, 20.9::DOUBLE AS speed FROM (SELECT 'r' || o_custkey::VARCHAR AS name, CASE o_orderkey % 3 WHEN 0 THEN 'tiny' WHEN 1 THEN 'small' ELSE 'medium' END AS model, (o_orderkey % 1000) / 10.0::DOUBLE AS cer_raw, (o_orderkey % 777) / 10.0::DOUBLE AS cer, o_orderkey % 7 AS sub, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def s9(spark, d):
    """Each report is a file; the folder is read and its lines are parsed."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    reports = _report_lines(spark, d).groupBy("name").agg(text.alias("content")).withColumn("name", F.concat("name", F.lit(".md")))
    return P.parse_rows(scans.lines(spark, _publish(reports, "reports"))).withColumn("name", F.regexp_extract("name", r"^(.*)\.md$", 1))


def _sweep_text(spark: SparkSession, d: str) -> DataFrame:
    row = "concat('| **', format_string('%.2f', p_size / 100.0D), '** | ', p_size + 5, ' | ', p_size, ' | 1 | 2 | 0.50 | 0.60 | ', format_string('%.3f', (p_partkey % 1000) / 1000.0D), ' |')"
    p = R.table(spark, d, "part").selectExpr("p_brand", "p_partkey", f"{row} as row")
    return p.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "row"))), lambda x: x["row"]), "\n").alias("text"))


@query("S10_parse_sweep", "SELECT p_brand, p_size / 100.0::DOUBLE AS t, (p_size + 5)::DOUBLE AS flagged, p_size::DOUBLE AS caught, (p_partkey % 1000) / 1000.0::DOUBLE AS f1 FROM part")
def s10(spark, d):
    return _sweep_text(spark, d).select("p_brand", F.inline(P.parse_sweep(F.col("text")))).select("p_brand", "t", "flagged", "caught", "f1")


@query("S11_parse_quantiles", "SELECT c_custkey, (c_custkey % 100) / 100.0::DOUBLE AS low, 0.97::DOUBLE AS median FROM customer")
def s11(spark, d):
    text = F.concat(F.lit("| good (12) | 0.5 | 0.6 | 0.7 | 0.8 |\n| good (3) | "), F.format_string("%.2f", (F.col("c_custkey") % 100) / 100.0), F.lit(" | 0.89 | **0.97** | 1.000 |\n| bad | 0.1 | 0.2 | 0.3 | 0.4 |"))
    m = P.parse_quantiles(text, ("good", "bad"))
    return R.table(spark, d, "customer").select("c_custkey", m["good"]["low"].alias("low"), m["good"]["median"].alias("median"))


@query("S12_parse_workload", "SELECT p_brand, p_size / 100.0::DOUBLE AS threshold, n AS total, n // 2 AS with_error, (p_size + 5)::BIGINT AS flagged, p_size::BIGINT AS caught FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 1000 DESC, p_size, p_partkey) AS r FROM part) WHERE r = 1")
def s12(spark, d):
    n = R.table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    text = F.concat(F.lit("total | "), F.col("n").cast("string"), F.lit(" (of which "), F.floor(F.col("n") / 2).cast("string"), F.lit(" bad)\n"), "text")
    w = P.parse_workload(text, r"total \| (\d+) \(of which (\d+) bad\)")
    return _sweep_text(spark, d).join(n, "p_brand").select("p_brand", w.alias("w")).select("p_brand", "w.*")


@query("P13_classify", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN ['s_a', 's_b'][o_orderkey % 2 + 1] END AS speaker, CASE WHEN o_orderkey % 4 < 3 THEN ['plain', 'quick', 'slow'][o_orderkey % 4 + 1] END AS cond, CASE WHEN o_orderkey % 4 < 3 THEN 'u' || (o_custkey % 5)::VARCHAR END AS author FROM orders")
def p13(spark, d):
    name = F.expr("concat('20240101-101010_', array('s_a', 's_b')[cast(o_orderkey % 2 as int)], array('_none', '_q-fast', '_q-slow', '_odd')[cast(o_orderkey % 4 as int)], '__u', o_custkey % 5, '.md')")
    c = P.classify(name, ["s_a", "s_b"], [("_none", "plain"), ("_q-fast", "quick"), ("_q-slow", "slow")])
    return R.table(spark, d, "orders").select("o_orderkey", c.alias("c")).select("o_orderkey", "c.*")


@query("A16_latest_reports", R.oracle("SELECT speaker, cond, name, model, cer FROM report_rows JOIN (SELECT speaker, cond, name FROM (SELECT speaker, cond, name, row_number() OVER (PARTITION BY speaker, cond ORDER BY n DESC, name DESC) AS r FROM (SELECT speaker, cond, name, count(*) AS n FROM report_rows GROUP BY speaker, cond, name)) WHERE r = 1) USING (speaker, cond, name)", "report_rows"))
def a16(spark, d):
    return P.latest_reports(R.report_rows(spark, d)).select("speaker", "cond", "name", "model", "cer")


@query("A17_stability", R.oracle("SELECT cond, model, round_even(max(cer) - min(cer), 6) AS range, count(*) AS n FROM report_rows GROUP BY ALL", "report_rows"))
def a17(spark, d):
    return P.stability(R.report_rows(spark, d))


_CONDS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("A18_speaker_matrix", R.oracle("SELECT speaker, " + ", ".join(f"max(cer) FILTER (cond = '{c}') AS {c}" for c in _CONDS) + " FROM report_rows WHERE model = '1-URGENT' GROUP BY speaker", "report_rows"))
def a18(spark, d):
    return P.speaker_matrix(R.report_rows(spark, d), "1-URGENT", _CONDS)


@query("A19_error_composition", R.oracle("UNPIVOT (SELECT cond, model, sum(sub)::BIGINT AS sub, sum(dele)::BIGINT AS dele, sum(ins)::BIGINT AS ins FROM report_rows GROUP BY ALL) ON sub, dele, ins INTO NAME kind VALUE n", "report_rows").replace(" UNPIVOT (", " SELECT * FROM (UNPIVOT (", 1) + ")")
def a19(spark, d):
    return P.error_composition(R.report_rows(spark, d))


@query("A20_provenance", R.oracle("SELECT speaker, string_agg(DISTINCT author, ',' ORDER BY author) AS authors, min(name) AS earliest FROM report_rows GROUP BY speaker", "report_rows"))
def a20(spark, d):
    return P.provenance(R.report_rows(spark, d))


@query("A9_totals", R.oracle("SELECT model, speaker, count(*) AS n, sum(sub)::BIGINT AS sub, round_even(sum(sec), 4) AS sec FROM report_rows GROUP BY GROUPING SETS ((model, speaker), (model), ())", "report_rows"))
def a9(spark, d):
    return P.totals(R.report_rows(spark, d))


@query("J6_grid", R.oracle("SELECT s.speaker, c.cond, m.cer FROM (SELECT DISTINCT speaker FROM report_rows) s CROSS JOIN (SELECT DISTINCT cond FROM report_rows) c LEFT JOIN (SELECT speaker, cond, round_even(avg(cer), 6) AS cer FROM report_rows GROUP BY ALL) m ON m.speaker = s.speaker AND m.cond = c.cond", "report_rows"))
def j6(spark, d):
    return P.grid(R.report_rows(spark, d))


@query("J9_prefix_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON starts_with(c_mktsegment || '_NATION_' || c_nationkey::VARCHAR || '_x', c_mktsegment || '_' || n_name || '_')")
def j9(spark, d):
    c, n = R.table(spark, d, "customer"), R.table(spark, d, "nation")
    stem = F.concat("c_mktsegment", F.lit("_NATION_"), F.col("c_nationkey").cast("string"), F.lit("_x"))
    return c.join(F.broadcast(n), stem.startswith(F.concat("c_mktsegment", F.lit("_"), "n_name", F.lit("_")))).select("c_custkey", "n_name")  # 25 rows of fixed size


@query("A23_best_times", "SELECT l_suppkey, min(l_extendedprice) AS fastest, max(l_extendedprice) AS peak FROM lineitem GROUP BY l_suppkey")
def a23(spark, d):
    return R.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("fastest"), F.max("l_extendedprice").alias("peak"))


@query("K1_subtitles", R.oracle("SELECT rec_id, string_agg(n::VARCHAR || chr(10) || a || ' --> ' || b || chr(10) || CASE WHEN seg_no % 3 = 0 THEN '[?] ' ELSE '' END || trim(text) || chr(10), chr(10) ORDER BY n) AS srt FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY seg_no) AS n, " + ", ".join(f"lpad((round_even({c} * 1000, 0)::BIGINT // 3600000)::VARCHAR, 2, '0') || ':' || lpad((round_even({c} * 1000, 0)::BIGINT % 3600000 // 60000)::VARCHAR, 2, '0') || ':' || lpad((round_even({c} * 1000, 0)::BIGINT % 60000 // 1000)::VARCHAR, 2, '0') || ',' || lpad((round_even({c} * 1000, 0)::BIGINT % 1000)::VARCHAR, 3, '0') AS {a}" for c, a in (("start", "a"), ('"end"', "b"))) + " FROM segments) GROUP BY rec_id", "segments"))
def k1(spark, d):
    """A subtitle file for each recording, published and read again."""
    made = P.subtitles(R.segments(spark, d).withColumn("flagged", F.expr("seg_no % 3 = 0")), "[?] ")
    base = f"{shared_folder(spark)}/subtitles-{uuid.uuid4().hex}"
    publish(made.select(F.concat("rec_id", F.lit(".srt")).alias("name"), F.col("srt").alias("content")), base)
    return read_published(spark, base).select(F.regexp_extract("name", r"^(.*)\.srt$", 1).cast("long").alias("rec_id"), F.decode("content", "UTF-8").alias("srt"))


@query("K2_report_lines", R.oracle("SELECT name, model, printf('| %s | %.1f%% | %d | %d | %d | %.1fs | %.1fx |', model, cer, sub, dele, ins, sec, speed) AS line FROM report_rows", "report_rows"))
def k2(spark, d):
    return P.report_lines(R.report_rows(spark, d))


@query("K3_word_records", R.oracle("SELECT rec_id, seg_no, word_no, word, round_even(probability, 6) AS prob, round_even(start, 3) AS start, correct FROM words", "words"))
def k3(spark, d):
    j = P.word_records(R.words(spark, d))
    x = F.from_json("json", "word string, prob double, start double, correct boolean")
    return j.select("rec_id", "seg_no", "word_no", x.alias("x")).select("rec_id", "seg_no", "word_no", "x.*")


@query("K5_chart_data", R.oracle("SELECT model, round_even(avg(cer), 6) AS cer, round_even(avg(speed), 6) AS speed, count(*) AS n FROM report_rows GROUP BY model", "report_rows"))
def k5(spark, d):
    return R.report_rows(spark, d).groupBy("model").agg(F.bround(F.avg("cer"), 6).alias("cer"), F.bround(F.avg("speed"), 6).alias("speed"), F.count("*").alias("n"))


# --- sorts and sets ---------------------------------------------------------------------------


@query("L2_first_errors", R.oracle("SELECT rec_id, seg_no, word_no FROM words WHERE NOT correct ORDER BY rec_id, seg_no, word_no LIMIT 25", "words"))
def l2(spark, d):
    return R.words(spark, d).where("not correct").orderBy("rec_id", "seg_no", "word_no").limit(25).select("rec_id", "seg_no", "word_no")


@query("L3_sorted_probabilities", R.oracle("SELECT rec_id, string_agg(printf('%.3f', probability), ',' ORDER BY probability) AS p FROM words GROUP BY rec_id", "words"))
def l3(spark, d):
    g = R.words(spark, d).groupBy("rec_id").agg(F.sort_array(F.collect_list("probability")).alias("p"))
    return g.select("rec_id", F.array_join(F.transform("p", lambda x: F.format_string("%.3f", x)), ",").alias("p"))


@query("L4_first_and_last_tokens", R.oracle("SELECT rec_id, string_agg(tok::VARCHAR, ',' ORDER BY pos) FILTER (pos < 5) AS head, string_agg(tok::VARCHAR, ',' ORDER BY pos) FILTER (pos > last - 5) AS tail FROM (SELECT *, max(pos) OVER (PARTITION BY rec_id) AS last FROM tokens) GROUP BY rec_id", "tokens"))
def l4(spark, d):
    g = R.tokens(spark, d).groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"].cast("string")).alias("t"))
    return g.select("rec_id", F.array_join(F.slice("t", 1, 5), ",").alias("head"), F.array_join(F.slice("t", F.greatest(F.lit(1), F.size("t") - 4), F.lit(5)), ",").alias("tail"))


@query("L5_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def l5(spark, d):
    return R.table(spark, d, "orders").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("U1_concatenate", "SELECT s_name AS name, 'supplier' AS kind FROM supplier UNION ALL SELECT c_name, 'customer' FROM customer")
def u1(spark, d):
    a = R.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return a.unionByName(R.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("kind")))


@query("U4_distinct_groups", R.oracle("SELECT DISTINCT speaker, cond FROM report_rows", "report_rows"))
def u4(spark, d):
    return R.report_rows(spark, d).select("speaker", "cond").distinct()


@query("U5_intersection", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def u5(spark, d):
    return R.table(spark, d, "customer").selectExpr("c_custkey as k").intersect(R.table(spark, d, "orders").selectExpr("o_custkey as k"))


@query("W9_row_numbers", R.oracle("SELECT rec_id, seg_no, row_number() OVER (PARTITION BY rec_id ORDER BY seg_no) AS n, (row_number() OVER (PARTITION BY rec_id ORDER BY seg_no) - 1) // 8 AS batch FROM segments", "segments"))
def w9(spark, d):
    n = F.row_number().over(Window.partitionBy("rec_id").orderBy("seg_no")).cast("long")
    return R.segments(spark, d).select("rec_id", "seg_no", n.alias("n"), F.floor((n - 1) / 8).alias("batch"))


# --- streams ----------------------------------------------------------------------------------

def _stream(spark: SparkSession, d: str, build, mode: str = "complete", **settings: str) -> DataFrame:
    schema = R.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    return ST.run_once(build(events), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", mode, **settings)


@query("ST1_sessions", """SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts)))::BIGINT + 7200 AS "end", count(*) AS n, round_even(sum(value), 4) AS total FROM (SELECT *, sum(CASE WHEN gap >= 7200 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events)) GROUP BY user_id, s""")
def st1(spark, d):
    s = _stream(spark, d, lambda e: ST.sessions(e, "2 hours"))
    return s.select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n", "total")


@query("ST2_tumbling", "SELECT epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS start, event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY ALL")
def st2(spark, d):
    return _stream(spark, d, ST.tumbling).select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total")


@query("ST3_hopping", "SELECT epoch(time_bucket(INTERVAL 30 minutes, ts))::BIGINT - o * 1800 AS start, event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events, range(2) r(o) GROUP BY ALL")
def st3(spark, d):
    return _stream(spark, d, lambda e: ST.tumbling(e, "1 hour", hop="30 minutes")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total")


_ST4 = VadParams(threshold=0.2, min_silence_duration_ms=600, min_speech_duration_ms=100, speech_pad_ms=120, max_speech_duration_s=8, min_silence_at_max_speech=250)


@query("ST4_speech_stream", oracles.speech("(SELECT user_id % 7 AS rec_id, event_id AS no, least(value / 200, 1.0::DOUBLE) AS prob FROM events)", _ST4, ended=False))
def st4(spark, d):
    """Seven recordings, whose frames are numbered by event; the last interval of each waits for its successor, as no frame ends it."""
    frames = lambda e: e.selectExpr("user_id % 7 as rec_id", "event_id as frame_no", "least(value / 200, 1.0D) as prob")
    return _stream(spark, d, lambda e: speech_stream(frames(e), _ST4), "append", **{STORE[0].replace(".", "__"): STORE[1]})
