"""Relations that operators work on, derived from the tables by integer arithmetic that any engine repeats exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations: a turn is a segment. ``correct`` is null where a word takes no part."""
    w = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("seg_no"), F.posexplode(F.split("text", " ")).alias("word_no", "word"))
    h = "(rec_id * 31 + seg_no * 17 + word_no * 7) % 13"
    at = "seg_no * 3000 + word_no * 30"
    return w.selectExpr(
        "rec_id", "seg_no", "cast(word_no as bigint) as word_no", "word", f"({at}) / 100.0D as start", f"({at} + 5 + (rec_id + word_no * 3) % 24) / 100.0D as end",
        "((rec_id * 7919 + seg_no * 104729 + word_no * 1299709) % 1000) / 1000.0D as probability", f"case when {h} = 0 then null else {h} > 2 end as correct",
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id as rec_id", "turn as seg_no", "role", "text", "turn * 30.0D as start", "turn * 30.0D + (conv_id * 3 + turn) % 31 as end",
        "-((conv_id * 13 + turn * 29) % 20) / 10.0D as avg_logprob", "((conv_id * 7 + turn * 11) % 10) / 10.0D as no_speech_prob", "1 + ((conv_id * 5 + turn * 3) % 20) / 10.0D as compression_ratio",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id as rec_id", "cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as frame_no", "least(value / 200, 1.0D) as prob", "event_id")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint speech intervals in samples."""
    return frames(spark, sf_dir).selectExpr("rec_id", "frame_no as k", "frame_no * 48000 + (event_id * 7919) % 16000 as start", "frame_no * 48000 + (event_id * 7919) % 16000 + 4000 + (event_id * 104729) % 24000 as end")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir).selectExpr("rec_id", "cast(row_number() over (partition by rec_id order by seg_no, word_no) - 1 as bigint) as pos", "word")
    return w.selectExpr("rec_id", "pos", "word", "cast(case when (rec_id + pos) % 7 in (0, 1) then 50364 + pos % 1500 else (pos * 31 + rec_id * 17) % 50257 end as bigint) as tok")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "conversations").selectExpr("conv_id as rec_id", "turn as seg_no", "explode(sequence(0, 5)) as attempt")
    return s.selectExpr(
        "rec_id", "seg_no", "cast(attempt as bigint) as attempt", "attempt * 2 / 10.0D as temperature", "-((rec_id * 13 + seg_no * 29 + attempt * 7) % 25) / 10.0D as avg_logprob",
        "1 + ((rec_id * 5 + seg_no * 3 + attempt * 11) % 30) / 10.0D as compression_ratio", "((rec_id * 7 + seg_no * 11 + attempt * 3) % 10) / 10.0D as no_speech_prob",
    )


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows: one report a customer, one row for each of its models."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    best = j.selectExpr("*", "row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as r").where("r = 1")
    return best.selectExpr(
        "concat('2024', lpad(cast(o_custkey as string), 9, '0')) as name", "concat('S', cast(c_nationkey % 5 as string)) as speaker", "c_mktsegment as cond", "concat('A', cast(o_custkey % 7 as string)) as author",
        "o_orderpriority as model", "(o_orderkey % 1000) / 10.0D as cer", "o_orderkey % 7 as sub", "o_orderkey % 3 as dele", "o_orderkey % 5 as ins", "(o_orderkey % 97) / 10.0D as sec", "(o_orderkey % 251) / 10.0D as speed",
    )


#: The same relations in the oracle's dialect, as named subqueries.
ORACLE = {
    "words": """SELECT rec_id, seg_no, word_no, word, (seg_no * 3000 + word_no * 30) / 100.0::DOUBLE AS start, (seg_no * 3000 + word_no * 30 + 5 + (rec_id + word_no * 3) % 24) / 100.0::DOUBLE AS "end",
        ((rec_id * 7919 + seg_no * 104729 + word_no * 1299709) % 1000) / 1000.0::DOUBLE AS probability,
        CASE WHEN (rec_id * 31 + seg_no * 17 + word_no * 7) % 13 = 0 THEN NULL ELSE (rec_id * 31 + seg_no * 17 + word_no * 7) % 13 > 2 END AS correct
        FROM (SELECT conv_id AS rec_id, turn AS seg_no, generate_subscripts(a, 1) - 1 AS word_no, unnest(a) AS word FROM (SELECT conv_id, turn, string_split(text, ' ') AS a FROM conversations))""",
    "segments": """SELECT conv_id AS rec_id, turn AS seg_no, role, text, turn * 30.0::DOUBLE AS start, turn * 30.0::DOUBLE + (conv_id * 3 + turn) % 31 AS "end", -((conv_id * 13 + turn * 29) % 20) / 10.0::DOUBLE AS avg_logprob,
        ((conv_id * 7 + turn * 11) % 10) / 10.0::DOUBLE AS no_speech_prob, 1 + ((conv_id * 5 + turn * 3) % 20) / 10.0::DOUBLE AS compression_ratio FROM conversations""",
    "frames": "SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no, least(value / 200, 1.0::DOUBLE) AS prob, event_id FROM events",
    "intervals": 'SELECT rec_id, frame_no AS k, frame_no * 48000 + (event_id * 7919) % 16000 AS start, frame_no * 48000 + (event_id * 7919) % 16000 + 4000 + (event_id * 104729) % 24000 AS "end" FROM frames',
    "tokens": "SELECT rec_id, pos, word, CASE WHEN (rec_id + pos) % 7 IN (0, 1) THEN 50364 + pos % 1500 ELSE (pos * 31 + rec_id * 17) % 50257 END AS tok FROM (SELECT rec_id, word, row_number() OVER (PARTITION BY rec_id ORDER BY seg_no, word_no) - 1 AS pos FROM words)",
    "attempts": """SELECT rec_id, seg_no, attempt, attempt * 2 / 10.0::DOUBLE AS temperature, -((rec_id * 13 + seg_no * 29 + attempt * 7) % 25) / 10.0::DOUBLE AS avg_logprob, 1 + ((rec_id * 5 + seg_no * 3 + attempt * 11) % 30) / 10.0::DOUBLE AS compression_ratio,
        ((rec_id * 7 + seg_no * 11 + attempt * 3) % 10) / 10.0::DOUBLE AS no_speech_prob FROM (SELECT conv_id AS rec_id, turn AS seg_no, unnest(range(6)) AS attempt FROM conversations)""",
    "report_rows": """SELECT '2024' || lpad(o_custkey::VARCHAR, 9, '0') AS name, 'S' || (c_nationkey % 5)::VARCHAR AS speaker, c_mktsegment AS cond, 'A' || (o_custkey % 7)::VARCHAR AS author, o_orderpriority AS model, (o_orderkey % 1000) / 10.0::DOUBLE AS cer,
        o_orderkey % 7 AS sub, o_orderkey % 3 AS dele, o_orderkey % 5 AS ins, (o_orderkey % 97) / 10.0::DOUBLE AS sec, (o_orderkey % 251) / 10.0::DOUBLE AS speed
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey) WHERE r = 1""",
}
_NEEDS = {"intervals": ["frames"], "tokens": ["words"]}


def oracle(sql: str, *relations: str) -> str:
    """``sql`` with the relations it names in front of it."""
    names: list[str] = []
    for r in relations:
        names += [x for x in [*_NEEDS.get(r, []), r] if x not in names]
    return "WITH " + ", ".join(f"{n} AS ({ORACLE[n]})" for n in names) + " " + sql
