"""The review queue: per source of documents, how well a score finds what a reviewer would flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import quality as Q
from ..sources import relations as R
from .registry import query

_SQL = """SELECT source, count(*) AS n, count(*) FILTER (f AND e) AS tp, count(*) FILTER (f AND NOT e) AS fp, count(*) FILTER (NOT f AND e) AS fn, count(*) FILTER (NOT f AND NOT e) AS tn,
    round(count(*) FILTER (f AND e)::DOUBLE / nullif(count(*) FILTER (f), 0), 6) AS precision, round(count(*) FILTER (f AND e)::DOUBLE / nullif(count(*) FILTER (e), 0), 6) AS recall
    FROM (SELECT source, p < 0.3 AS f, quality = 0 AS e FROM (SELECT doc_id, source, min(((doc_id * 7919 + i * 104729) % 1000) / 1000.0::DOUBLE) AS p FROM (SELECT doc_id, source, unnest(range(len(string_split(text, ' ')))) AS i FROM documents) GROUP BY ALL) JOIN labels USING (doc_id)) GROUP BY source"""


@query("Q0_review_queue", _SQL)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score for each word of a document; the document's is the least of them."""
    docs = R.table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", " ")).alias("i", "w"))
    p = docs.groupBy("doc_id", "source").agg(F.min(F.expr("((doc_id * 7919 + i * 104729) % 1000) / 1000.0D")).alias("p"))
    flags = p.join(R.table(spark, sf_dir, "labels"), "doc_id").selectExpr("source", "p < 0.3 as flagged", "quality = 0 as has_error")
    m = Q.metrics(flags.groupBy("source").agg(F.count("*").alias("n"), *Q.confusion("flagged", "has_error")))
    return m.select("source", "n", "tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
