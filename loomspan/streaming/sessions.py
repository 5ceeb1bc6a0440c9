"""Streams of events: sessions by gap, windows, and running a query to the end of its input.

Late data: events behind the watermark are dropped. That is an addition of this library; recordings that are read whole have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

WATERMARK = "1 hour"


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK, by: str = "user_id", ts: str = "ts") -> DataFrame:
    """Runs of events no further apart than ``gap``: start, end, count, sum of values."""
    return (
        events.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), by)
        .agg(F.count("*").alias("n"), F.bround(F.sum("value"), 4).alias("total")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
    )


def tumbling(events: DataFrame, length: str = "1 hour", watermark: str = WATERMARK, ts: str = "ts", hop: str | None = None) -> DataFrame:
    """Counts by window and kind; with ``hop`` windows overlap."""
    w = F.window(ts, length, hop) if hop else F.window(ts, length)
    return events.withWatermark(ts, watermark).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_once(stream: DataFrame, folder: str, mode: str = "append", **settings: str) -> DataFrame:
    """Runs a query over all that is there now and returns the table that its batches wrote below ``folder``, which also holds its checkpoint.

    Tasks write; nothing passes through the driver. In ``complete`` mode the last batch holds the result, else all batches together. A batch
    that is repeated after a failure overwrites itself. ``settings`` (``__`` for dots) hold while the query runs.
    """
    spark = stream.sparkSession
    results = f"{folder}/results"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{results}/batch={number}")

    before = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k.replace("__", "."), v)
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    where = spark._jvm.org.apache.hadoop.fs.Path(results)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], stream.schema)
    wrote = spark.read.schema(stream.schema.add("batch", "long")).parquet(results)
    if mode == "complete":
        wrote = wrote.where(F.col("batch") == wrote.agg(F.max("batch")).first()[0])
    return wrote.drop("batch")
