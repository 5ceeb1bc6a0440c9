"""Readers: files and folders, text, configuration, manifests, audio."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..params import SAMPLING_RATE
from .pcm import PcmSource

AUDIO = ("mp3", "wav", "m4a", "flac", "ogg", "aac", "wma", "mp4", "webm")


def files(spark: SparkSession, paths: list[str], extensions: tuple[str, ...] = AUDIO) -> DataFrame:
    """Files of the given kinds under files and folders, recursively, by path; paths that don't exist are skipped."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [p for p in paths if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    if not there:
        return spark.createDataFrame([], "path string, length long")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there).select("path", "length")
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)).distinct().orderBy("path")


def texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``name, text`` of whole files, stripped; an empty one is an error when it is read."""
    t = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))
    return t.withColumn("text", F.when(F.col("text") == "", F.raise_error(F.concat(F.lit("empty text: "), F.col("name")))).otherwise(F.col("text")))


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``name, line_no, line`` of text files."""
    t = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    return t.select("name", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def config(json: Column, fields: str) -> Column:
    """Known keys of a configuration; broken JSON gives nulls."""
    return F.from_json(json, fields, {"mode": "PERMISSIVE"})


def missing_files(wanted: DataFrame, remote: DataFrame, local: DataFrame) -> DataFrame:
    """``name, size`` of remote files that are wanted and not here in the same size."""
    return wanted.join(remote, "name").join(local, ["name", "size"], "left_anti")


def lowest_bitrate(streams: DataFrame, by: list[str], kinds: tuple[str, ...] = ("mp4",)) -> DataFrame:
    """Per recording the stream of the lowest bitrate among those of the given kinds."""
    w = Window.partitionBy(*by).orderBy("bitrate", F.desc("stream_id"))
    return streams.where(F.col("kind").isin(*kinds)).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def audio(spark: SparkSession, path: str, split_stereo: bool = False, **options: str) -> DataFrame:
    """``path, channel, rate, block_no, samples, error`` of PCM files under a path or pattern, see ``pcm.PcmSource``; files that can't be read are skipped.

    ``features.resampled`` brings the blocks to another rate.
    """
    spark.dataSource.register(PcmSource)
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    paths = [s.getPath().toString() for s in found or []]
    return spark.read.format("pcm").options(paths=json.dumps(paths), splitChannels=str(split_stereo).lower(), **options).load()


def pcm16(samples: np.ndarray, rate: int = SAMPLING_RATE) -> bytes:
    """A mono recording of 16-bit samples, as a file's bytes: what is beyond -1..1 is cut, halves round to even."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.rint(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def recordings(signals: DataFrame, rate: int = SAMPLING_RATE) -> DataFrame:
    """``name, content`` of signals (``rec_id, samples``) as PCM files, ``<rec_id>.wav``; a null sample is silence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rec, x in zip(pdf["rec_id"], pdf["samples"], strict=True):
                y = np.nan_to_num(np.asarray([] if x is None else x, dtype=float))
                yield pd.DataFrame({"name": [f"{rec}.wav"], "content": [pcm16(y, rate)]})

    return signals.select("rec_id", "samples").mapInPandas(run, "name string, content binary")
