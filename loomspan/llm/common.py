"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only where it is unset and all runs on one machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Rows of an Arrow batch, at most, where whole texts go to Python workers: a few megabytes of them at a time.
BATCH = 2000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH:
        spark.conf.set(key, str(BATCH))


@contextmanager
def records_per_batch(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of at most n rows for what runs inside, where rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` frees those no longer needed.

    A table that is written survives the loss of any executor.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.tables: dict[str, DataFrame] = {}

    def write(self, df: DataFrame, name: str = "t", compact: bool = False) -> DataFrame:
        """Writes a table and reads it back; ``compact`` gathers it into few files first, where a wide stage leaves little."""
        self.n += 1
        path = f"{self.base}/{self.n}-{name}"
        (df.hint("rebalance") if compact else df).write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loomspan_path = path
        self.tables[path] = out
        return out

    def drop(self, *dfs: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in dfs:
            self.tables.pop(df._loomspan_path, None)
            path = jvm.org.apache.hadoop.fs.Path(df._loomspan_path)
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Lets go of the shuffle files of steps that are done: Spark deletes them once the driver no longer refers to them, as its scheduler does to the last job."""
        self.spark.range(1).collect()
        gc.collect()
        self.spark._jvm.System.gc()

    def keep_only(self, *dfs: DataFrame) -> None:
        """Frees all tables but those that a lazy result still reads."""
        kept = {df._loomspan_path for df in dfs}
        self.drop(*(df for path, df in list(self.tables.items()) if path not in kept))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
