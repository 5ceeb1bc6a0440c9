"""The pipeline's stages on the smallest tables, each against its own input."""

import math

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == columns and out.join(docs, "doc_id", "left_anti").count() == 0
            assert out.where("n_chars <> char_length(text) or trim(text) = ''").count() == 0
            m = out.count()
            assert 0 < m <= n
            if name == "quality_classifier":
                gone = docs.join(out, "doc_id", "left_anti").join(labels, "doc_id")
                assert m < n and gone.where("quality = 1").count() <= 0.02 * labels.where("quality = 1").count()
            n, docs = m, out
    total, sequences = out.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert math.ceil(total / 4096) <= sequences <= math.ceil(total / 4096) + 1
    assert out.select("doc_id").distinct().count() == n


def test_registered(spark, sf_dir):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(x.startswith(f"op{k}_") for x in names) for k in range(1, 11))
    assert len(pipeline.STAGES) in (4, 5)
