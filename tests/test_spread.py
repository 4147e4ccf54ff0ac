"""Texts are dealt out by their bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneflow.sources import tables


def test_texts_are_spread_by_their_bytes(spark, tmp_path, monkeypatch):
    """the partitions follow the bytes of the rows, null keys and copies included."""
    df = spark.range(400).select(F.when(F.col("id") % 4 > 0, F.col("id") % 100).alias("doc_id"),
                                 F.repeat(F.col("id").cast("string"), 50).alias("text"))
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    par = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "SPREAD_BYTES", 400 * 100 // (2 * par))
    got = tables.load(spark, str(tmp_path), "documents", spread=True)
    assert got.rdd.getNumPartitions() > par
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))
    sizes = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in sizes) < 400 // 4        # the rows without a key lie apart
