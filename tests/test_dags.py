"""Several branches and stages: fan-out, user functions over cogroups, preloading, files of pairs."""

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from paneflow.operators import joins as J
from paneflow.operators import project as PR
from paneflow.plans import dags
from paneflow.plans import text as TX
from paneflow.sources import files as FS
from paneflow.sources.tables import load
from paneflow.streaming import runner


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_fan_out_resumes_and_reads_each_epoch_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            reads.add(len(pdf))
            yield pdf

    branches = {"even": lambda b: b.where("id % 2 = 0"), "sum": lambda b: b.agg(F.sum("id").alias("s"))}
    for lo, hi in ((0, 100), (100, 250)):
        spark.range(lo, hi).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):   # the second run of a drop finds nothing new
            s = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").mapInPandas(seen, "id long")
            out = runner.fan_out(s, "fan", branches, base=f"{tmp_path}/run")
    assert [r["id"] for r in out["even"].orderBy("id").collect()] == list(range(0, 250, 2))
    assert out["sum"].agg(F.sum("s")).first()[0] == sum(range(250))
    assert reads.value == 250


def test_fan_out_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "id long").write.parquet(f"{tmp_path}/in")
    out = runner.fan_out(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), "fan", {"all": lambda b: b}, base=f"{tmp_path}/run")
    assert out["all"].count() == 0 and out["all"].columns == ["id"]


def test_graph_does_not_depend_on_the_drops(spark):
    assert rows(dags.graph(spark, SF_SMALL, slices=1)) == rows(dags.graph(spark, SF_SMALL, slices=4))


def test_cogroup_apply_sees_missing_sides(spark):
    left = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long")
    right = spark.createDataFrame([(2, 5), (3, 6)], "k long, w long")

    def both(a, b):
        k = a["k"].iloc[0] if len(a) else b["k"].iloc[0]
        return pd.DataFrame({"k": [k], "n": [10 * len(a) + len(b)]})

    assert rows(J.cogroup_apply(left, right, ["k"], both, "k long, n long")) == [(1, 10), (2, 11), (3, 1)]
    assert rows(J.cogroup_apply(left, left.where("v > 10"), ["k"], both, "k long, n long")) == [(1, 10), (2, 11)]


def test_par_do_in_slices(spark):
    df = spark.range(0, 100, 1, 1)
    sizes = PR.par_do(df, lambda p: pd.DataFrame({"n": [len(p)]}), "n long", rows=16).collect()
    assert [r["n"] for r in sizes] == [16] * 6 + [4]
    assert PR.par_do(df.where("id < 0"), lambda p: p, "id long", rows=16).count() == 0


def test_preload_is_released(spark):
    with FS.preloaded(spark.range(1000)) as p:
        assert p.storageLevel.useMemory and p.count() == 1000
    assert not p.storageLevel.useMemory and not p.storageLevel.useDisk


def test_pairs_keep_odd_words(spark, tmp_path):
    pairs = [("a b", 1), ("für", -3), ('"quoted"', 2), ("it's", 5), ("back\\slash", 4)]
    FS.write_pairs(spark.createDataFrame(pairs, "word string, score long"), f"{tmp_path}/d")
    assert rows(FS.read_pairs(spark, f"{tmp_path}/d", "word string, score long")) == sorted(pairs)


def test_tweet_branches_over_one_drop(spark):
    docs = load(spark, SF_SMALL, "documents")
    assert docs.count() and rows(dags.str_11(spark, SF_SMALL)) == rows(TX.tweet(spark, TX.documents(spark, SF_SMALL)))
