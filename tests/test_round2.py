"""Cases in which rows used to be lost or plans did not scale."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneflow.functions import predicates as P
from paneflow.operators import aggregate as A
from paneflow.operators import stateful as S
from paneflow.operators import windows as W
from paneflow.sources import files as FS
from paneflow.streaming import runner

BIG = 2**60 + 1


def test_null_keys_and_big_keys_stay(spark):
    rows = [(None, "a", 1.0), (BIG, None, 2.0), (BIG, None, 3.0), (None, None, 4.0), (BIG - 1, "a", 5.0), (None, "a", 6.0)]
    df = spark.createDataFrame(rows * 3, "k long, s string, v double").repartition(4)
    out = A.combine_aggregate(df, ["k", "s"], "v", lambda: 0.0, lambda a, x: a + x.sum(), lambda a, b: a + b)
    got = {(r["k"], r["s"]): r["agg"] for r in out.collect()}
    assert got == {(None, "a"): 21.0, (BIG, None): 15.0, (None, None): 12.0, (BIG - 1, "a"): 15.0}


def test_partial_states_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(A, "MAX_STATES", 3)
    df = spark.range(100).select((F.col("id") % 10).alias("k"), F.col("id").cast("double").alias("v")).coalesce(1)
    out = A.combine_aggregate(df, ["k"], "v", lambda: 0.0, lambda a, x: a + x.sum(), lambda a, b: a + b)
    assert {r["k"]: r["agg"] for r in out.collect()} == {k: sum(range(k, 100, 10)) for k in range(10)}


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "double"])
def test_row_index_orders_any_type(spark, kind):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 7 % 50).cast("int"))
    lead = {"string": F.concat(F.lit("x"), F.lpad((F.col("id") * 7 % 50).cast("string"), 3, "0")), "date": day,
            "timestamp": day.cast("timestamp"), "double": (F.col("id") * 7 % 50).cast("double")}[kind]
    df = spark.range(500).select(lead.alias("o"), F.col("id"))
    rows = sorted(W.row_index(df, ["o", "id"]).collect(), key=lambda r: r["row_idx"])
    assert [r["row_idx"] for r in rows] == list(range(500))
    assert [(r["o"], r["id"]) for r in rows] == sorted((r["o"], r["id"]) for r in rows)


def test_row_index_splits_equal_leading_values(spark):
    df = spark.range(4000).select(F.lit(1).alias("o"), "id", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 2).alias("k"))
    one = W.row_index(df, ["o", "id"])
    assert one.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
    keyed = W.row_index(df, ["o", "id"], ["k"], counts_before={"even": (F.col("id") % 4 == 0).cast("int")}).collect()
    for k in (None, 0, 1):
        mine = sorted((r for r in keyed if r["k"] == k), key=lambda r: r["id"])
        assert [r["row_idx"] for r in mine] == list(range(len(mine)))
        seen = 0
        for r in mine:
            assert r["even"] == seen
            seen += r["id"] % 4 == 0


def test_failed_task_predicate_keeps_negative_cpu(spark):
    df = spark.createDataFrame([(3, -0.5, 1.0, 1.0), (3, None, 1.0, 1.0), (3, 2.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)], "event_type int, cpu double, ram double, disk double")
    assert df.where(P.failed_task_predicate(500)).count() == 2


def test_fixed_width_files_are_split_and_rewritten(spark, tmp_path):
    out = str(tmp_path / "bin")
    df = spark.range(5000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("ip_pair"), F.col("id").alias("rtt")).coalesce(1)
    assert FS.write_fixed_width(df, out, FS.PING_LAYOUT, "<") == 5000
    FS.write_fixed_width(df, out, FS.PING_LAYOUT, "<")  # a second attempt of the same tasks
    assert [f for f in os.listdir(out) if f.startswith("part-")] == ["part-00000.bin"]
    assert FS.byte_ranges(spark, out, 40, 4096).count() == -(-5000 // 102)
    back = FS.read_fixed_width(spark, out, FS.PING_LAYOUT, "<", range_bytes=4096)
    assert sorted((r["rtt"], r["ip_pair"]) for r in back.collect()) == [(i, f"p{i}") for i in range(5000)]


def test_chunks(spark, tmp_path):
    raw = bytes(np.random.default_rng(1).integers(0, 256, 10_007, dtype=np.uint8))
    (tmp_path / "f.bin").write_bytes(raw)
    rows = sorted(FS.read_chunks(spark, str(tmp_path), 100, range_bytes=1000).collect(), key=lambda r: r["start"])
    assert b"".join(bytes(r["chunk"]) for r in rows) == raw and {len(r["chunk"]) for r in rows} == {100, 7}


def _drop(spark, path, rows):
    spark.createDataFrame(rows, "k string, ts timestamp, v long").coalesce(1).write.mode("append").parquet(path)


def test_update_mode_keeps_keys_of_earlier_epochs(spark, tmp_path):
    path, t = str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    _drop(spark, path, [("a", t, 1), ("c", t, 5)])
    _drop(spark, path, [("b", t, 2), ("a", t, 3)])
    s = FS.file_drop_stream(spark, path, spark.read.parquet(path).schema, 1).groupBy("k").agg(F.sum("v").alias("s"))
    assert {r["k"]: r["s"] for r in runner.run_update(s, "upd", ["k"]).collect()} == {"a": 4, "b": 2, "c": 5}


def test_a_run_resumes_from_its_folder(spark, tmp_path):
    path, base, t = str(tmp_path / "in"), str(tmp_path / "run"), dt.datetime(2024, 1, 1)
    _drop(spark, path, [("a", t, 1)])
    read = lambda: FS.file_drop_stream(spark, path, spark.read.parquet(path).schema).select("k", "v")
    assert runner.run_to_table(read(), "r", base=base).count() == 1
    _drop(spark, path, [("b", t, 2)])
    out = runner.run_to_table(read(), "r", base=base)
    assert sorted(r["k"] for r in out.collect()) == ["a", "b"]  # the first row is not written again


def test_file_drop_join_loses_no_date(spark, tmp_path):
    """The drop slices follow the data's own dates."""
    import __spark_entry__ as entry
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    n = entry.queries()["q_join"](spark, "/root/testdata/sf0.001").count()
    moved = src.withColumn("ts", (F.col("ts") + F.expr("INTERVAL 400 DAYS")).cast("timestamp_ntz"))
    moved.write.parquet(str(tmp_path / "events.parquet"))
    assert entry.queries()["src_13_file_drop_two_streams"](spark, str(tmp_path)).count() == n


def test_drive_on_times(spark):
    rows = [(1, 30 * i, 0, 5, 0 if 2 <= i <= 8 else 40, 100 if 1 <= i <= 8 else 100 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "vid long, r_time long, xway long, seg long, speed long, pos long")
    (r,) = S.stop_intervals(df).collect()
    assert r["end_time"] == 30 * 9 and r["start_time"] == 30 * 4


@pytest.mark.parametrize("chunk", [45, 100, 300, 10**6])
def test_stop_runs_cross_chunks(spark, chunk):
    """Chunk size does not change the stops; compared with a plain loop."""
    import random
    r = random.Random(9)
    rows = []
    for vid in (1, 2, None):
        pos = 0
        for i in range(160):
            if r.random() < 0.15:
                pos += 1
            rows.append((vid, 30 * i, 0, 5, 0 if r.random() < 0.6 else 30, pos))
    df = spark.createDataFrame(rows, "vid long, r_time long, xway long, seg long, speed long, pos long")
    want, state = [], {}
    for vid, t, _, _, speed, pos in rows:
        last, n = state.get(vid, (None, 0))
        n = 1 if pos != last else n + (speed == 0)
        if pos == last and speed == 0 and n == 4:
            want.append((vid, t))
        state[vid] = (pos, n)
    assert sorted(((x["vid"], x["r_time"]) for x in S.stop_events(df, chunk=chunk).collect()), key=str) == sorted(want, key=str)
    ends = {(x["vid"], x["start_time"]): x["end_time"] for x in S.stop_intervals(df, chunk=chunk).collect()}
    for (vid, t), end in ends.items():
        assert end == min((y[1] for y in rows if y[0] == vid and y[1] > t and y[4] != 0), default=None)
