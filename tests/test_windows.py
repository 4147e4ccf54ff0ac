"""Window operators: ported session edge cases, pane rewrite, row index under skew."""

import datetime as dt

from pyspark.sql import functions as F

from paneflow.operators import aggregate as A
from paneflow.operators import windows as W

T0 = dt.datetime(2002, 1, 10)


def _sessions(spark, secs, gap="3 seconds"):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s)) for i, s in enumerate(secs)],
                               "id long, ts timestamp")
    s = W.session(df, gap).groupBy("session").agg(F.count("*").alias("n"))
    rows = s.select(F.col("session.start").alias("start"), W.session_end().alias("end"), "n") \
            .orderBy("start").collect()
    return [((r.start - T0).total_seconds(), (r.end - T0).total_seconds(), r.n) for r in rows]


def _leaps(step):
    out, cur = [], 0
    for i in range(100):
        cur += step * (10 if i % 10 == 0 else 1)
        out.append(cur)
    return out


def test_session_in_order_with_leaps(spark):
    got = _sessions(spark, _leaps(1))
    assert len(got) == 10 and all(n == 10 for _, _, n in got)
    assert all(e - s == 9 + 3 for s, e, _ in got)


def test_session_reverse_order(spark):
    got = _sessions(spark, _leaps(-1))
    assert len(got) == 10 and all(n == 10 for _, _, n in got)


def test_session_merge_by_bridging_records(spark):
    assert _sessions(spark, [0, 4, 8]) == [(0, 3, 1), (4, 7, 1), (8, 11, 1)]
    assert _sessions(spark, [0, 4, 8, 2, 6]) == [(0, 11, 5)]


def test_session_touching_windows_do_not_merge(spark):
    # slow-path merge case: 13 starts exactly where [9, 13) ends
    assert _sessions(spark, [10, 14, 18, 9, 13]) == [(9, 13, 2), (13, 17, 2), (18, 21, 1)]
    assert _sessions(spark, [0, 3]) == [(0, 3, 1), (3, 6, 1)]


def test_pane_rewrite_equals_sliding_window(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet") \
        .withColumn("ts", F.col("ts").cast("timestamp")) \
        .withColumn("v", F.floor(F.col("value") * 100).cast("long"))
    panes = A.pane_sliding(ev, "3 hours", "1 hour", {"n": ("cnt", None), "s": ("sum", "v"),
                                                     "mx": ("max", "v")}, keys=["event_type"])
    direct = A.window_aggregate(W.sliding(ev, "3 hours", "1 hour"), "window", ["event_type"],
                                [F.count("*").alias("n"), F.sum("v").alias("s"), F.max("v").alias("mx")])
    a = sorted(map(tuple, panes.collect()))
    b = sorted(map(tuple, direct.collect()))
    assert a == b and len(a) > 0


def test_row_index_dense_with_hot_key(spark):
    # one key holds a third of the rows
    rows = [(0 if i % 3 == 0 else i % 50, i, (i * 7919) % 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, id long, t long")
    got = W.row_index(df, ["t", "id"], ["k"]).select("k", "id", "t", "row_idx").collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r.k, []).append(r)
    for k, rs in by_key.items():
        rs.sort(key=lambda r: (r.t, r.id))
        assert [r.row_idx for r in rs] == list(range(len(rs)))
    glob = W.row_index(df, ["t", "id"]).select("id", "t", "row_idx").collect()
    glob.sort(key=lambda r: (r.t, r.id))
    assert [r.row_idx for r in glob] == list(range(3000))


def test_row_windows_sliding(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(23)], "id long, t long")
    got = W.row_windows(df, 5, 2, ["t"]).groupBy("win_id").agg(F.collect_list("id").alias("ids"))
    res = {r.win_id: sorted(r.ids) for r in got.collect()}
    assert res[0] == [0, 1, 2, 3, 4] and res[1] == [2, 3, 4, 5, 6] and res[11] == [22]
    full = W.row_windows(df, 5, 2, ["t"], complete_only=True).select("win_id").distinct().count()
    assert full == 10  # windows 0..9 end at rows 4..22


def test_session_aggregate_premerge_equals_row_sessions(spark):
    import random
    random.seed(5)
    rows = [(0 if i % 3 == 0 else i % 7, T0 + dt.timedelta(seconds=random.randint(0, 20000)))
            for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, ts timestamp")
    direct = W.session(df, "100 seconds").groupBy("k", "session").agg(F.count("*").alias("n")) \
        .select("k", W.micros("session.start").alias("s"), W.micros(W.session_end()).alias("e"), "n")
    pre = W.session_aggregate(df, "100 seconds", ["k"], {"n": ("cnt", None)}) \
        .select("k", F.col("session_start").alias("s"), F.col("session_end").alias("e"), "n")
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, pre.collect()))
