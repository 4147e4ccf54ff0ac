"""Drops and state stores follow the size of a replayed input."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneflow.plans import row_streams
from paneflow.streaming import runner


def test_large_replays_come_in_more_drops(spark, monkeypatch):
    """F6 to F9: a drop is bounded, so are the windows that it leaves open; the rows stay whole."""
    monkeypatch.setattr(runner, "DROP_BYTES", 4_000)
    df = spark.range(1000).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    runs = []

    def run(s, base):
        runs.append(int(spark.conf.get("spark.sql.shuffle.partitions")))
        g = s.withWatermark("ts", "0 seconds").groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
        return runner.run_to_table(g.select(F.unix_seconds("window.start").alias("at"), "n"), "sized", base=base)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = runner.replay(df, "sized", run, slices=2).collect()
    assert len(runs) == 5                                  # 16,000 bytes in four drops and the closing one
    # the stores of a small input are few (F1), the session's setting comes back
    assert set(runs) == {min(int(before), runner.MIN_STATE_PARTITIONS)}
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert sum(r["n"] for r in rows) == 1000 and len(rows) == 17


def test_row_join_stream_with_null_users(spark, tmp_path):
    """a few state partitions put null and other users into one batch; the others keep their rows."""
    n = F.col("id")
    spark.range(300).select(n.alias("event_id"), F.timestamp_seconds(n * 3600 + 86_400).alias("ts"), F.when(n % 3 > 0, n % 7).alias("user_id"),
                            F.when(n % 2 == 0, "view").otherwise("purchase").alias("event_type"),
                            (n * 37 % 101).cast("double").alias("value")).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, row_streams.jn_2_stream(spark, str(tmp_path)).collect()))
    rows = [(i % 7, i % 2 == 0, i, i * 37 % 101) for i in range(300) if i % 3]
    want = []
    for at, (user, view, i, v) in enumerate(rows):
        others = [r for r in rows[:at] if r[0] == user and r[1] != view][-row_streams.ROW_WINDOW:]
        want += [(user, i, r[2]) if view else (user, r[2], i) for r in others if (v < r[3] if view else r[3] < v)]
    assert got == sorted(want)
