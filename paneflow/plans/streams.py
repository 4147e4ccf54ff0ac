"""Two-stream joins (Q-JOIN, JN-1 … JN-4, JN-7, JN-8), network latency (Q-NET) and the
streaming forms (watermarks, availableNow runs) of several queries.

Streams over ``events``: the left stream is the ``view`` events, the right stream the
``click`` (or ``purchase``) events, both keyed by ``user_id``.  Every time-range join
uses the bucketed form of :mod:`paneflow.operators.joins`, so no join degrades to a
nested loop and no key group holds more than one window span of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.functions import expr as E
from paneflow.operators import aggregate as A
from paneflow.operators import joins as J
from paneflow.operators import windows as W
from paneflow.plans import params
from paneflow.plans.registry import alias, register
from paneflow.plans.sqlviews import with_views
from paneflow.session import cut_lineage
from paneflow.sources import fixtures as X
from paneflow.sources.tables import load, load_stream
from paneflow.streaming import runner

JOIN_WINDOW = "1 hour"      # reference: 1 s (events are ~260 s apart at sf0.01)
THETA_WINDOW = "2 hours"
ROW_WINDOW = 20
H = params.HOUR_US


def tagged(events: DataFrame, kind: str, side: int) -> DataFrame:
    """PRJ-4: a keyed, side-tagged stream of one event type: (k, v, side, ts)."""
    return events.filter(F.col("event_type") == kind).select(
        F.col("user_id").alias("k"), F.col("event_id").alias("v"),
        F.lit(side).alias("side"), "ts")


def two_stream_join(events: DataFrame, w=JOIN_WINDOW) -> DataFrame:
    """Q-JOIN / JN-7: views ⋈ clicks on user, click time in ``[view - w, view + w)``.
    Output (k, left value, right value) in (left, right) order."""
    j = J.interval_join(tagged(events, "view", 0), tagged(events, "click", 1), ["k"], w, w)
    return j.select("k", F.col("l_v").alias("l_v"), F.col("r_v").alias("r_v"))


def theta_range(events: DataFrame) -> DataFrame:
    """JN-1: range-window theta join views × purchases with ``l.value < r.value``."""
    l_ = events.filter(F.col("event_type") == "view").select("event_id", "ts", "value")
    r_ = events.filter(F.col("event_type") == "purchase").select("event_id", "ts", "value")
    j = J.theta_join_range(l_, r_, THETA_WINDOW, THETA_WINDOW,
                           predicate=lambda lc, rc: lc("value") < rc("value"), order="value")
    return j.select("l_event_id", "r_event_id")


def theta_equalities(events: DataFrame) -> DataFrame:
    """JN-3: the theta join with a conjunction of equality predicates."""
    l_ = events.filter(F.col("event_type") == "view").select("event_id", "ts", "user_id")
    r_ = events.filter(F.col("event_type") == "purchase").select("event_id", "ts", "user_id")
    pred = lambda lc, rc: ((lc("user_id") % 10) == (rc("user_id") % 10)) & \
        ((lc("event_id") % 3) == (rc("event_id") % 3))
    j = J.theta_join_range(l_, r_, THETA_WINDOW, THETA_WINDOW, predicate=pred)
    return j.select("l_event_id", "r_event_id")


def theta_less(events: DataFrame, offset: float) -> DataFrame:
    """JN-3: range-window theta join views × purchases with ``l.value + offset < r.value``."""
    l_ = events.filter(F.col("event_type") == "view").select("event_id", "ts", "value")
    r_ = events.filter(F.col("event_type") == "purchase").select("event_id", "ts", "value")
    return J.theta_join_less(l_, r_, THETA_WINDOW, THETA_WINDOW, "value", offset).select("l_event_id", "r_event_id")


def theta_rows(events: DataFrame, size: int = ROW_WINDOW) -> DataFrame:
    """JN-2: row-window theta join (last ``size`` rows of the other side)."""
    l_ = events.filter(F.col("event_type") == "view").select("event_id", "ts", "value")
    r_ = events.filter(F.col("event_type") == "purchase").select("event_id", "ts", "value")
    j = J.theta_join_rows(l_, r_, size, size, predicate=lambda lc, rc: lc("value") < rc("value"),
                          order=["event_id"])
    return j.select("l_event_id", "r_event_id")


def rtt_per_pair(events: DataFrame, window=params.NET_WINDOW) -> DataFrame:
    """Q-NET / AGG-19: RTT sum per IP pair per window."""
    w = W.tumbling(X.pings(events), window)
    return A.window_aggregate(w, "window", ["ip_pair"], [F.sum("rtt").alias("rtt_sum")])


# ---------------------------------------------------------------- streaming forms

def stream_two_stream_join(spark, d: str, w=JOIN_WINDOW) -> DataFrame:
    """JN-8 / STR-3: Q-JOIN as a stream-stream join; both sides watermarked, join
    state expires by the opposite side's watermark (global watermark = min)."""
    ev = load_stream(spark, d, "events")
    left = tagged(ev, "view", 0).withWatermark("ts", "2 hours")
    right = tagged(ev, "click", 1).withWatermark("ts", "2 hours")
    j = J.interval_join(left, right, ["k"], w, w)
    return runner.run_to_table(j.select("k", "l_v", "r_v"), "jn8")


def _views(spark, d: str) -> DataFrame:
    """The events that reach the watermark: the optimizer would push the view filter below
    it anyway, and a replayed stream's closing row must pass it."""
    return load(spark, d, "events").where(F.col("event_type").startswith("view"))


def stream_campaign_counts(spark, d: str, delay: str = "0 seconds", lag_us=None, slices: int = 3) -> DataFrame:
    """Q-YSB3 as an append-mode stream: windows close when the watermark passes their end."""
    from paneflow.plans.ysb import ysb_campaign_counts
    dim = _static_campaigns(spark, d)
    return runner.replay(_views(spark, d), "ysb_stream", lambda s, base: runner.run_to_table(
        ysb_campaign_counts(s.withWatermark("ts", delay), campaigns=dim), "ysb", base=base), lag_us=lag_us, slices=slices)


MAX_LAG_H = 48


def lag(event_id: str = "event_id"):
    """How much later than its time an event arrives: up to ``MAX_LAG_H`` hours, by its number."""
    return (F.col(event_id) * 7919 % (2 * MAX_LAG_H)) * (H // 2)


def out_of_order(spark, d: str, delay_h: int = MAX_LAG_H) -> DataFrame:
    """Q-YSB3 over six drops of late rows, with a watermark ``delay_h`` hours behind."""
    return stream_campaign_counts(spark, d, f"{delay_h} hours", lag(), slices=6)


def _static_campaigns(spark, d: str) -> DataFrame:
    """The static ad → campaign dimension (batch) joined to streams, derived once."""
    return cut_lineage(X.campaigns(load(spark, d, "events")))


def _sql_join():
    return f"""SELECT l.user_id AS k, l.event_id AS l_v, r.event_id AS r_v
FROM events l JOIN events r ON l.user_id = r.user_id
WHERE l.event_type = 'view' AND r.event_type = 'click'
  AND epoch_us(r.ts) >= epoch_us(l.ts) - {H} AND epoch_us(r.ts) < epoch_us(l.ts) + {H}"""


SQL_JOIN = _sql_join()

SQL_THETA = f"""SELECT l.event_id AS l_event_id, r.event_id AS r_event_id
FROM (SELECT * FROM events WHERE event_type = 'view') l
JOIN (SELECT * FROM events WHERE event_type = 'purchase') r
  ON epoch_us(r.ts) BETWEEN epoch_us(l.ts) - {2 * H} AND epoch_us(l.ts) + {2 * H}
WHERE l.value < r.value"""

# Offsets that leave about a hundredth and a half of the pairs of the test values.
SELECTIVE, HALF = 200.0, 0.0


def _sql_less(offset: float) -> str:
    return SQL_THETA.replace("l.value < r.value", f"l.value + CAST({offset} AS DOUBLE) < r.value")


SQL_THETA_EQ = f"""SELECT l.event_id AS l_event_id, r.event_id AS r_event_id
FROM (SELECT * FROM events WHERE event_type = 'view') l
JOIN (SELECT * FROM events WHERE event_type = 'purchase') r
  ON epoch_us(r.ts) BETWEEN epoch_us(l.ts) - {2 * H} AND epoch_us(l.ts) + {2 * H}
WHERE l.user_id % 10 = r.user_id % 10 AND l.event_id % 3 = r.event_id % 3"""

SQL_THETA_ROWS = f"""WITH m AS (
  SELECT event_id, value, side, row_number() OVER (ORDER BY ts, side, event_id) - 1 AS mi,
         row_number() OVER (PARTITION BY side ORDER BY ts, side, event_id) - 1 AS j
  FROM (SELECT event_id, ts, value, CASE event_type WHEN 'view' THEN 1 ELSE 0 END AS side
        FROM events WHERE event_type IN ('view', 'purchase')) s),
o AS (SELECT *, mi - j AS other,
             CASE WHEN mi - j - {ROW_WINDOW} <= 0 THEN 0 ELSE mi - j - {ROW_WINDOW} END AS lo FROM m)
SELECT a.event_id AS l_event_id, b.event_id AS r_event_id
FROM o a JOIN o b ON a.side = 1 AND b.side = 0 AND b.j >= a.lo AND b.j < a.other
WHERE a.value < b.value
UNION ALL
SELECT b.event_id AS l_event_id, a.event_id AS r_event_id
FROM o a JOIN o b ON a.side = 0 AND b.side = 1 AND b.j >= a.lo AND b.j < a.other
WHERE b.value < a.value"""

SQL_NET = with_views(f"""
SELECT (epoch_us(ts) // {H}) * {H} AS window_start, (epoch_us(ts) // {H}) * {H} + {H} AS window_end,
       ip_pair, CAST(sum(rtt) AS BIGINT) AS rtt_sum
FROM pings GROUP BY 1, 2, 3""", "pings")

SQL_TAG = """SELECT user_id AS k, event_id AS v, 0 AS side, epoch_us(ts) AS ts_us FROM events
WHERE event_type = 'view'"""


@register("q_join", SQL_JOIN)
def q_join(spark, d):
    return two_stream_join(load(spark, d, "events"))


@register("jn_1_theta_join_range_windows", SQL_THETA)
def jn_1(spark, d):
    return theta_range(load(spark, d, "events"))


@register("jn_2_theta_join_row_windows", SQL_THETA_ROWS)
def jn_2(spark, d):
    return theta_rows(load(spark, d, "events"))


@register("jn_3_theta_predicate_families", SQL_THETA_EQ)
def jn_3(spark, d):
    return theta_equalities(load(spark, d, "events"))


@register("jn_3_less_one_percent", _sql_less(SELECTIVE))
def jn_3_selective(spark, d):
    return theta_less(load(spark, d, "events"), SELECTIVE)


@register("jn_3_less_half", _sql_less(HALF))
def jn_3_half(spark, d):
    return theta_less(load(spark, d, "events"), HALF)


@register("jn_8_join_state_expiry_stream", SQL_JOIN)
def jn_8(spark, d):
    return stream_two_stream_join(spark, d)


@register("q_net", SQL_NET)
def q_net(spark, d):
    return rtt_per_pair(load(spark, d, "events"))


@register("prj_4_key_tagging", SQL_TAG)
def prj_4(spark, d):
    t = tagged(load(spark, d, "events"), "view", 0)
    kv = t.select(E.key_pair("k", 0).alias("kv"), "v", "ts")
    return kv.select(F.col("kv.k").alias("k"), "v", F.col("kv.side").alias("side"),
                     W.micros("ts").alias("ts_us"))


alias("jn_7_interval_equi_join", "q_join")
alias("jn_4_batch_theta_join", "jn_1_theta_join_range_windows")
alias("agg_19_rtt_per_ip_pair", "q_net")


# ---------------------------------------------------------------- streaming registrations

def _ysb_sql():
    from paneflow.plans.ysb import SQL_YSB2, SQL_YSB3
    return SQL_YSB3, SQL_YSB2


@register("str_1_ascending_watermark_stream", _ysb_sql()[0])
def str_1(spark, d):
    return stream_campaign_counts(spark, d)


@register("str_4_out_of_order_watermark_delay", _ysb_sql()[0])
def str_4(spark, d):
    """Rows arrive up to two days late, past windows that a watermark without delay has closed; a
    watermark two days behind loses none of them."""
    return out_of_order(spark, d)


@register("str_9_exactly_once_foreach_batch", _ysb_sql()[0])
def str_9(spark, d):
    import os
    from paneflow.plans.ysb import ysb_campaign_counts
    dim = _static_campaigns(spark, d)

    def run(stream, base):
        out = os.path.join(base, "out")
        agg = ysb_campaign_counts(stream.withWatermark("ts", "0 seconds"), campaigns=dim)
        runner.run_foreach_batch(agg, "ysb_fb", runner.idempotent_parquet_batches(out), base=base)
        return spark.read.schema(agg.schema).parquet(out).drop("epoch")

    return runner.replay(_views(spark, d), "ysb_fb", run)


@register("str_12_output_modes_complete", _ysb_sql()[1])
def str_12(spark, d):
    from paneflow.plans.ysb import ysb_campaign_count
    agg = ysb_campaign_count(load_stream(spark, d, "events"), campaigns=_static_campaigns(spark, d))
    return runner.run_complete(agg, "ysb_complete")


alias("snk_4_foreach_batch", "str_9_exactly_once_foreach_batch")


# ---------------------------------------------------------------- streams of the text and window queries

def _text_sql():
    from paneflow.plans.text import SQL_DIST, SQL_TOPK, SQL_WC
    return SQL_WC, SQL_TOPK, SQL_DIST


def _docs(spark, d):
    from paneflow.plans.text import documents
    return documents(spark, d).select("doc_id", "text", "ts")


@register("q_wc_stream", _text_sql()[0])
def q_wc_stream(spark, d):
    """Q-WC as an append-mode stream."""
    from paneflow.plans.text import word_count
    return runner.replay(_docs(spark, d), "wc", lambda s, base: runner.run_to_table(
        word_count(s.withWatermark("ts", "0 seconds")), "wc", base=base))


@register("q_topk_stream", _text_sql()[1])
def q_topk_stream(spark, d):
    """Q-TOPK as a stream: a closed window leaves with all its words in one micro-batch, so
    the batch callback ranks them and writes the winners."""
    import os
    from paneflow.plans.text import word_count

    def run(stream, base):
        out = os.path.join(base, "out")
        counts = word_count(stream.withWatermark("ts", "0 seconds"))
        put = runner.idempotent_parquet_batches(out)
        runner.run_foreach_batch(counts, "topk", lambda b, e: put(
            A.top_k(b, 10, ["window_start"], "cnt", tie=["word"]), e), base=base)
        return spark.read.parquet(out).drop("epoch")

    return runner.replay(_docs(spark, d), "topk", run)


@register("q_dist_stream", _text_sql()[2])
def q_dist_stream(spark, d):
    """Q-DIST / AGG-13 as a stream: duplicates dropped per window, then counted."""
    from paneflow.functions import text as T
    from paneflow.plans.text import WIN

    def count(s):
        ln = s.withWatermark("ts", "0 seconds").select("ts", F.explode(T.lines("text")).alias("line"))
        once = W.tumbling(ln, WIN).select("window", "line").dropDuplicates(["window", "line"])
        return A.window_aggregate(once, "window", [], [F.count(F.lit(1)).alias("distinct_lines")])

    return runner.replay(_docs(spark, d), "dist", lambda s, base: runner.run_to_table(count(s), "dist", base=base))
