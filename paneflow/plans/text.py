"""Text pipelines: word count, top words, grep, windowed grep, distinct lines, tweet
scoring (Q-WC, Q-TOPK, Q-GREP, Q-WGREP, Q-DIST, Q-TWEET) and their operator rows.

Records are whole texts (``documents.text``, ``pages`` url + html).  Event time is
assigned per record by the rate rule of SRC-14 (``bundle`` records per second).
Tokenising is a narrow ``explode`` of JVM regex results; counts are partial/final
aggregates, so a word occurring in a third of all records costs one partial row per
task, not one row per occurrence in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.functions import text as T
from paneflow.operators import aggregate as A
from paneflow.operators import windows as W
from paneflow.plans import params
from paneflow.plans.registry import alias, register
from paneflow.sources import files as FS
from paneflow.sources.eventtime import assign_event_time
from paneflow.sources.tables import load
from paneflow.streaming.runner import scratch_path

BUNDLE, WIN = params.TEXT_BUNDLE, params.TEXT_WINDOW
WIN_US = W.to_us(WIN)
BASE_US = 1_704_067_200_000_000  # 2024-01-01 00:00:00 UTC in µs

# Keyword dictionary for the scoring branch: fixed literal (word, score) pairs built
# from words that occur in the documents (fixed values).
KEYWORDS = [
    ("the", 1), ("and", 1), ("of", -1), ("to", 2), ("is", 1), ("with", 3), ("this", -2),
    ("for", 2), ("are", -1), ("on", 1), ("by", -3), ("it", 2), ("as", 1), ("be", -1),
    ("le", 1), ("la", 2), ("les", -1), ("des", 1), ("du", -2), ("un", 3), ("qui", 1),
    ("der", 2), ("die", 1), ("und", -1), ("das", 2), ("nicht", -3), ("für", 2),
    ("el", 1), ("los", -1), ("que", 2), ("por", 1), ("con", -2),
]


def keyword_table(spark) -> DataFrame:
    return spark.createDataFrame(KEYWORDS, "word string, score long")


def documents(spark, d: str) -> DataFrame:
    """Documents with event time: ``BUNDLE`` documents per second in ``doc_id`` order."""
    return assign_event_time(load(spark, d, "documents", spread=True).select("doc_id", "text"),
                             row="doc_id", bundle=BUNDLE, delta="1 second")


def page_records(spark, d: str) -> DataFrame:
    """Pages as text records (url and html), ``BUNDLE`` pages per second."""
    p = load(spark, d, "pages", spread=True).select("page_id", F.concat_ws("\n", "url", "html").alias("text"))
    return assign_event_time(p, row="page_id", bundle=BUNDLE, delta="1 second")


def word_count(docs: DataFrame, window=WIN) -> DataFrame:
    """Q-WC / AGG-12: count per (window, word)."""
    w = T.explode_words(W.tumbling(docs, window), keep=("window",))  # one window per text, not per word
    return A.window_aggregate(w, "window", ["word"], [F.count(F.lit(1)).alias("cnt")])


def top_words(docs: DataFrame, k: int = 10, window=WIN) -> DataFrame:
    """Q-TOPK / TOP-1: the ``k`` most frequent words per window (ties: word ascending)."""
    return A.top_k(word_count(docs, window), k, ["window_start"], "cnt", tie=["word"])


def grep(records: DataFrame, pattern: str = T.URL_PATTERN) -> DataFrame:
    """Q-GREP / FN-6: every match of ``pattern`` in each record, with its capture groups."""
    m = records.select("page_id", F.explode(T.find_all_with_groups("text", pattern, 4)).alias("m"))
    return m.select("page_id", *[F.col("m")[str(i)].alias(f"g{i}") for i in range(5)])


def windowed_grep(records: DataFrame, pattern: str = T.URL_PATTERN, window=WIN) -> DataFrame:
    """Q-WGREP: matches collected per window, as the bag (window, match, occurrences)."""
    w = W.tumbling(records, window).select("window", F.explode(T.find_all("text", pattern)).alias("match"))
    return A.window_aggregate(w, "window", ["match"], [F.count(F.lit(1)).alias("occurrences")])


def distinct_lines(docs: DataFrame, window=WIN) -> DataFrame:
    """Q-DIST / AGG-13: number of distinct non-empty lines per window (exact)."""
    w = W.tumbling(docs, window).select("window", F.explode(T.lines("text")).alias("line"))
    return A.window_aggregate(w, "window", [], [F.countDistinct("line").alias("distinct_lines")])


def score_branch(spark, docs: DataFrame, window=WIN) -> DataFrame:
    """AGG-16 + FN-8: keyword score summed per window, emitted as (window_end, score)."""
    sc = docs.select("ts", T.keyword_score_column("text", KEYWORDS).alias("score"))
    w = W.tumbling(sc, window)
    return w.groupBy("window").agg(F.sum("score").alias("score")) \
            .select(W.micros("window.end").alias("window_end"), "score")


def tweet(spark, docs: DataFrame, window=WIN) -> DataFrame:
    """Q-TWEET / JN-11 / STR-11 / SRC-11: the score branch joined with the word-count branch of
    the same stream on window end (one row per word result of the window).

    Both branches come from one pass over the texts: a text's words and one tag, its score behind a
    zero byte (which no word has), are exploded together and counted per (window, word).  The tags
    give the window's score.  Both sides of the join read the same columns of the same groups and are
    told apart by an aggregate (a filter on the word would be pushed below it), so they share one
    exchange and with it the scan.
    """
    tag = F.concat(F.lit("\0"), T.keyword_score_column("text", KEYWORDS).cast("string"))
    # the array stands inside explode: as a column of its own it would be computed again in a filter on its size
    words = W.tumbling(docs, window).select(W.micros("window.end").alias("window_end"),
                                            F.explode(F.array_append(T.find_all("text", T.WORD_PATTERN), tag)).alias("word"))
    groups = words.groupBy("window_end", F.upper("word").alias("word")).agg(
        F.count(F.lit(1)).alias("cnt"), F.bool_or(F.col("word").startswith("\0")).alias("tag"))
    total = groups.where("tag").groupBy("window_end").agg(F.sum(F.col("cnt") * F.substring("word", 2, 20).cast("long")).alias("score"))
    return groups.where("NOT tag").join(total, "window_end").select("window_end", "word", "cnt", "score")


# ---------------------------------------------------------------- oracle SQL

_DOCS = f"(SELECT doc_id, text, {BASE_US} + (doc_id // {BUNDLE}) * 1000000 AS ts_us FROM documents)"
_WORDS = f"""(SELECT ts_us, doc_id, upper(w) AS word FROM
   (SELECT ts_us, doc_id, unnest(regexp_extract_all(text, '([A-Za-z][A-Za-z'']*)', 1)) AS w FROM {_DOCS} d) x)"""
_WS = f"(ts_us // {WIN_US}) * {WIN_US}"
_PAGES = (f"(SELECT page_id, concat_ws(chr(10), url, html) AS text, "
          f"{BASE_US} + (page_id // {BUNDLE}) * 1000000 AS ts_us FROM pages)")
_URL = T.URL_PATTERN.replace("'", "''")

SQL_WC = f"""SELECT {_WS} AS window_start, {_WS} + {WIN_US} AS window_end, word, count(*) AS cnt
FROM {_WORDS} w GROUP BY 1, 2, 3"""

SQL_TOPK = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY cnt DESC, word) AS rank
FROM ({SQL_WC}) c) r WHERE rank <= 10"""

SQL_GREP = f"""SELECT page_id, m[1] AS g0, m[2] AS g1, m[3] AS g2, m[4] AS g3, m[5] AS g4 FROM (
  SELECT page_id, unnest(list_zip(regexp_extract_all(text, '{_URL}', 0), regexp_extract_all(text, '{_URL}', 1),
         regexp_extract_all(text, '{_URL}', 2), regexp_extract_all(text, '{_URL}', 3),
         regexp_extract_all(text, '{_URL}', 4))) AS m FROM {_PAGES} p) x"""

SQL_WGREP = f"""SELECT {_WS} AS window_start, {_WS} + {WIN_US} AS window_end, match, count(*) AS occurrences
FROM (SELECT ts_us, unnest(regexp_extract_all(text, '{_URL}', 0)) AS match FROM {_PAGES} p) x GROUP BY 1, 2, 3"""

SQL_DIST = f"""SELECT {_WS} AS window_start, {_WS} + {WIN_US} AS window_end, count(DISTINCT line) AS distinct_lines
FROM (SELECT ts_us, unnest(string_split(text, chr(10))) AS line FROM {_DOCS} d) x
WHERE length(line) > 0 GROUP BY 1, 2"""

_KW = "(VALUES " + ", ".join(f"('{w}', {s})" for w, s in KEYWORDS) + ") kw(word, score)"
_SCORES = f"""(SELECT d.doc_id, d.ts_us, coalesce(s.score, 0) AS score FROM {_DOCS} d LEFT JOIN
   (SELECT t.doc_id, sum(kw.score) AS score FROM
      (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t]')) AS word FROM documents) t
    JOIN {_KW} ON t.word = kw.word GROUP BY t.doc_id) s ON d.doc_id = s.doc_id)"""

SQL_SCORE = f"""SELECT {_WS} + {WIN_US} AS window_end, CAST(sum(score) AS BIGINT) AS score
FROM {_SCORES} s GROUP BY 1"""

SQL_DOC_SCORE = f"SELECT doc_id, CAST(score AS BIGINT) AS score FROM {_SCORES} s"

SQL_TWEET = f"""SELECT w.window_end, w.word, w.cnt, s.score FROM ({SQL_WC}) w JOIN ({SQL_SCORE}) s
ON w.window_end = s.window_end"""

SQL_REKEY = f"SELECT window_end, cnt FROM ({SQL_WC}) w"

SQL_GROUPS = f"""SELECT window_start, window_end, count(*) AS groups FROM ({SQL_WC}) w GROUP BY 1, 2"""

SQL_TOKENS = f"""SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_distinct, 0) AS n_distinct
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_words, count(DISTINCT word) AS n_distinct
FROM {_WORDS} w GROUP BY 1) c ON d.doc_id = c.doc_id"""

SQL_LINES = """SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0)) AS BIGINT) AS lines,
  CAST(CASE WHEN len(string_split(text, chr(10))) > 2
       THEN len(list_filter(string_split(text, chr(10))[2:len(string_split(text, chr(10))) - 1], lambda x: length(x) > 0))
       ELSE 0 END AS BIGINT) AS chunk_lines
FROM documents"""

SQL_SUBSTR = """SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS occurrences FROM documents"""


@register("q_wc", SQL_WC)
def q_wc(spark, d):
    return word_count(documents(spark, d))


@register("q_topk", SQL_TOPK)
def q_topk(spark, d):
    return top_words(documents(spark, d))


@register("q_grep", SQL_GREP)
def q_grep(spark, d):
    return grep(page_records(spark, d))


@register("q_wgrep", SQL_WGREP)
def q_wgrep(spark, d):
    return windowed_grep(page_records(spark, d))


@register("q_dist", SQL_DIST)
def q_dist(spark, d):
    return distinct_lines(documents(spark, d))


@register("q_tweet", SQL_TWEET)
def q_tweet(spark, d):
    return tweet(spark, documents(spark, d))


@register("agg_16_window_sum_tvpair", SQL_SCORE)
def agg_16(spark, d):
    return score_branch(spark, documents(spark, d))


@register("agg_17_rekey_window_end", SQL_REKEY)
def agg_17(spark, d):
    return word_count(documents(spark, d)).select("window_end", "cnt")


@register("agg_18_group_count_per_window", SQL_GROUPS)
def agg_18(spark, d):
    wc = word_count(documents(spark, d))
    return wc.groupBy("window_start", "window_end").agg(F.count(F.lit(1)).alias("groups"))


@register("fn_8_keyword_score", SQL_DOC_SCORE)
def fn_8(spark, d):
    docs = load(spark, d, "documents", spread=True).select("doc_id", "text")
    path = scratch_path(spark, "dictionary")
    FS.write_pairs(keyword_table(spark), path)
    return T.keyword_score(docs, FS.read_pairs(spark, path, "word string, score long"), ["doc_id"])


@register("fn_4_word_tokenizer", SQL_TOKENS)
def fn_4(spark, d):
    docs = load(spark, d, "documents", spread=True).select("doc_id", "text")
    ws = T.words("text")
    return docs.select("doc_id", F.size(ws).cast("long").alias("n_words"),
                       F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"))


@register("fn_5_line_splitter", SQL_LINES)
def fn_5(spark, d):
    docs = load(spark, d, "documents", spread=True).select("doc_id", "text")
    return docs.select("doc_id", F.size(T.lines("text")).cast("long").alias("lines"),
                       F.size(T.lines("text", chunked=True)).cast("long").alias("chunk_lines"))


@register("fn_7_substring_find_all", SQL_SUBSTR)
def fn_7(spark, d):
    docs = load(spark, d, "documents", spread=True).select("doc_id", "text")
    return docs.select("doc_id", T.count_substring("text", "the").cast("long").alias("occurrences"))


alias("agg_12_windowed_word_count", "q_wc")
alias("top_1_topk_per_window", "q_topk")
alias("fn_6_regex_find_all", "q_grep")
alias("agg_13_windowed_distinct", "q_dist")
alias("jn_11_branch_join_window_end", "q_tweet")
