"""The registered queries of this package: thin calls of the operators, and DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paneflow.llm import (
    bwt_dedup,
    byte_bpe,
    byte_transducer,
    external_shuffle,
    improbable_digest,
    line_dedup,
    packing,
    path_ranking,
    prob_minhash,
    quality_ledger,
    range_ans,
    site_template,
    skip_chain_crf,
)
from paneflow.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


_TRIM = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_AZ = f"'{line_dedup.UPPER}', '{line_dedup.LOWER}'"

LINE_DEDUP_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_TRIM}), {_AZ}) AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> g.keeper, false) AS gone
      FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

_RULES_SQL = """
n_words < 20, 100 * n_repeat_words > 30 * n_words, 10 * n_symbols > 3 * n_words,
2 * n_upper > word_chars, 5 * n_shouts > n_words, 100 * n_dup_lines > 60 * n_lines,
word_chars < 2 * n_words, word_chars > 25 * n_words,
20 * n_distinct_words < least(n_words, 1000), 10 * n_stutters > 3 * n_words
"""

QUALITY_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, x, lag(x) OVER o AS before, count(*) OVER e AS n,
             string_agg(x, ' ') OVER e AS gram
      FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i),
                    e AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g WHERE n = 8),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words
      FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM r WHERE times > 1) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) FILTER (x = before) AS n_stutters FROM g GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_upper,
             len(regexp_extract_all(t, '!!')) AS n_shouts, len(l) AS n_lines,
             len(list_distinct(w)) AS n_distinct_words, coalesce(n_stutters, 0) AS n_stutters
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)),
f AS (SELECT *, list_transform([{_RULES_SQL}], lambda x: CAST(x AS BIGINT)) AS b FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       b[1] + b[2] > 0 AS base_failed, list_sum(b) = 0 AS kept,
       CAST(list_sum(list_transform(b, lambda x, i: x * (1 << (i - 1)))) AS BIGINT) AS failed_bits
FROM f
"""


@_query("op1_line_dedup", LINE_DEDUP_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(documents(spark, sf_dir))


@_query("op2_improbable_digest")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return improbable_digest.digest(documents(spark, sf_dir))


@_query("op3_quality_ledger", QUALITY_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger.digest(documents(spark, sf_dir))


@_query("op5_external_shuffle")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external_shuffle.digest(documents(spark, sf_dir))


@_query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@_query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                           public_tokenizers.PATTERN)


@_query("op7_site_template")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_template.digest(documents(spark, sf_dir, "pages"))


@_query("op10_skip_chain_crf")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skip_chain_crf.digest(documents(spark, sf_dir))


@_query("op9_prob_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.digest(documents(spark, sf_dir))


@_query("op8_bwt_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.digest(documents(spark, sf_dir))


@_query("op11_range_ans")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_ans.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


FILTER_AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
          regexp_matches(t, '[#$%&*|]'),
          coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM x a, x b, x c, x e, x g
      WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
s AS (SELECT filter_order, step, list_transform(string_split(filter_order, ''), lambda c: ascii(c) - 64) AS seq
      FROM o, range(1, 6) r(step)),
g AS (SELECT part, fails, good, bad, count(*) AS n FROM f GROUP BY ALL),
r AS (SELECT part, filter_order, step, n, good, bad, fails[seq[step]] AS now,
             list_bool_or(list_transform(seq[:step - 1], lambda k: fails[k])) AS before,
             len(list_filter(fails, lambda y: y)) AS n_fails FROM g, s)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(sum(n) FILTER (NOT now AND NOT coalesce(before, false)), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (now AND NOT coalesce(before, false)), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (now AND before), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (now AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(n) FILTER (now AND NOT coalesce(before, false) AND good), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(n) FILTER (now AND NOT coalesce(before, false) AND bad), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // greatest(n_fails, 1)) FILTER (now), 0) AS BIGINT) AS shapley
FROM r GROUP BY part, filter_order, step
"""


@_query("op12_byte_transducer", FILTER_AUDIT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_transducer.audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def _edit(cost: str, letter: str, rest: str, when: str = "") -> str:
    """SQL: an edit before the edits ``rest``; costs lead the strings, so the least string is the cheapest."""
    x = f"printf('%09d', CAST(substr({rest}, 1, 9) AS INTEGER) + {cost}) || '{letter}' || substr({rest}, 10)"
    return f"CASE WHEN {when} THEN {x} END" if when else x


def _row_edits(state: str, nxt: str, initial: str) -> str:
    """SQL: the least edits from a row on, in a state that a row with ``initial`` follows."""
    keep_s = _edit("t", "K", "s", "ok AND ini = 's'") if state == "n" else "NULL"
    return (f"least({_edit('3', 'D', state)}, {keep_s}, {_edit('t', 'K', nxt, f'ok AND ini = {initial}')}, "
            f"{_edit('2 + t', 'R', nxt, 'ok')})")


CONVERSATIONS_SQL = rf"""
WITH RECURSIVE src AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, coalesce(CAST(conv_id AS VARCHAR), ' ') AS cs,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (
  SELECT c, cs, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(key, ''),
               lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END),
             4294967295) % 20 AS k FROM src),
dmg AS (
  SELECT c, cs, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM crc WHERE k <> 0),
num AS (
  SELECT *, left(role, 1) AS ini, rtrim(text, {_TRIM}) AS seen, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role,
         sha256(cs || ':' || length(role) || ':' || role || text), copy) AS i FROM dmg),
fl AS (
  SELECT *, CASE WHEN seen = '' THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 2
                 WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         coalesce(lag(ini) OVER (PARTITION BY c ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS bad FROM num),
r AS (SELECT *, fault NOT IN (1, 2) AS ok, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS t FROM fl),
st AS (
  SELECT c, max(i) AS i, '000000000' AS n, '000000004II' AS s, '000000002I' AS u, '000000000' AS a FROM r GROUP BY c
  UNION ALL
  SELECT c, i - 1, least(wn, {_edit('2', 'I', 'wu')}, {_edit('4', 'II', 'wa')}), least(ws, {_edit('2', 'I', 'wu')}, {_edit('4', 'II', 'wa')}),
         least(wu, {_edit('2', 'I', 'wa')}), least(wa, {_edit('2', 'I', 'wu')})
  FROM (SELECT c, i, {_row_edits('n', 'u', "'u'")} AS wn, {_row_edits('s', 'u', "'u'")} AS ws,
               {_row_edits('u', 'a', "'a'")} AS wu, {_row_edits('a', 'u', "'u'")} AS wa
        FROM st JOIN r USING (c, i)) w),
best AS (SELECT c, CAST(substr(n, 1, 9) AS BIGINT) AS cost, substr(n, 10) AS audit FROM st WHERE i = 0),
let AS (SELECT c, unnest(string_split(audit, '')) AS x, generate_subscripts(string_split(audit, ''), 1) AS p FROM best WHERE audit <> ''),
pos AS (SELECT c, x, p, CASE WHEN x <> 'I' THEN count(*) FILTER (x <> 'I') OVER (PARTITION BY c ORDER BY p) END AS i,
               count(*) FILTER (x <> 'D') OVER (PARTITION BY c ORDER BY p) AS q FROM let),
kept AS (SELECT pos.c, x, p, role, text, q - max(CASE WHEN q = 1 AND x = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY pos.c) AS q
         FROM pos LEFT JOIN r ON pos.c = r.c AND pos.i = r.i WHERE x <> 'D'),
hash AS (SELECT c, sha256(string_agg(CASE WHEN x = 'K' THEN role WHEN q % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
                                     CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS h FROM kept GROUP BY c),
cnt AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
               count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (bad) AS illegal
        FROM r GROUP BY c),
ids AS (SELECT DISTINCT conv_id, c FROM src)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN cnt USING (c) LEFT JOIN best USING (c) LEFT JOIN hash USING (c)
"""


@_query("op13_path_ranking", CONVERSATIONS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_ranking.digest(documents(spark, sf_dir, "conversations"))
