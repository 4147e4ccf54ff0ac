"""Text functions (FN-4 … FN-8, UDF-2): tokenizers, line splitter, grep, keyword score.

Every function works on whole texts with JVM regex / string built-ins; a text is
exploded into its tokens in the task that reads it (``explode`` is narrow), so no
text or token list ever passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneflow.operators.windows import col_of

# Fixed patterns (must equal the reference's for right results).
WORD_PATTERN = "[A-Za-z][A-Za-z']*"
URL_PATTERN = r"(((http[s]{0,1}|ftp)://)[a-zA-Z0-9\.\-]+\.([a-z]|[A-Z]|[0-9]|[/.]|[~]|[\-])*)"
TOKEN_SEPARATORS = "[ \t]"


def words(text) -> Column:
    """FN-4: array of words — runs of ``[A-Za-z][A-Za-z']*`` — upper-cased.

    The match runs before ``upper`` (``upper('ß')`` would produce ASCII letters).
    """
    return F.transform(F.regexp_extract_all(col_of(text), F.lit(WORD_PATTERN), 0),
                       lambda w: F.upper(w))


def explode_words(df: DataFrame, text: str = "text", out: str = "word",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """UDF-2 flat-map: one row per word, upper-cased after the explode (inside codegen)."""
    raw = F.regexp_extract_all(col_of(text), F.lit(WORD_PATTERN), 0)
    return df.select(*keep, F.explode(raw).alias(out)).select(*keep, F.upper(out).alias(out))


def lines(text, chunked: bool = False) -> Column:
    """FN-5: non-empty lines of a text.

    ``chunked=True`` treats the text as an arbitrary chunk of a larger stream: the
    first (possibly partial) line and the last line without a terminating newline
    are skipped.
    """
    parts = F.split(col_of(text), "\n")
    if chunked:
        n = F.size(parts)
        parts = F.when(n > 2, F.slice(parts, 2, n - 2)).otherwise(F.array().cast("array<string>"))
    return F.filter(parts, lambda s: F.length(s) > 0)


def find_all(text, pattern: str, group: int = 0) -> Column:
    """FN-6: every match (``group`` 0) or capture group of ``pattern``."""
    return F.regexp_extract_all(col_of(text), F.lit(pattern), group)


def find_all_with_groups(text, pattern: str, groups: int) -> Column:
    """FN-6: array of structs (0: match, 1 … N: groups) for every match of ``pattern``.

    The text is matched once; the groups come from each match by itself, which is the
    same for a pattern without look-around.
    """
    each = lambda m: F.struct(m.alias("0"), *[F.regexp_extract(m, pattern, g).alias(str(g)) for g in range(1, groups + 1)])
    return F.transform(F.regexp_extract_all(col_of(text), F.lit(pattern), 0), each)


def count_substring(text, s: str) -> Column:
    """FN-7: non-overlapping occurrences of literal ``s`` (left to right)."""
    t = col_of(text)
    return F.call_function("div", F.length(t) - F.length(F.replace(t, F.lit(s), F.lit(""))),
                           F.lit(len(s)))


def substring_matches(text, s: str) -> Column:
    """FN-7: array with one element ``s`` per non-overlapping occurrence."""
    return F.array_repeat(F.lit(s), count_substring(text, s).cast("int"))


def tokens(text) -> Column:
    """FN-8 tokenizer: split on single spaces and tabs (empty tokens kept)."""
    return F.split(col_of(text), TOKEN_SEPARATORS)


def keyword_score_column(text, pairs: list[tuple[str, int]]) -> Column:
    """FN-8 as one per-row expression for a bounded literal dictionary: the sum of the
    scores of the text's space/tab tokens (map lookup per token, 0 when absent).

    No explode, join or shuffle: the dictionary is a literal map inside the expression, and only
    the tokens in its key set (a hash lookup) are looked up in it.
    """
    m = F.create_map(*[x for w, sc in pairs for x in (F.lit(w), F.lit(int(sc)).cast("long"))])
    hits = F.filter(tokens(text), lambda t: t.isin([w for w, _ in pairs]))
    return F.aggregate(hits, F.lit(0).cast("long"), lambda acc, t: acc + F.try_element_at(m, t))


def keyword_score(df: DataFrame, dictionary: DataFrame, id_cols: list[str],
                  text: str = "text", out: str = "score") -> DataFrame:
    """FN-8 for a dictionary given as a table (``word, score``): per record, the sum of
    dictionary scores of its space/tab tokens.

    Tokens are exploded in place and joined to the dictionary, which is broadcast only
    behind a size check; use :func:`keyword_score_column` for literal dictionaries.  Records without any
    dictionary token get score 0.  The one shuffle carries a partial sum per record.
    """
    toks = df.select(*id_cols, F.explode_outer(tokens(text)).alias("word"))
    from paneflow.operators.joins import checked_broadcast
    return toks.join(checked_broadcast(dictionary), "word", "left").groupBy(*id_cols) \
               .agg(F.coalesce(F.sum("score"), F.lit(0)).cast("long").alias(out))
