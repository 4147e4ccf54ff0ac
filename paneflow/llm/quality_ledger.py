"""Quality rules as a bitmask ledger (native: DataFrame functions only).

Every rule is evaluated once per document.  The ledger row keeps the measurements the
rules read and one ``failed_bits`` long in which bit *i* is set when rule *i* fails.
Policies are versioned masks over those bits: applying another policy version, or asking
what a rule alone rejects (an ablation), is bit arithmetic on the ledger and never reads
a text again.

Defined results: a null or empty text has no words, fails ``few_words`` and is rejected.
A null ``doc_id`` is kept as it is.  Repeated rows give repeated ledger rows.  Input
columns whose names clash with a ledger column are not carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneflow.llm.common import WS, text_of

NGRAM = 8
SYMBOLS = "[#*$%&|<>]"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_upper", "n_shouts", "n_lines", "n_distinct_words", "n_stutters")


def _c(name: str) -> Column:
    return F.col(name)


def rules() -> list[tuple[str, Column]]:
    """(bit name, failure condition over the measurements); the position is the bit number.
    Ratios are cross-multiplied integers, so a verdict never depends on rounding.  New rules are appended, so a stored ledger keeps its meaning."""
    return [
        ("few_words", _c("n_words") < 20),
        ("repeated_windows", 100 * _c("n_repeat_words") > 30 * _c("n_words")),
        ("many_symbols", 10 * _c("n_symbols") > 3 * _c("n_words")),
        ("upper_case", 2 * _c("n_upper") > _c("word_chars")),
        ("shouting", 5 * _c("n_shouts") > _c("n_words")),
        ("duplicate_lines", 100 * _c("n_dup_lines") > 60 * _c("n_lines")),
        ("short_words", _c("word_chars") < 2 * _c("n_words")),
        ("long_words", _c("word_chars") > 25 * _c("n_words")),
        ("few_distinct_words", 20 * _c("n_distinct_words") < F.least(_c("n_words"), F.lit(1000))),
        ("stuttering", 10 * _c("n_stutters") > 3 * _c("n_words")),
    ]


#: Policy versions: the rules that reject a document.  A version is never edited.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols", "upper_case", "shouting",
           "duplicate_lines", "short_words", "long_words", "few_distinct_words", "stuttering"),
}


def mask(version: str) -> int:
    """The policy's rules as a bit mask."""
    bit = {name: i for i, (name, _) in enumerate(rules())}
    return sum(1 << bit[r] for r in POLICIES[version])


def _measure(df: DataFrame, text: str) -> DataFrame:
    """Measurement columns.  Stages are separate projections so that each array is
    built once: the optimizer does not inline an expression that is used several times."""
    t = "__text"
    df = df.withColumn(t, text_of(text))
    df = df.withColumn("__parts", F.split(t, WS, -1))
    df = df.withColumn("__lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("__words", F.array_remove("__parts", F.lit("")))
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": (F.char_length(t) - (F.size("__parts") - 1)).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
        "n_shouts": F.regexp_count(t, F.lit("!!")).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_distinct_words": F.size(F.array_distinct("__words")).cast("long"),
        "n_stutters": F.size(F.filter("__words", lambda x, i: x == F.get("__words", i - 1))).cast("long"),
        # A window of words is one 64-bit hash chained over its words.
        "__grams": F.when(
            F.size("__words") >= NGRAM,
            F.transform(F.sequence(F.lit(0), F.greatest(F.size("__words") - NGRAM, F.lit(0))),
                        lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(NGRAM)])),
        ).otherwise(F.array().cast("array<bigint>")),
    })
    # Only documents that repeat a window pay for sorting (hash, position).
    df = df.withColumn("__sorted", F.when(
        F.size(F.array_distinct("__grams")) < F.size("__grams"),
        F.sort_array(F.transform("__grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    s = F.col("__sorted")
    repeated = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    df = df.withColumn("__starts", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    # A repeated window at p adds min(8, p - previous p) words to the covered ones.
    covered = F.aggregate(
        "__starts",
        F.struct(F.lit(-NGRAM).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("last"),
                              (a["n"] + F.least(F.lit(NGRAM), x - a["last"])).cast("long").alias("n")),
        lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    # A one-row generator fences the measurements off: a filter above it cannot be pushed
    # below, where it would repeat the whole expression for each array element.
    rest = [c for c in df.columns if c not in MEASURES and not c.startswith("__")]
    return df.select(*[F.col(f"`{c}`") for c in [*rest, *(x for x in ("__row",) if x in df.columns)]],
                     F.inline(F.array(F.struct(*MEASURES))))


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, all measurements and ``failed_bits``: one row per document."""
    src = docs.select(*[F.col(c) for c in keep if c not in MEASURES],
                      F.col(text).alias("__in"))
    out = _measure(src, "__in").drop("__in")
    bits = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("failed_bits", bits)


def failed(version: str, bits: str = "failed_bits") -> Column:
    """Does the document fail any rule of the policy version?"""
    return F.col(bits).bitwiseAND(F.lit(mask(version)).cast("long")) != 0


def ablations(ledger_df: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: documents it rejects, and those that only it rejects
    (they would come back if the rule were dropped).

    The ledger collapses to one row per distinct bit pattern on the map side (at most
    2^rules rows), and the per-rule counts are conditional sums over the patterns.
    """
    m = F.lit(mask(version)).cast("long")
    patterns = ledger_df.groupBy(F.col("failed_bits").bitwiseAND(m).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    names = [(i, name) for i, (name, _) in enumerate(rules()) if mask(version) >> i & 1]
    one = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                              for i, name in names])).alias("r")
    return (patterns.select("bits", "n", one)
            .groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("rejected"),
                 F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only_by_it")))


def keep_passing(docs: DataFrame, text: str = "text", version: str = "v1") -> DataFrame:
    """The rows of ``docs``, unchanged, that pass the policy.  Narrow: no shuffle."""
    src = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    scored = ledger(src, text, keep=("__row",))
    return scored.where(~failed(version)).select("__row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns."""
    out = ledger(docs)
    base = failed("base")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base.alias("base_failed"), (~base & ~failed("v1")).alias("kept"), "failed_bits")
