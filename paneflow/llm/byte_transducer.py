"""Filter interaction audit on measures of one byte pass.

A finite-state transducer reads the UTF-8 bytes of a block of texts once.  Its state says
whether a word is open; a table maps (state, byte class) to output flags: word begins, word
ends, code point, capital, symbol.  The next state depends on the byte alone, so all transitions
of a block are one table lookup.  The word spans go into an open-addressing hash table:
all pending words claim or inspect a slot each round, and a word counts as seen only after its
bytes were compared with the span that holds the slot (verified), else it moves on a slot.

``measures`` gives the numbers per text; ``failures`` adds the bits of the five filters; ``audit``
applies the filters in all 120 orders.  Identical texts are told apart by SHA-256.  A document
is reduced to (part, failure bits, labels) before anything is multiplied by orders: an order
works on at most 32 bit patterns per part and label, whatever the number of documents.

Scale: texts never leave the scan's tasks.  Narrow rows are joined to the labels (one row per
document) and to the texts that occur more than once, both stored first, so that AQE can
split a hot text or id.

Defined results: a null text is empty (without words and code points it fails A, never B, C or
D, and E like any other text), a null ``lang`` is the part ''.  A document without an id
is never later than another one and makes no other one later; rows with one id and one
text do not fail E for each other.  A document's label is the maximum of its label rows;
null labels and documents without one count as neither.  Very long texts are read in pieces cut
at white space, whose distinct words are then read together.  An empty table has no parts and no rows.
"""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.llm.common import blocks, ship, stored, text_of

FILTERS = "ABCDE"
MIN_WORDS = 200            # A: fewer words fail
MIN_DISTINCT_PERCENT = 50  # B: fewer distinct words in 100 words fail
MAX_CAPITAL_PERCENT = 3    # C: more A-Z in 100 code points fail
SYMBOLS = b"#$%&*|"        # D: any of them fails

WHITE, CAPITAL, SYMBOL, CONTINUATION, OTHER = range(5)
OUTSIDE, INSIDE = 0, 1
BEGINS, ENDS, POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8, 16
BLOCK = 1 << 20            # bytes of texts per pass, unless a single piece is longer
PIECE = 4 << 20            # longer texts are read in pieces
SHORT = 64                 # words up to this length are hashed and compared 8 bytes a round


def _classes() -> np.ndarray:
    c = np.full(256, OTHER, np.uint8)
    c[[0x20, *range(0x09, 0x0E)]] = WHITE
    c[ord("A"):ord("Z") + 1] = CAPITAL
    c[list(SYMBOLS)] = SYMBOL
    c[0x80:0xC0] = CONTINUATION
    return c


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state by class, output flags by state and class)."""
    after = np.array([INSIDE] * 5, np.uint8)
    after[WHITE] = OUTSIDE
    out = np.zeros((2, 5), np.uint8)
    for c in range(5):
        out[OUTSIDE, c] |= BEGINS * (c != WHITE)
        out[INSIDE, c] |= ENDS * (c == WHITE)
        out[:, c] |= POINT * (c != CONTINUATION) | IS_CAPITAL * (c == CAPITAL) | IS_SYMBOL * (c == SYMBOL)
    return after, out


CLASS = _classes()
AFTER, FLAGS = _transitions()
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class Words:
    """Word spans of a block: begin, length, text number; hashed and compared on the bytes."""

    def __init__(self, raw: bytes, begin: np.ndarray, size: np.ndarray, text: np.ndarray):
        self.raw, self.begin, self.size, self.text = raw, begin, size, text
        t = np.frombuffer(raw + bytes(8), np.uint8)
        self.eight = np.ndarray((len(raw) + 1,), "<u8", t, 0, (1,))  # the 8 bytes from each place on
        self.hash = self._hashes()

    def _load(self, place: np.ndarray, left: np.ndarray) -> np.ndarray:
        return self.eight[place] & _LOW[np.minimum(left, 8)]

    def _hashes(self) -> np.ndarray:
        h = _mixed(self.text.astype(np.uint64) * _MIX + self.size.astype(np.uint64))
        todo, k = np.flatnonzero(self.size <= SHORT), 0
        while len(todo):
            h[todo] = _mixed(h[todo] ^ self._load(self.begin[todo] + k, self.size[todo] - k))
            k += 8
            todo = todo[self.size[todo] > k]
        for i in np.flatnonzero(self.size > SHORT):
            h[i] ^= np.uint64(hash(self.raw[self.begin[i]:self.begin[i] + self.size[i]]) & 0xFFFFFFFFFFFFFFFF)
        return h

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words ``a`` and ``b`` are words of one text with the same bytes."""
        same = (self.hash[a] == self.hash[b]) & (self.text[a] == self.text[b]) & (self.size[a] == self.size[b])
        todo, k = np.flatnonzero(same & (self.size[a] <= SHORT)), 0
        while len(todo):
            left = self.size[a[todo]] - k
            ok = self._load(self.begin[a[todo]] + k, left) == self._load(self.begin[b[todo]] + k, left)
            same[todo[~ok]] = False
            k += 8
            todo = todo[ok & (left > 8)]
        for i in np.flatnonzero(same & (self.size[a] > SHORT)):
            x, y, n = self.begin[a[i]], self.begin[b[i]], self.size[a[i]]
            same[i] = self.raw[x:x + n] == self.raw[y:y + n]
        return same

    def first_ones(self) -> np.ndarray:
        """Whether each word is the first of its text with its bytes: insertion into the table."""
        n = len(self.begin)
        table = np.full(1 << max(4, (2 * n).bit_length()), -1, np.int64)
        mask = len(table) - 1
        slot = (self.hash & np.uint64(mask)).astype(np.int64)
        first = np.zeros(n, bool)
        pending = np.arange(n)
        while len(pending):
            s = slot[pending]
            free = table[s] < 0
            table[s[free][::-1]] = pending[free][::-1]      # of several claims the earliest stays
            holder = table[s]
            own = holder == pending
            first[pending[own]] = True
            pending, holder = pending[~own], holder[~own]
            pending = pending[~self.equal(pending, holder)]
            slot[pending] = (slot[pending] + 1) & mask
        return first


def read_block(texts: list[bytes]) -> tuple[np.ndarray, Words, np.ndarray]:
    """One pass: (words, distinct words, code points, capitals, symbols as rows; one column per
    text), the word spans, and which of them are first ones."""
    raw = b" ".join(texts) + b" "
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
    begins = np.concatenate([[0], ends[:-1]])
    kind = CLASS[np.frombuffer(raw, np.uint8)]
    state = np.concatenate([[np.uint8(OUTSIDE)], AFTER[kind[:-1]]])
    out = FLAGS[state, kind]
    count = lambda flag: np.add.reduceat((out & flag) != 0, begins, dtype=np.int64)
    start, stop = np.flatnonzero(out & BEGINS), np.flatnonzero(out & ENDS)
    text = np.searchsorted(ends, start, "right")
    words = Words(raw, start, stop - start, text)
    first = words.first_ones()
    n = len(texts)
    return np.stack([np.bincount(text, minlength=n), np.bincount(text[first], minlength=n),
                     count(POINT) - 1, count(IS_CAPITAL), count(IS_SYMBOL)]), words, first


def read_long(text: bytes) -> np.ndarray:
    """The five numbers of a long text: pieces end at white space; the distinct words of all
    pieces, laid end to end, are one text whose distinct words are the text's."""
    total, kept, at = np.zeros(5, np.int64), [], 0
    white = re.compile(rb"[\x20\x09-\x0D]")
    while at < len(text):
        hit = white.search(text, at + PIECE)
        end = hit.end() if hit else len(text)
        got, words, first = read_block([text[at:end]])
        total += got[:, 0]
        kept += [words.raw[b:b + n] for b, n in zip(words.begin[first], words.size[first], strict=True)]
        at = end
    rest = b" ".join(kept)
    # pieces that share no word do not shrink: one pass over all of them then
    more = read_long(rest) if PIECE < len(rest) < len(text) // 2 else read_block([rest])[0][:, 0]
    total[1] = more[1]
    return total


def read_texts(texts: list[bytes]) -> np.ndarray:
    """The five numbers (rows) of each text (columns)."""
    out = np.zeros((5, len(texts)), np.int64)
    short = [i for i, x in enumerate(texts) if len(x) <= PIECE]
    if short:
        out[:, short] = read_block([texts[i] for i in short])[0]
    for i in set(range(len(texts))) - set(short):
        out[:, i] = read_long(texts[i])
    return out


NUMBERS = ("n_words", "n_distinct", "n_points", "n_capitals", "n_symbols")


def measures(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the five numbers of each whole text.  Narrow."""
    ship(docs.sparkSession)
    src = docs.select(*keep, text_of(text).alias("_t"))
    names = [*keep, *NUMBERS]

    def run(batches):
        for batch in batches:
            for part in blocks(batch, len(keep), BLOCK):
                got = read_texts([x.encode() for x in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], *(pa.array(x) for x in got)], names=names)

    schema = src.drop("_t").schema
    for c in NUMBERS:
        schema = schema.add(c, "long")
    return src.mapInArrow(run, schema)


def failures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, part, bits): bit 0 for filter A up to bit 4 for E."""
    named = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                        F.unhex(F.sha2(text_of(text).cast("binary"), 256)).alias("same"), text_of(text).alias("text"))
    m = measures(named, ["doc_id", "part", "same"])
    rules = [F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words"),
             100 * F.col("n_capitals") > MAX_CAPITAL_PERCENT * F.col("n_points"), F.col("n_symbols") > 0]
    bits = sum((F.when(r, 1 << k).otherwise(0) for k, r in enumerate(rules)), F.lit(0))
    rows = stored(m.select("doc_id", "part", "same", bits.alias("own")))
    many = stored(rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") > 1).select("same", "first"))
    later = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return rows.join(many, "same", "left").select("doc_id", "part", (F.col("own") + F.when(later, 16).otherwise(0)).alias("bits"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with ``good`` and ``toxic``, from the label rows of their document."""
    top = stored(labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.join(top, "doc_id", "left").select("part", "bits", zero("good"), zero("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    seen = with_labels(failures(docs), labels).groupBy("part", "bits", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))
    steps = seen.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter_bit = lambda c: F.call_function("shiftleft", F.lit(1), F.ascii(c) - ord("A"))
    steps = steps.withColumn("bit", letter_bit(F.expr("substring(filter_order, step, 1)")))
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0),
                         lambda m, k: m.bitwiseOR(letter_bit(F.col("filter_order").substr(k, F.lit(1)))))
    steps = steps.withColumn("before", before.bitwiseAND(F.bitwise_not("bit")))
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    gone = F.col("bits").bitwiseAND(F.col("before")) != 0
    removed = fails & ~gone
    n = lambda cond, *more: F.sum(F.when(cond, F.col("n") * (more[0] if more else 1)).otherwise(0))
    # of all 120 orders, those in which this filter is the first that the document fails
    share = F.lit(120).cast("long") / F.bit_count("bits")
    return steps.groupBy("part", "filter_order", "step").agg(
        n(~gone & ~fails).alias("kept"), n(removed).alias("removed"), n(fails & gone).alias("redundant"),
        n(F.col("bits") == F.col("bit")).alias("unique_fails"), n(removed & (F.col("good") == 1)).alias("good_lost"),
        n(removed & (F.col("toxic") == 1)).alias("toxic_lost"), n(fails, share.cast("long")).alias("shapley"))
