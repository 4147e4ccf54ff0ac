"""Document fingerprints from statistically improbable byte windows.

Every window of 64 bytes has an entropy, scaled to 0..1000.  A first pass counts these
entropies over all windows of all documents; the rarer an entropy is in the corpus, the
earlier its windows rank (windows of very low entropy rank last).  Within a text, each run of
64 neighbouring windows votes for its best-ranked window, leftmost on ties, and windows
with ``POPULAR`` votes or more are the text's features.  Features go, in order, into a chain of
Bloom filters of 2048 bits, 160 features each; the filters are the fingerprint.

Likeness compares filters by their common bits, normalised between the overlap that chance
gives and the largest one possible; each filter of the shorter chain counts with its best
partner, weighted by its features.

The kernel works on the bytes of a block of texts at once.  The entropy of neighbouring windows
differs by one byte that leaves and one that enters, so it needs only how often
these two occur in their windows: 63 shifted comparisons give that for all positions.

Defined results: a null or empty text has an empty fingerprint; two empty ones have
likeness 1, an empty and another one 0.  Every text is led by 48 zero bytes (and filled up
with zeros to one window), so short texts have windows too.  Documents are ordered by (doc_id, hash of the text), null ids first; repeated rows
follow each other.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.llm.common import blocks, parallelism, ship, text_of, texts_of

WINDOW = 64
BINS = 1001
WEAK = 100          # entropies below this rank last
POPULAR = 4
FILTER_BITS = 2048
PER_FILTER = 160
HASHES = 5
ALPHA = 0.15         # share of the possible overlap that counts as none
LEAD = bytes(48)    # zeros before a text: short texts get windows over their first bytes too
SCALE = 1 << 20
BLOCK = 1 << 20     # bytes of text in one kernel call, unless a text is longer
KERNEL = 1 << 16    # positions per comparison round: stays in cache

_COUNT = np.arange(WINDOW + 1)
_GAIN = np.round(_COUNT * np.log2(np.maximum(_COUNT, 1)) * SCALE).astype(np.int64)
_STEP = np.diff(_GAIN, prepend=0)
_FULL = 6 * WINDOW * SCALE


def entropies(t: np.ndarray) -> np.ndarray:
    """Scaled entropy of the window at each position of ``t`` (len(t) - 63 of them)."""
    n = len(t)
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for a in range(0, n, KERNEL):
        part = t[a:a + KERNEL + WINDOW - 1]
        own = min(KERNEL, n - a)
        for k in range(1, WINDOW):
            same = (part[:max(0, len(part) - k)] == part[k:])[:own].view(np.uint8)
            ahead[a:a + len(same)] += same
            behind[a + k:a + k + len(same)] += same
    first = int(_GAIN[np.bincount(t[:WINDOW], minlength=256)].sum())
    change = _STEP[behind[WINDOW:]] - _STEP[ahead[:n - WINDOW]]
    total = np.concatenate([[first], first + np.cumsum(change)])
    return (1000 * (_FULL - total)) // _FULL


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the led texts end to end; begin and end of each."""
    padded = [(LEAD + x).ljust(WINDOW, b"\0") for x in texts]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(size)
    return np.frombuffer(b"".join(padded), np.uint8), ends - size, ends


def count_entropies(texts: list[bytes]) -> np.ndarray:
    """Windows of each entropy in the texts."""
    t, begin, end = _layout([x for x in texts if x])
    if not len(t):
        return np.zeros(BINS, np.int64)
    e = entropies(t)
    inside = np.zeros(len(e) + 1, np.int64)
    inside[begin] += 1
    np.add.at(inside, end - WINDOW + 1, -1)
    return np.bincount(e[np.cumsum(inside[:-1]) > 0], minlength=BINS)


def rank_table(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy: the rarest first, weak ones last."""
    order = np.lexsort((np.arange(BINS), counts, np.arange(BINS) < WEAK))
    table = np.empty(BINS, np.int64)
    table[order] = np.arange(BINS)
    return table


class Digest:
    """A chain of Bloom filters: ``bits`` (filters x 32 words of 64), features in each."""

    __slots__ = ("bits", "features", "ones")

    def __init__(self, bits: np.ndarray, features: np.ndarray):
        self.bits, self.features = bits, features
        self.ones = np.bitwise_count(bits).sum(axis=1).astype(np.int64)

    def text(self) -> str:
        return base64.b64encode(self.bits.tobytes()).decode()


def digests(texts: list[bytes], ranks: np.ndarray) -> list[Digest]:
    """The digest of each text."""
    out = [Digest(np.zeros((0, FILTER_BITS // 64), np.uint64), np.zeros(0, np.int64))] * len(texts)
    used = [i for i, x in enumerate(texts) if x]
    if not used:
        return out
    t, begin, end = _layout([texts[i] for i in used])
    n = len(t) - WINDOW + 1
    shift = np.int64(len(t)).item().bit_length()
    worst = np.int64(BINS << shift)
    v = (ranks[entropies(t)] << shift) | np.arange(n)
    inside = np.zeros(n + 1, np.int8)
    inside[begin] += 1
    np.add.at(inside, end - WINDOW + 1, -1)
    valid = np.cumsum(inside[:-1], dtype=np.int8) > 0
    v[~valid] = worst
    best = np.concatenate([v, np.full(WINDOW - 1, worst)])
    for s in (1, 2, 4, 8, 16, 32):
        best = np.minimum(best[:-s], best[s:])
    votes = np.bincount((best[:n] & ((1 << shift) - 1))[valid], minlength=n)
    # a text without a popular window keeps the one with most votes
    top = np.maximum.reduceat(votes, begin)
    need = np.minimum(top, POPULAR)
    count = end - begin
    at = np.flatnonzero(votes >= np.repeat(need, count)[:n])
    at = at[valid[at]]
    words = np.lib.stride_tricks.sliding_window_view(t, WINDOW)[at].view(np.uint64)
    h = np.full(len(at), 0x243F6A8885A308D3, np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    doc = np.searchsorted(begin, at, "right") - 1
    per_doc = np.bincount(doc, minlength=len(used))
    place = np.arange(len(at)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    filters = -(-per_doc // PER_FILTER)
    base = np.cumsum(filters) - filters
    which = base[doc] + place // PER_FILTER
    flags = np.zeros((int(filters.sum()), FILTER_BITS), np.uint8)
    for k in range(HASHES):
        flags[which, ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    bits = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
    held = np.bincount(which, minlength=len(flags))
    for j, i in enumerate(used):
        out[i] = Digest(bits[base[j]:base[j] + filters[j]], held[base[j]:base[j] + filters[j]])
    return out


def likeness(a: Digest, b: Digest) -> float:
    """Normalised overlap of two digests, 0 to 1."""
    if not len(a.bits) or not len(b.bits):
        return float(len(a.bits) == len(b.bits))
    if len(a.bits) > len(b.bits):
        a, b = b, a
    best = np.zeros(len(a.bits))
    back = np.zeros(len(b.bits))
    for i in range(len(a.bits)):  # one filter against a chain: memory follows the longer digest
        common = np.bitwise_count(a.bits[i] & b.bits).sum(axis=1).astype(float)
        most = np.minimum(a.ones[i], b.ones)
        chance = a.ones[i] * b.ones / FILTER_BITS
        low = ALPHA * (most - chance) + chance
        score = np.clip((common - low) / np.maximum(most - low, 1e-9), 0, 1)
        best[i] = score.max()
        back = np.maximum(back, score)
    one = float((best * a.features).sum() / a.features.sum())
    if len(a.bits) < len(b.bits):
        return one
    return (one + float((back * b.features).sum() / b.features.sum())) / 2


def corpus_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Entropy ranks over all windows of all documents: 1001 sums reach the driver."""
    ship(docs.sparkSession)

    def run(batches):
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for part in blocks(batch, 0, BLOCK):
                total += count_entropies([x.encode() for x in texts_of(part.column(0))])
        bins = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), pa.array(total[bins], pa.int64())], names=["bin", "n"])

    found = docs.select(text_of(text).alias("t")).mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BINS, np.int64)
    for r in found:
        counts[r["bin"]] = r["n"]
    return rank_table(counts)


def fingerprints(df: DataFrame, ranks: np.ndarray, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns of ``df`` plus ``out``: the fingerprint as base64 text.  Narrow."""
    ship(df.sparkSession)
    df = df.drop(out)
    at, names = df.columns.index(text), [*df.columns, out]

    def run(batches):
        for batch in batches:
            for part in blocks(batch, at, BLOCK):
                prints = digests([x.encode() for x in texts_of(part.column(at))], ranks)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([d.text() for d in prints], pa.string())], names=names)

    return df.mapInArrow(run, df.schema.add(out, "string"))


def in_order(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` (doc_id, text) dealt into ranges of doc_id and sorted, one range per partition.

    The first documents of a range are also sent to the range before it (the very first to
    the last one) and sort to its end with ``guest`` = 1, so every document's successor is
    at hand.  Cut points are ids of the table: n + 1 numbers at most.
    """
    lowest = -(2**63)
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(lowest)).alias("key"))
    # approxQuantile goes through doubles: the smallest id in each of its intervals is the cut
    probes = np.array(sorted({int(p) for p in keyed.select(F.col("key").cast("double").alias("k")).approxQuantile(
        "k", [i / n for i in range(n)], 0.2 / n)}), dtype=np.int64)

    @F.pandas_udf("int")
    def interval(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(probes, key.to_numpy(), "right"))

    firsts = keyed.select("key").groupBy(interval("key").alias("i")).agg(F.min("key").alias("k")).collect()
    cuts = np.array(sorted(r["k"] for r in firsts) or [lowest], np.int64)
    ranges = len(cuts)

    @F.pandas_udf("long")
    def where(key: pd.Series) -> pd.Series:
        at = np.maximum(np.searchsorted(cuts, key.to_numpy(), "right") - 1, 0)
        return pd.Series(2 * at + (cuts[at] == key.to_numpy()))  # odd: the key opens its range

    w = keyed.withColumn("w", where("key"))
    own = F.floor(F.col("w") / 2).cast("int")
    stay = F.struct(own.alias("range"), F.lit(0).alias("guest"))
    visit = F.struct(F.pmod(own - 1, F.lit(ranges)).cast("int").alias("range"), F.lit(1).alias("guest"))
    sent = w.select("doc_id", "text", "key", F.explode(F.when(F.col("w") % 2 == 1, F.array(stay, visit)).otherwise(F.array(stay))).alias("to"))
    return (sent.select("doc_id", "text", "key", F.col("to.range").alias("range"), F.col("to.guest").alias("guest"))
            .repartitionById(ranges, F.col("range"))
            .sortWithinPartitions("guest", "key", F.xxhash64(text_of())))


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns: each document against its edited text and its successor."""
    spark = docs.sparkSession
    ship(spark)
    ranks = corpus_ranks(docs)
    ordered = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), parallelism(spark))
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
              ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def run(batches):
        held = None  # (doc_id, text, digest) still without its successor
        for batch in batches:
            for part in blocks(batch, 1, BLOCK):
                texts = texts_of(part.column(1))
                row = [*part.column(0).to_pylist()]
                guest = part.column(2).to_pylist()
                ids, whole = ([held[0]] if held else []) + row, ([held[1]] if held else []) + texts
                last = guest.index(1) if 1 in guest else len(texts) - 1  # the successor that ends this range
                n = last + bool(held)  # documents that have their successor now
                edited = []
                for x, y in zip(whole[:n], whole[1:n + 1], strict=True):
                    k = len(x) // 4
                    edited.append(x[:len(x) - k] + y[:k])
                raw = [x.encode() for x in edited]
                prints = digests([x.encode() for x in texts[:last + 1]] + raw, ranks)
                own = ([held[2]] if held else []) + prints[:last + 1]
                other = prints[last + 1:]
                out = [(ids[i], len(whole[i]), hashlib.sha256(raw[i]).hexdigest(), own[i].text(), other[i].text(),
                        likeness(own[i], other[i]), likeness(own[i], own[i + 1])) for i in range(n)]
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])
                if 1 in guest:
                    held = None
                    break
                held = (ids[-1], whole[-1], own[-1])
            else:
                continue
            break

    return ordered.select("doc_id", "text", "guest").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
