"""Exact removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` (400) bytes that covers it also starts anywhere else.

Anchors.  Every window of 400 bytes is represented by its minimal k-gram (k = 128, minimal by
hash, leftmost on ties).  Equal windows have the same k-gram at the same place, so windows only need
comparing when their anchors carry the same k-gram.  A document has about one anchor per 137
bytes; each owns a stretch of consecutive windows.  Spark counts the k-grams: an anchor whose
k-gram occurs once owns no repeated window, and that ends most texts here.  Anchors whose
whole owned stretch is the same bytes (copies) are settled by one count as well, and one of
them stands for all.

Merge.  What is left are groups of different contexts around one k-gram.  Each task takes
whole groups and cuts them into shards.  A shard's suffixes (the contexts from the anchor on) are
sorted alone.  The shards are merged by iterative interleave refinement: the interleave
starts as shard after shard, and each pass sorts the rows of its open intervals by the next
eight bytes of the suffixes; the pass at which two neighbours part gives their common
prefix.  That is a radix sort of all suffixes, which would give the same order without the
shards.  From the merged transform, the bytes before the
suffixes (the BWT column), one stable pass per byte extends all suffixes to the left (the LF
mapping) with their common prefixes taken as range minima.  A window is repeated when its
common prefix with a neighbour reaches 400: it lies in a repeated interval.

A group with more contexts than ``GROUP_ROWS`` (a passage in a third of all documents) is cut into
cells of fewer windows; a cell's key is the bytes that all its windows share (337 for 64 windows,
393 for 8, all 400 for 1), so only contexts that agree on far more text meet again.

Defined results: a null or empty text and one under 400 bytes lose nothing; a repeated row repeats
each of its strings; rows with a null ``doc_id`` are documents like others.  Matches never
cross documents.  Extra columns are not read by ``repeated`` and carried by ``remove``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneflow.llm.common import blocks, parallelism, ship, stored, text_of

LENGTH = 400
GRAM = 128
GROUP_ROWS = 2_000
CELLS = (64, 8, 1)       # windows per cell when a group is cut
CHUNK_ROWS = 8_192       # contexts merged at a time, more when a group is larger
SHARD_ROWS = 1_024
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=8) for b in range(256)], dtype=U)
_POS_BITS = 31


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    out[1:] = U(base)
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def anchors(t: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first owned window, last owned window, k-gram hash) of each anchor of the
    texts laid end to end in ``t``; ``ends`` are the texts' ends."""
    none = np.empty(0, np.int64)
    n = len(t)
    if n < LENGTH:
        return none, none, none, none.astype(U)
    term = np.empty(n + 1, U)
    term[0] = 0
    np.cumsum(_VALUE[t] * _powers(_BASE, n), out=term[1:])
    gram = _mix((term[GRAM:] - term[:-GRAM]) * _powers(_INVERSE, n - GRAM + 1))
    low = (gram >> U(_POS_BITS) << U(_POS_BITS)) | np.arange(len(gram), dtype=U)
    width = LENGTH - GRAM + 1
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    at = (low & U((1 << _POS_BITS) - 1)).astype(np.int64)  # anchor of the window that starts here
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:len(at)]
    inside = np.arange(len(at)) + LENGTH <= ends[text]
    start = np.ones(len(at), bool)
    start[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(start)
    last = np.append(first[1:], len(at)) - 1
    own = inside[first]
    first, last = first[own], last[own]
    return at[first], first, last, gram[at[first]]


def context(text: bytes, p: int, lo: int, hi: int) -> bytes:
    """The bytes of the windows that start ``hi`` .. ``lo`` bytes before ``p``."""
    return text[p - hi:p - lo + LENGTH]


# -- merging transforms
def refine(words: np.ndarray, order: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Refine an interleave: (order, common prefix with the row before, in bytes).

    ``words`` are the contexts as big-endian 64-bit symbols.  ``order`` lists the rows bucket after
    bucket.  A pass looks at one symbol of the rows in open intervals only and
    distributes them stably, so rows that agree so far keep the order they came in.
    """
    n, depth = len(order), words.shape[1]
    lcp = np.zeros(n, np.int64)
    head = np.ones(n, bool)
    head[1:] = bucket[order[1:]] != bucket[order[:-1]]
    for h in range(depth):
        closed = head & np.append(head[1:], True)  # an interval of one
        at = np.flatnonzero(~closed)
        if not len(at):
            return order, lcp
        interval = np.cumsum(head)[at]
        symbol = words[order[at], h]
        move = np.lexsort((symbol, interval))
        order[at] = order[at][move]
        symbol = symbol[move]
        same = (interval[1:] == interval[:-1]) & (at[1:] == at[:-1] + 1)
        part = np.flatnonzero(same & (symbol[1:] != symbol[:-1])) + 1
        differ = symbol[part] ^ symbol[part - 1]
        bits = np.floor(np.log2(np.maximum(differ >> U(8), U(1)).astype(float))).astype(np.int64) + 8
        bits = np.where(differ < U(256), 7, bits)
        lcp[at[part]] = 8 * h + (63 - np.minimum(bits, 63)) // 8
        head[at[part]] = True
    lcp[~head] = 8 * depth
    return order, lcp


def shard_order(words: np.ndarray, group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows of one shard in the order of (group, suffix)."""
    rows = rows[np.argsort(group[rows], kind="stable")]
    return refine(words, rows, group)[0]


def merge_shards(words: np.ndarray, group: np.ndarray, shards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted shards into one order of (group, suffix) with common prefixes."""
    interleave = np.concatenate(shards)
    interleave = interleave[np.argsort(group[interleave], kind="stable")]
    return refine(words, interleave, group)


def range_minimum(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum of values[left..right], both included, for many ranges."""
    size = right - left + 1
    out = values[left].copy()
    table, span = values, 1
    level = np.floor(np.log2(size)).astype(np.int64) if len(size) else size
    for k in range(int(level.max(initial=0)) + 1):
        hit = level == k
        out[hit] = np.minimum(table[left[hit]], table[right[hit] - span + 1])
        if k < int(level.max(initial=0)):
            table = np.minimum(table[:-span], table[span:])
            span *= 2
    return out


def repeated_windows(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, contexts: list[bytes]) -> list[tuple[int, int, int]]:
    """(row, from, to): the windows that start ``to`` .. ``from`` bytes before the row's anchor are
    repeated in another row of its group.  ``group`` is ascending."""
    n = len(group)
    deepest = int(hi.max())
    right = np.frombuffer(b"".join([c[h:].ljust(LENGTH, b"\0") for c, h in zip(contexts, hi.tolist(), strict=True)]), np.uint8).reshape(n, LENGTH)
    words = right.view(">u8").astype(U)
    before = np.frombuffer(b"".join([c[:h][::-1].ljust(deepest + 1, b"\0") for c, h in zip(contexts, hi.tolist(), strict=True)]), np.uint8).reshape(n, deepest + 1)
    shards = [shard_order(words, group, np.arange(k, min(n, k + SHARD_ROWS))) for k in range(0, n, SHARD_ROWS)]
    order, lcp = merge_shards(words, group, shards)
    reach = LENGTH - lo  # bytes of context after the anchor
    lcp[1:] = np.minimum(lcp[1:], np.minimum(reach[order[1:]], reach[order[:-1]]))
    found = np.zeros((n, deepest + 2), bool)
    for step in range(deepest + 1):
        best = np.maximum(lcp, np.append(lcp[1:], 0))
        hit = (best >= LENGTH) & (lo[order] <= step)
        found[order[hit], step] = True
        # a common prefix grows by one byte per step at most: drop rows that cannot reach LENGTH
        live = np.flatnonzero((hi[order] > step) & (best + (hi[order] - step) >= LENGTH))
        if not len(live):
            break
        # LF mapping: stable by the byte before each suffix (the BWT column)
        column = before[order[live], step].astype(np.int64) + group[order[live]] * 256
        move = np.argsort(column, kind="stable")
        place, column = live[move], column[move]
        same = np.flatnonzero(column[1:] == column[:-1]) + 1
        new = np.zeros(len(place), np.int64)
        new[same] = 1 + range_minimum(lcp, place[same - 1] + 1, place[same])
        order, lcp = order[place], new
    edge = np.diff(np.pad(found, ((0, 0), (1, 0))).astype(np.int8), axis=1)
    rows, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return list(zip(rows.tolist(), begin.tolist(), (end - 1).tolist(), strict=True))


# -- Spark
def row_key():
    return F.xxhash64(F.col("doc_id"), text_of())


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


ANCHORS = "row long, p int, lo int, hi int, key long, span binary"
CONTEXTS = "row long, p int, lo int, hi int, key long, span binary, ctx binary"
FOUND = "row long, a int, b int"


def anchor_rows(docs: DataFrame) -> DataFrame:
    """One row per anchor of each text: its document row, place, owned windows (``lo`` .. ``hi``
    bytes before it), k-gram and the 128-bit hash of its context."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, 1):
                raw = [x.encode() for x in part.column(1).to_pylist()]
                rows = part.column(0).to_numpy()
                ends = np.cumsum([len(x) for x in raw])
                t = b"".join(raw)
                p, first, last, gram = anchors(np.frombuffer(t, np.uint8), ends)
                if not len(p):
                    continue
                text = np.searchsorted(ends, p, "right")
                lo, hi = p - last, p - first
                span = [xxhash.xxh3_128_digest(t[a:b + LENGTH], seed=x) for a, b, x in zip(first.tolist(), last.tolist(), lo.tolist(), strict=True)]
                begin = ends[text] - np.array([len(x) for x in raw])[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[text], pa.int64()), pa.array(p - begin, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()),
                     pa.array(gram.view(np.int64), pa.int64()), pa.array(span, pa.binary())], names=_names(ANCHORS))

    return docs.select("row", "text").mapInArrow(run, ANCHORS)


def fetch_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (anchor columns) with the bytes of its contexts, cut from the texts."""
    by_row = wanted.groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct("p", "lo", "hi", "key", "span", "alone")).alias("w"))
    joined = docs.join(by_row.hint("shuffle_hash"), F.col("row") == F.col("r")).select("row", "text", "w")

    def run(batches):
        for batch in batches:
            for part in blocks(batch, 1):
                out, seen = [], set()
                for row, text, w in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if row in seen:
                        continue  # a repeated row: its contexts are already out
                    seen.add(row)
                    raw = text.encode()
                    out += [(row if x["alone"] else None, x["p"], x["lo"], x["hi"], x["key"], x["span"], context(raw, x["p"], x["lo"], x["hi"])) for x in w]
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_names(CONTEXTS))

    return joined.mapInArrow(run, CONTEXTS)


def cut_cells(contexts: DataFrame, width: int) -> DataFrame:
    """Contexts cut into cells of ``width`` windows; a cell's key hashes the bytes that all its windows share."""

    def run(batches):
        for batch in batches:
            out = []
            for row, p, lo, hi, key, _, ctx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for cell in range(lo // width, hi // width + 1):
                    a, b = max(lo, cell * width), min(hi, cell * width + width - 1)
                    core = ctx[hi - cell * width:hi - (cell * width + width - 1) + LENGTH]
                    part = ctx[hi - b:hi - a + LENGTH]
                    x = xxhash.xxh3_64_intdigest(core, seed=(key ^ cell) & (2**64 - 1))
                    out.append((row, p, a, b, x - (1 << 64) if x >> 63 else x, xxhash.xxh3_128_digest(part, seed=a), part))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_names(CONTEXTS))

    return contexts.select(*_names(CONTEXTS)).mapInArrow(run, CONTEXTS)


def merge_groups(contexts: DataFrame) -> DataFrame:
    """Repeated windows (row, a, b): starts a .. b of the document row.  Groups of one key come
    together; a context without a row (it stands for copies) is only a partner."""
    n = parallelism(contexts.sparkSession)
    ready = contexts.select(*_names(CONTEXTS)).repartition(n, "key").sortWithinPartitions("key", "span")

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        keys = np.array([x[4] for x in rows])
        group = np.cumsum(np.append(True, keys[1:] != keys[:-1])) - 1
        p = [x[1] for x in rows]
        hits = repeated_windows(group, np.array([x[2] for x in rows]), np.array([x[3] for x in rows]), [x[6] for x in rows])
        out = [(rows[i][0], p[i] - to, p[i] - fro) for i, fro, to in hits if rows[i][0] is not None]
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=_names(FOUND))

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for k in range(0, len(batch), CHUNK_ROWS):
                held += zip(*(c.to_pylist() for c in batch.slice(k, CHUNK_ROWS).columns), strict=True)
                if len(held) >= CHUNK_ROWS:
                    cut = len(held)
                    while cut and held[cut - 1][4] == held[-1][4]:
                        cut -= 1  # the last group may go on
                    if cut:
                        out = solve(held[:cut])
                        held = held[cut:]
                        if out is not None:
                            yield out
        if held:
            out = solve(held)
            if out is not None:
                yield out

    return ready.mapInArrow(run, FOUND)


def repeated(docs: DataFrame) -> DataFrame:
    """(row, a, b): windows starting at bytes a .. b of the document row are repeated.
    ``docs`` has row and text (not null)."""
    ship(docs.sparkSession)
    every = stored(anchor_rows(docs))
    # counts are stored before they are joined: only a join of two plain shuffles can split a hot key
    again = stored(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("key"))
    rows = stored(every.join(again, "key"))
    found = []
    contexts = None
    for width in (None, *CELLS):
        # different contexts per key: copies of a context meet in one row, before the shuffle
        same = ["key", "span"]
        kinds = stored(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("row", "p")).alias("one"), F.first("lo").alias("lo"), F.first("hi").alias("hi")))
        copies = rows.join(kinds.where(F.col("m") > 1).select(*same), same)
        found.append(copies.where(F.col("row").isNotNull()).select("row", (F.col("p") - F.col("hi")).alias("a"), (F.col("p") - F.col("lo")).alias("b")))
        groups = stored(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
        open_kinds = kinds.join(groups, "key").select(*same, "n", (F.col("m") == 1).alias("alone"), F.col("one.row").alias("row"), F.col("one.p").alias("p"), "lo", "hi")
        if width is None:
            contexts = fetch_contexts(docs, open_kinds)
        else:
            one = contexts.join(open_kinds.select(*same, "alone"), same)
            contexts = one.withColumn("row", F.when(F.col("alone"), F.col("row"))).dropDuplicates(same).select(*_names(CONTEXTS))
        contexts = stored(contexts.join(groups, "key").select(*_names(CONTEXTS), "n"))
        small = contexts.where(F.col("n") <= GROUP_ROWS)
        found.append(merge_groups(small))
        large = contexts.where(F.col("n") > GROUP_ROWS)
        following = {None: CELLS[0], **dict(zip(CELLS, CELLS[1:], strict=False))}.get(width)
        if following is None or large.isEmpty():
            break
        contexts = stored(cut_cells(large, following))
        rows = contexts
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))


def removed_runs(starts: list[dict]) -> list[tuple[int, int]]:
    """Maximal removed runs (begin, end) of a document from its repeated windows."""
    runs: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"] + LENGTH) for x in starts or ()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def _with_starts(docs: DataFrame) -> DataFrame:
    keyed = docs.withColumn("row", row_key())
    starts = repeated(keyed.select("row", text_of().alias("text")))
    per_row = starts.groupBy(F.col("row").alias("r")).agg(F.collect_set(F.struct("a", "b")).alias("starts"))
    return keyed.join(per_row.hint("shuffle_hash"), F.col("row") == F.col("r"), "left").drop("row", "r")


def cut(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of the bytes."""
    parts, at = [], 0
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def remove(docs: DataFrame, out: str = "kept") -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) plus ``out``: binary, the bytes that stay.
    A cut may fall inside a character, so the result is bytes, not text."""
    docs = docs.drop(out)
    names = [*docs.columns, out]
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in blocks(batch, at):
                kept = [cut((x or "").encode(), removed_runs(s)) for x, s in zip(part.column(at).to_pylist(), part.column(len(names) - 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(kept, pa.binary())], names=names)

    return _with_starts(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())]))


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns."""
    joined = _with_starts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches):
        for batch in batches:
            for part in blocks(batch, 1):
                out = []
                for doc, text, starts in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    raw, runs = text.encode(), removed_runs(starts)
                    out.append((doc, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(cut(raw, runs)).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_names(schema))

    return joined.select("doc_id", "text", "starts").mapInArrow(run, schema)
