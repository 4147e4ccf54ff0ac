"""Packing documents into fixed windows by best-fit decreasing with a segment tree.

1. ``pieces``: every document is tokenized whole, closed by the end id, and cut into full
   windows and a remainder.  Only the pieces' lengths and checksums leave the task.
2. The pieces are dealt at random over groups of about ``GROUP_ROWS`` rows.  The group count
   follows the input, so a group fits one task at any scale; a group of that size pads
   as little as one global packing would, since best-fit decreasing wastes a few windows per
   group.
3. ``pack``: inside a group the longest piece goes first, into the open window with the
   least remaining capacity that still holds it.  A segment tree over the capacities
   finds that window in log2(window) steps; without one, a new window opens.

The tokenizer is a public library's; a text is cut at blanks and line feeds, where its
pattern always cuts, and each distinct chunk is encoded once per task (bounded memo).

Defined results: a null or empty text is one piece that holds only the end id; repeated
rows are packed once each; null ids are ids like any other; an empty table gives no rows; extra
input columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.llm.common import blocks, durable, ship, spread

WINDOW = 4096
END_ID = 2
GROUP_ROWS = 20_000
MEMO_CHUNKS = 1_000_000
SEPARATOR = "~"
MARKS = (".", ",", ";", ":", "!", "?")
SEED = 41

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def plain_word(x: str) -> bool:
    """Lower-case Latin letters only: the tokenizer's normaliser and pattern keep it whole."""
    return x.isalpha() and x.islower() and max(x) < "\u0250"


class ChunkEncoder:
    """Ids of whole texts through a memo of blank-separated chunks."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task owns one core
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        # added tokens are found in the raw text, before it is lower-cased and cut, across blanks too
        self.added = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        # the same vocabulary and merges for words that normalising and splitting leave as they are
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.begin, self.count = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks.  A Latin word with one closing mark is the word's ids and the
        mark's (the tokenizer's pattern always cuts between them), so the word is encoded once."""
        split = {x: x[:-1] for x in chunks if x[-1:] in MARKS and plain_word(x[:-1])}
        fresh = dict.fromkeys(x for x in (*split.values(), *MARKS, *(c for c in chunks if c not in split)) if x not in self.memo)
        words = [x for x in fresh if plain_word(x)]
        self._encode(words, self.words)
        self._encode([x for x in fresh if not plain_word(x)], self.tokenizer)
        if split:
            word = np.fromiter((self.memo[w] for w in split.values()), np.int64, len(split))
            mark = np.fromiter((self.memo[x[-1]] for x in split), np.int64, len(split))
            both = np.stack([word, mark], axis=1).ravel()
            self._add(list(split), self.flat[spread(self.begin[both], self.count[both])], self.count[word] + self.count[mark])

    def _add(self, names: list[str], flat: np.ndarray, count: np.ndarray) -> None:
        self.memo.update(zip(names, range(len(self.memo), len(self.memo) + len(names)), strict=True))
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat])
        self.begin = np.cumsum(self.count) - self.count

    def _encode(self, chunks: list[str], tokenizer) -> None:
        """Through the tokenizer: many chunks per call, with a separator whose id no other chunk
        can give (the id stands for a piece that ends in the separator's own bytes)."""
        plain = [x for x in chunks if SEPARATOR not in x]
        odd = [x for x in chunks if SEPARATOR in x]
        (mark,) = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        lines = [plain[k:k + 256] for k in range(0, len(plain), 256)]
        got = tokenizer.encode_batch_fast([f" {SEPARATOR} ".join(x) + f" {SEPARATOR}" for x in lines], add_special_tokens=False)
        flat = np.concatenate([np.empty(0, np.uint32), *[np.array(x.ids, dtype=np.uint32) for x in got]])
        counts = np.diff(np.flatnonzero(flat == mark), prepend=-1) - 1
        rest = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32) for x in odd]
        self._add(plain + odd, np.concatenate([flat[flat != mark], *rest]), np.concatenate([counts, np.array([len(x) for x in rest], np.int64)]))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text as the tokenizer gives them, without special tokens around it.  The
        tokenizer lower-cases, so A-Z are lowered before the distinct chunks are looked up; texts
        that hold an added token are encoded whole."""
        texts = pc.fill_null(texts, "")
        low = pc.ascii_lower(texts)
        whole = np.zeros(len(texts), bool)
        for x in self.added:
            whole |= pc.match_substring(low, x).to_numpy(zero_copy_only=False)
        if whole.any():
            at = np.flatnonzero(whole)
            got = self.tokenizer.encode_batch_fast([texts[int(i)].as_py() for i in at], add_special_tokens=False)
            ids = self._chunked(pc.if_else(pa.array(whole), "", low))
            for i, x in zip(at, got, strict=True):
                ids[i] = np.array(x.ids, np.uint32)
            return ids
        return self._chunked(low)

    def _chunked(self, low: pa.Array) -> list[np.ndarray]:
        cut = pc.split_pattern(pc.replace_substring(low, "\n", " "), " ")
        each = cut.flatten().dictionary_encode()
        distinct = each.dictionary.to_pylist()
        if len(self.memo) + len(distinct) > MEMO_CHUNKS:
            self.forget()
        which = np.fromiter((self.memo.get(x, -1) for x in distinct), np.int64, len(distinct))
        if new := [distinct[i] for i in np.flatnonzero(which < 0)]:
            self.learn(new)
            which = np.fromiter(map(self.memo.__getitem__, distinct), np.int64, len(distinct))
        which = which[each.indices.to_numpy()]
        count = self.count[which]
        ids = self.flat[spread(self.begin[which], count)]
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(cut.value_lengths().to_numpy())])]
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]


_ENCODERS: dict[str, ChunkEncoder] = {}


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it starts in its document, its length and checksum.

    ``with_ids`` adds the ids themselves (array<int>).
    """
    ship(docs.sparkSession)
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches):
        enc = _ENCODERS.get(path) or _ENCODERS.setdefault(path, ChunkEncoder(path))
        for batch in batches:
            for part in blocks(batch, 1):
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1)), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(ids), window):
                        x = ids[at:at + window]
                        rows.append((doc, at, len(x), zlib.crc32(x.tobytes()), len(ids), *([x.astype(np.int32)] if with_ids else [])))
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.list_(pa.int32())) for c in cols[5:]]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class CapacityTree:
    """Segment tree over remaining capacities 0..window: ``tightest(n)`` is the smallest
    capacity of at least ``n`` that an open window has."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open = [0] * (2 * self.leaves)  # open windows below each node
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, capacity: int, by: int) -> None:
        k = self.leaves + capacity
        while k:
            self.open[k] += by
            k >>= 1

    def add(self, capacity: int, window: int) -> None:
        if capacity:
            self.windows[capacity].append(window)
            self._count(capacity, 1)

    def tightest(self, n: int) -> int | None:
        k = self.leaves + n
        if not self.open[k]:
            while k > 1 and (k & 1 or not self.open[k + 1]):  # up until a right sibling has one
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.open[2 * k] else 2 * k + 1
        return k - self.leaves

    def take(self, capacity: int) -> int:
        self._count(capacity, -1)
        return self.windows[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset in it) of each piece."""
    tree, opened = CapacityTree(window), 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        capacity = tree.tightest(n)
        if capacity is None:
            capacity, w = window, opened
            opened += 1
        else:
            w = tree.take(capacity)
        where[i], offset[i] = w, window - capacity
        tree.add(capacity - n, w)
    return where, offset


def pack(piece_rows: DataFrame, window: int = WINDOW, group_rows: int = GROUP_ROWS, seed: int = SEED) -> DataFrame:
    """``piece_rows`` plus ``sequence_id`` and ``offset``.

    ``piece_rows`` must be stored (a table or a checkpoint): the rows are numbered where
    they lie and dealt over the groups by the seeded hash of that number, so repeated rows spread too.
    """
    ship(piece_rows.sparkSession)
    groups = max(1, -(-piece_rows.count() // group_rows))
    dealt = piece_rows.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        where, offset = best_fit_decreasing(pdf["length"].to_numpy(), window)
        out = pdf.drop(columns="g")
        out["sequence_id"] = (pdf["g"].to_numpy().astype(np.int64) << 32) + where
        out["offset"] = offset
        return out

    return dealt.repartitionById(groups, F.col("g")).groupBy("g").applyInPandas(run, PIECES + ", sequence_id long, offset long")


def packed(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Placements of all pieces of ``docs``.  The pieces are checkpointed: tokenizing is the
    costly part and must not run again when an executor is lost."""
    return pack(durable(pieces(docs, path, window)), window)


def sequences(docs: DataFrame, placements: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The sequences themselves: (sequence_id, ids), pieces in offset order, not yet padded.
    At most ``window`` ids meet in a group."""
    ids = pieces(docs, path, window, end_id, with_ids=True).select("doc_id", "start", "ids_crc32", "ids").distinct()
    return (placements.join(ids, ["doc_id", "start", "ids_crc32"])
            .groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")))
