"""Byte-level BPE encoding and decoding with length-bucketed numpy matrices.

A text is cut by the tokenizer's pattern; the distinct pieces of a block of texts are laid
out as padded matrices, one per length bucket (rows are pieces, columns are token ids).
Each round every row merges its leftmost pair of minimum rank: the pair ranks come from a
hash table over (left id, right id), the merged cell replaces the pair, the rest of the row
moves one column to the left, and rows without a mergeable pair leave the matrix
(compaction).  A piece that is a token as a whole is that token, as in the tiktoken library.

Pieces beyond ``MATRIX_BYTES`` bytes (a run of letters without a blank, say) would take one
round per merge over a very wide row; they go through the same merge order with a heap, which is
exact and takes n log n steps.

Texts stay in their partition: there is no shuffle, and a task holds one block of texts
(a few megabytes, or one longer text) plus a bounded memo of pieces.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give
repeated results; extra columns are kept by ``encode`` and ``decode`` unless they carry the
name of the result column, which replaces them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneflow.llm.common import blocks, ship, spread, texts_of

MATRIX_BYTES = 512
MEMO_PIECES = 400_000
NONE = np.int32(2**31 - 1)


class Codec:
    """Rank table, pair hash table and the decoder's byte table of one vocabulary."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex
        self.split = regex.compile(pattern).findall
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.ranks = ranks
        size = max(ranks.values()) + 1
        table = [b""] * size
        for token, r in ranks.items():
            table[r] = token
        self.lengths = np.array([len(x) for x in table], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items()
                 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        p = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        self._fill((p[:, 0] << 32) | p[:, 1], p[:, 2].astype(np.int32))
        self.pair = {(a, b): r for a, b, r in pairs}
        self.decimal = [str(i) for i in range(size)]
        self.forget()

    def forget(self) -> None:
        """Start an empty memo: piece -> number; ids of piece i at ``flat[begin[i]:][:count[i]]``."""
        self.memo: dict[str, int] = {}
        self.flat, self.begin, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    # -- hashed pair lookup: open addressing, a power of two at most half full
    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[at[todo]] == -1
            self.keys[at[todo[free]]] = keys[todo[free]]  # the last of those that meet stays
            placed = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[placed]]] = values[todo[placed]]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges to; ``NONE`` without one."""
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        valid = (left.ravel() >= 0) & (right.ravel() >= 0)
        out = np.full(keys.shape, NONE, dtype=np.int32)
        todo = np.flatnonzero(valid)
        at = self._slot(keys[todo])
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (found != -1)
            todo, at = todo[more], (at[more] + 1) & ((1 << self.bits) - 1)
            if not len(todo):
                break
        return out.reshape(shape)

    # -- merging
    def merge_matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces laid end to end, count of each); all are at most ``width`` bytes."""
        n = len(pieces)
        raw = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in pieces]), dtype=np.uint8).reshape(n, width)
        size = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.where(np.arange(width) < size[:, None], self.byte_id[raw], np.int32(-1)).astype(np.int32)
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:]) if width > 1 else np.empty((n, 0), np.int32)
        rows = np.arange(n)
        final = np.full((n, width), -1, np.int32)
        while len(rows):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), int)  # leftmost minimum
            low = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NONE)
            done = low == NONE
            if done.any():
                final[rows[done], :ids.shape[1]] = ids[done]
                live = ~done
                rows, ids, ranks, size, best, low = (x[live] for x in (rows, ids, ranks, size, best, low))
                if not len(rows):
                    break
                w = int(size.max())
                ids, ranks = ids[:, :w], ranks[:, :w - 1]  # columns nobody uses any more
            k = np.arange(len(rows))
            ids[k, best] = low
            take = np.arange(ids.shape[1] - 1)
            take = take + (take > best[:, None])
            ids = np.take_along_axis(ids, take, axis=1)
            size = size - 1
            if ids.shape[1] < 2:
                ranks = np.empty((len(rows), 0), np.int32)
                continue
            # the pair that merged is gone: the ranks right of it move to the left
            take = np.arange(ids.shape[1] - 1)
            ranks = np.take_along_axis(ranks, take + (take >= best[:, None]), axis=1)
            right = best < ids.shape[1] - 1
            ranks[k[right], best[right]] = self.pair_ranks(ids[k[right], best[right]], ids[k[right], best[right] + 1])
            left = best > 0
            ranks[k[left], best[left] - 1] = self.pair_ranks(ids[k[left], best[left] - 1], ids[k[left], best[left]])
        used = final >= 0
        return final[used], used.sum(axis=1)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merge order (lowest rank, then leftmost) over a linked list with a heap."""
        ids = self.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))
                if (r := self.pair.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := self.pair.get((r, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            h = before[i]
            if h >= 0 and (x := self.pair.get((ids[h], r))) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def learn(self, pieces: set[str]) -> None:
        """Add pieces that the memo lacks."""
        whole: dict[str, int] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        found: list[tuple[list[str], np.ndarray, np.ndarray]] = []
        for s in pieces:
            raw = s.encode("utf-8")
            r = self.ranks.get(raw)
            if r is not None:
                whole[s] = r
            elif len(raw) > MATRIX_BYTES:
                ids = self.merge_long(raw)
                found.append(([s], ids, np.array([len(ids)])))
            else:
                buckets.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append((s, raw))
        found.append((list(whole), np.fromiter(whole.values(), np.int32, len(whole)), np.ones(len(whole), np.int64)))
        for width, group in buckets.items():
            step = max(1, (1 << 19) // width)
            for k in range(0, len(group), step):
                part = group[k:k + step]
                found.append(([x for x, _ in part], *self.merge_matrix([r for _, r in part], width)))
        names = [x for part, _, _ in found for x in part]
        self.memo.update(zip(names, range(len(self.memo), len(self.memo) + len(names)), strict=True))
        self.flat = np.concatenate([self.flat, *[x for _, x, _ in found]])
        self.count = np.concatenate([self.count, *[x for _, _, x in found]])
        self.begin = np.cumsum(self.count) - self.count

    def encode_block(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.split(t) for t in texts]
        fresh = set().union(*cut) if cut else set()
        if len(self.memo) + len(fresh) > MEMO_PIECES:
            self.forget()
        self.learn(fresh - self.memo.keys())
        get = self.memo.__getitem__
        out = []
        for pieces in cut:
            which = np.fromiter(map(get, pieces), np.int64, len(pieces))
            out.append(self.flat[spread(self.begin[which], self.count[which])])
        return out

    def as_decimal(self, ids: np.ndarray) -> str:
        """The ids as decimal numbers joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, gathered from the byte table."""
        parts = []
        for k in range(0, len(ids), 1 << 18):
            part = ids[k:k + (1 << 18)]
            parts.append(self.blob[spread(self.starts[part], self.lengths[part])].tobytes())
        return b"".join(parts)


_CODECS: dict[str, Codec] = {}


def codec(shared) -> Codec:
    """The worker's codec of a broadcast (key, rank file, pattern); built once per worker."""
    key, rank_file, pattern = shared.value
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def share(spark: SparkSession, path: str, pattern: str):
    """Broadcast the vocabulary file: about a megabyte, whatever the input is."""
    ship(spark)
    with open(path, "rb") as f:
        data = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(data + pattern.encode()).hexdigest(), data, pattern))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``df`` plus ``out``: array<int>, the ids of the whole text."""
    shared = share(df.sparkSession, path, pattern)
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    at = df.columns.index(text)

    def run(batches):
        c = codec(shared)
        for batch in batches:
            for part in blocks(batch, at):
                ids = c.encode_block(texts_of(part.column(at)))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                col = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, col], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``df`` plus ``out``: binary, the bytes of the ids (null ids: no bytes)."""
    shared = share(df.sparkSession, path, pattern)
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])
    at = df.columns.index(ids)

    def run(batches):
        c = codec(shared)
        for batch in batches:
            raw = [c.decode(np.asarray(x.values, dtype=np.int32) if x.is_valid else np.empty(0, np.int32))
                   for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The registered query's columns: encode, hash the ids, decode them and hash the bytes.
    Encoding and decoding share a pass, so ids do not travel between Python and the JVM."""
    shared = share(docs.sparkSession, path, pattern)

    def run(batches):
        c = codec(shared)
        for batch in batches:
            for part in blocks(batch, 1):
                rows = [(len(ids), hashlib.sha256(c.as_decimal(ids).encode()).hexdigest(),
                         hashlib.sha256(c.decode(ids)).hexdigest()) for ids in c.encode_block(texts_of(part.column(1)))]
                n, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
