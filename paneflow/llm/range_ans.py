"""Token ids as compressed binary files: a static range asymmetric numeral system (rANS).

``token_ids`` encodes whole texts with a tokenizers file (:mod:`byte_chunks`); ``write`` counts the ids of the whole
corpus, scales the counts to one shared frequency table and writes the ids, in ascending
order of the documents, as files of independent blocks; ``read`` gives every document's ids
back, ``digest`` their places and checksums.

A block holds ``BLOCK_IDS`` ids (the last one of a file fewer).  Id ``p`` belongs to lane
``p % LANES``; each lane is a 64-bit rANS state, and all lanes share one stream of 32-bit
words in the order in which the decoder needs them.  Every ``CHECK_STEPS`` steps the block
keeps a checkpoint: the lane states and the place in the word stream, with a checksum of the ids
up to the next one.  Checkpoints of all blocks at hand decode side by side as the rows of one
matrix, and a reader may start at any of them.  A segment must end in the states of the next
checkpoint (the last one in the start state) and match its checksum; a block's bytes have one
as well.  The table's hash stands in each file, so ids are never decoded with another table.

File: head (magic, lanes, table hash), blocks, offsets of the blocks, trailer (counts, magic).
A block also names the documents that begin in it: id, place, length.  A task writes an attempt
file and renames it to its partition's name, so a retried task replaces its file.

Scale: the ids are written once as a table, shuffled once into ranges of the order key (with the
row's own number last, so rows with one id spread over many files) and streamed through the
encoder.  Readers take runs of blocks; a run answers for the documents that begin in it
and reads on to the end of the last of them, whatever the file's size.  Only the frequency
table (at most one row per id of the vocabulary) reaches the driver.

Defined results: a null or empty text has no ids besides the end id.  Documents without an id come
first, equal ids are ordered by the hash of their text, then by their place in the input; each
repeated row is a document of its own.  An empty table gives a folder without blocks and no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paneflow.llm.byte_chunks import ByteChunks
from paneflow.llm.common import blocks, parallelism, ship, stored, text_of
from paneflow.session import checkpoint_dir

END_ID = 0
LANES = 32
PRECISION = 18            # the shared frequencies add up to 2**18
CHECK_STEPS = 512         # steps (LANES ids each) from one checkpoint to the next
SEGMENT_IDS = LANES * CHECK_STEPS
BLOCK_IDS = 4 * SEGMENT_IDS
TEXT_BYTES = 12 << 20     # text that a task encodes together, unless one is longer
GROUP = 32                # blocks encoded, or decoded, side by side
RUN_BLOCKS = 64           # blocks of one reading task's unit
LOWER = np.uint64(1 << 31)
MAGIC = b"IDSRANS1"
HEAD = struct.Struct("<8sII32s")
BLOCK = struct.Struct("<4sIIIIQ")      # magic, ids, documents, segments, words, bytes after this head
TRAILER = struct.Struct("<QQQ8s")


# ---------------------------------------------------------------- coder

class Table:
    """Frequencies of the ids, scaled to ``2**PRECISION``; ids that never occur have none."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.hash = hashlib.sha256(freq.astype("<u4").tobytes()).digest()

    @classmethod
    def of_counts(cls, ids: list[int], counts: list[int]) -> Table:
        """Every id that occurs gets one slot, the rest of the slots go by the counts."""
        total, spare = sum(counts), (1 << PRECISION) - len(ids)
        if spare < 0:
            raise ValueError("more ids than slots")
        freq = np.zeros(max(ids, default=-1) + 1, np.int64)
        freq[ids] = [1 + c * spare // total for c in counts]
        if ids:
            freq[max(zip(counts, ids, strict=True))[1]] += (1 << PRECISION) - int(freq.sum())
        return cls(freq)


def encode(ids: np.ndarray, table: Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (rows of ``ids``) side by side: (states, word offsets, words) of each, states and
    offsets at its checkpoints."""
    m, n = ids.shape
    steps = -(-n // LANES)
    freq, start = table.freq[ids], table.start[ids]
    if not freq.all():
        raise ValueError("an id has no slot in the table")
    x = np.full((m, LANES), LOWER)
    out = np.zeros((steps, m, LANES), bool)
    low = np.zeros((steps, m, LANES), np.uint32)
    states = np.zeros((m, -(-steps // CHECK_STEPS), LANES), np.uint64)
    room, half = freq << np.uint64(63 - PRECISION), np.uint64(32)
    rest = np.uint64(1 << PRECISION) - freq
    for s in range(steps - 1, -1, -1):
        part = slice(s * LANES, (s + 1) * LANES)
        f = freq[:, part]
        w = f.shape[1]
        y = x[:, :w]
        full = y >= room[:, part]
        out[s, :, :w], low[s, :, :w] = full, y
        y = np.where(full, y >> half, y)
        # (q << PRECISION) + y % f + start, with y % f = y - q * f
        x[:, :w] = y // f * rest[:, part] + y + start[:, part]
        if s % CHECK_STEPS == 0:
            states[:, s // CHECK_STEPS] = x
    before = np.cumsum(out.sum(axis=2), axis=0)[CHECK_STEPS - 1:-1:CHECK_STEPS]
    offsets = np.vstack([np.zeros((1, m), np.int64), before])
    return [(states[b], offsets[:, b].astype(np.uint32), low[:, b][out[:, b]]) for b in range(m)]


def decode(states: np.ndarray, at: np.ndarray, words: np.ndarray, n: int, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of ``n`` ids side by side: (ids, end states, end places in ``words``)."""
    x, at = states.copy(), at.astype(np.int64)
    out = np.empty((len(x), n), np.uint32)
    bits, slot_mask, half = np.uint64(PRECISION), np.uint64((1 << PRECISION) - 1), np.uint64(32)
    for s in range(-(-n // LANES)):
        w = min(LANES, n - s * LANES)
        y = x[:, :w]
        slot = y & slot_mask
        sym = table.symbol[slot]
        out[:, s * LANES:s * LANES + w] = sym
        y = table.freq[sym] * (y >> bits) + slot - table.start[sym]
        need = y < LOWER
        place = at[:, None] + np.cumsum(need, axis=1)
        y[need] = (y[need] << half) | words[place[need] - 1]
        x[:, :w] = y
        at = place[:, -1]
    return out, x, at


def pack_block(ids: np.ndarray, docs: list[tuple], coded: tuple) -> bytes:
    """Bytes of a block: head, documents, checkpoints, words, checksum of all before it."""
    states, offsets, words = coded
    crc = np.array([zlib.crc32(ids[k:k + SEGMENT_IDS].astype("<u4")) for k in range(0, len(ids), SEGMENT_IDS)], "<u4")
    doc, known, at, length = (list(c) for c in zip(*docs, strict=True)) if docs else ([],) * 4
    body = b"".join([
        np.array(doc, "<i8").tobytes(), np.array(length, "<u8").tobytes(), states.astype("<u8").tobytes(),
        np.array(at, "<u4").tobytes(), offsets.astype("<u4").tobytes(), crc.tobytes(), words.astype("<u4").tobytes(),
        np.array(known, "u1").tobytes()])
    head = BLOCK.pack(b"BLK1", len(ids), len(docs), len(states), len(words), len(body) + 4)
    return head + body + struct.pack("<I", zlib.crc32(head + body))


class Block:
    """A parsed block; its ids stay encoded until :func:`open_blocks`."""

    def __init__(self, raw: bytes):
        magic, self.n, docs, segments, words, rest = BLOCK.unpack_from(raw)
        if magic != b"BLK1" or len(raw) != BLOCK.size + rest or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("damaged block")
        place = BLOCK.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal place
            got = np.frombuffer(raw, kind, count, place)
            place += got.nbytes
            return got

        doc, length = take("<i8", docs), take("<u8", docs)
        self.states = take("<u8", segments * LANES).reshape(segments, LANES)
        at, self.offsets, self.crc, self.words = take("<u4", docs), take("<u4", segments), take("<u4", segments), take("<u4", words)
        known = take("u1", docs)
        self.docs = [(d if k else None, a, s) for d, k, a, s in zip(doc.tolist(), known.tolist(), at.tolist(), length.tolist(), strict=True)]


def open_blocks(group: list[Block], table: Table) -> list[np.ndarray]:
    """Ids of the blocks: all their segments of one length decode side by side."""
    base = np.cumsum([0, *(len(b.words) for b in group)])
    words = np.concatenate([b.words for b in group] + [np.zeros(1, np.uint32)])
    out = [np.empty(b.n, np.uint32) for b in group]
    jobs: dict[int, list[tuple[int, int]]] = {}
    for i, b in enumerate(group):
        for k in range(len(b.states)):
            jobs.setdefault(min(SEGMENT_IDS, b.n - k * SEGMENT_IDS), []).append((i, k))
    for n, todo in jobs.items():
        states = np.array([group[i].states[k] for i, k in todo], np.uint64)
        at = np.array([base[i] + group[i].offsets[k] for i, k in todo])
        ids, ends, places = decode(states, at, words, n, table)
        for row, (i, k) in enumerate(todo):
            b = group[i]
            last = k + 1 == len(b.states)
            state, place = (np.full(LANES, LOWER), len(b.words)) if last else (b.states[k + 1], b.offsets[k + 1])
            if (ends[row] != state).any() or places[row] != base[i] + place or zlib.crc32(ids[row].astype("<u4")) != b.crc[k]:
                raise ValueError("a segment does not end where the next checkpoint begins")
            out[i][k * SEGMENT_IDS:k * SEGMENT_IDS + n] = ids[row]
    return out


# ---------------------------------------------------------------- files

def file_system(uri: str):
    """(file system, path in it) of a URI or an absolute path."""
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """Streams documents into one file, ``GROUP`` full blocks at a time."""

    def __init__(self, out, table: Table):
        self.out, self.table = out, table
        self.parts: list[np.ndarray] = []
        self.held = self.n_ids = self.n_docs = 0
        self.docs: list[tuple] = []        # (id, has one, place in the buffer, length)
        self.offsets: list[int] = []
        out.write(HEAD.pack(MAGIC, LANES, PRECISION, table.hash))
        self.place = HEAD.size

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc or 0, doc is not None, self.held, len(ids)))
        self.parts.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        self.n_docs += 1
        if self.held >= GROUP * BLOCK_IDS:
            self._flush(self.held // BLOCK_IDS)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.parts)
        for k in range(0, count, GROUP):
            part = ids[k * BLOCK_IDS:min(k + GROUP, count) * BLOCK_IDS].reshape(-1, BLOCK_IDS)
            for j, coded in enumerate(encode(part, self.table)):
                self._put(part[j], (k + j) * BLOCK_IDS, coded)
        self.parts = [ids[count * BLOCK_IDS:]]
        self.held -= count * BLOCK_IDS
        self.docs = [(d, k, a - count * BLOCK_IDS, n) for d, k, a, n in self.docs]

    def _put(self, ids: np.ndarray, begin: int, coded: tuple) -> None:
        here = 0
        while here < len(self.docs) and self.docs[here][2] < begin + len(ids):
            here += 1
        raw = pack_block(ids, [(d, k, a - begin, n) for d, k, a, n in self.docs[:here]], coded)
        self.docs = self.docs[here:]
        self.offsets.append(self.place)
        self.out.write(raw)
        self.place += len(raw)

    def close(self) -> None:
        self._flush(self.held // BLOCK_IDS)
        if self.held:
            ids = self.parts[0]
            self._put(ids, 0, encode(ids[None, :], self.table)[0])
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(TRAILER.pack(len(self.offsets), self.n_ids, self.n_docs, MAGIC))


def _read(f, at: int, size: int) -> bytes:
    f.seek(at)
    return f.read(size)


def file_index(f, size: int, table_hash: bytes) -> tuple[np.ndarray, int, int]:
    """(block offsets with the end of the last one, ids, documents) of an open file."""
    n, ids, docs, magic = TRAILER.unpack(_read(f, size - TRAILER.size, TRAILER.size))
    head = HEAD.unpack(_read(f, 0, HEAD.size))
    if magic != MAGIC or head != (MAGIC, LANES, PRECISION, table_hash):
        raise ValueError("not a file of this table")
    end = size - TRAILER.size - 8 * n
    return np.append(np.frombuffer(_read(f, end, 8 * n), "<u8").astype(np.int64), end), ids, docs


def _documents(f, offsets: np.ndarray, first: int, last: int, table: Table) -> Iterator[tuple]:
    """Pieces (id, place of the document in the file, length, piece, ends) of the documents that
    begin in the blocks first..last-1.  A piece is at most a block: a long document streams."""
    open_doc = None                        # (id, place, length, ids still to come)
    at = first
    while at < len(offsets) - 1 and (at < last or open_doc):
        upto = min(at + GROUP, last) if at < last else at + 1
        raw = _read(f, int(offsets[at]), int(offsets[upto] - offsets[at]))
        cuts = offsets[at:upto + 1] - offsets[at]
        group = [Block(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        for k, (b, ids) in enumerate(zip(group, open_blocks(group, table), strict=True)):
            if open_doc:
                doc, place, length, rest = open_doc
                piece = ids[:rest]
                open_doc = (doc, place, length, rest - len(piece)) if rest > len(piece) else None
                yield doc, place, length, piece, open_doc is None
            if at + k < last:
                for doc, begin, length in b.docs:
                    piece = ids[begin:begin + length]
                    place = (at + k) * BLOCK_IDS + begin
                    if length > len(piece):
                        open_doc = (doc, place, length, length - len(piece))
                    yield doc, place, length, piece, length == len(piece)
        at = upto


# ---------------------------------------------------------------- Spark

_ENCODERS: dict[str, ByteChunks] = {}


def token_ids(docs: DataFrame, path: str, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """(doc_id, hash, row, width, ids): the ids of each whole text with the end id, as little-endian
    integers of ``width`` bytes (2, or 4 if the vocabulary needs them).  Narrow.

    A task leaves one more row, with ``width`` 0: how often each id occurs in its rows (64-bit numbers)."""
    ship(docs.sparkSession)
    t = text_of(text)
    src = docs.select(F.col("doc_id").cast("long"), F.xxhash64(t).alias("hash"), F.monotonically_increasing_id().alias("row"), t.alias("text"))

    def run(batches):
        enc = _ENCODERS.get(path) or _ENCODERS.setdefault(path, ByteChunks(path))
        width = 2 if max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
        names, total = ["doc_id", "hash", "row", "width", "ids"], np.zeros(0, np.int64)
        for batch in batches:
            for part in blocks(batch, 3, TEXT_BYTES):
                ids = [np.append(x, np.uint32(end_id)) for x in enc.encode(part.column(3))]
                total = _sum(total, np.bincount(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([width] * len(part), pa.int32()),
                                                  pa.array([x.astype(f"<u{width}").tobytes() for x in ids], pa.binary())], names=names)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(
                (None, 0, 0, 0, total.astype("<i8").tobytes()), (*[pa.int64()] * 3, pa.int32(), pa.binary()), strict=True)], names=names)

    return src.mapInArrow(run, "doc_id long, hash long, row long, width int, ids binary")


def _array(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}")


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two count vectors of any lengths."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    a = a.copy()
    a[:len(b)] += b
    return a


def frequency_table(ids: DataFrame) -> DataFrame:
    """(id, freq): the ids' counts over all rows, scaled to the shared table."""
    def count(batches):
        for batch in batches:
            for raw in batch.column(0):
                total = np.frombuffer(raw.as_buffer(), "<i8")
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    counts = ids.where("width = 0").select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(map(tuple, counts.collect()))            # at most one row per id of the vocabulary
    table = Table.of_counts([i for i, _ in rows], [n for _, n in rows])
    used = np.flatnonzero(table.freq)
    return ids.sparkSession.createDataFrame([(int(i), int(table.freq[i])) for i in used], "id long, freq long")


def load_table(spark: SparkSession, folder: str) -> Table:
    """The shared table of a folder."""
    rows = spark.read.schema("id long, freq long").parquet(f"{folder}/table").collect()
    freq = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    return Table(freq)


def write(ids: DataFrame, folder: str, files: int | None = None) -> None:
    """Write the result of :func:`token_ids` into ``folder`` (shared, any path scheme that pyarrow
    and Spark both know): ``table`` and ``blocks``, files in the order of the documents."""
    spark = ids.sparkSession
    frequency_table(ids).coalesce(1).write.parquet(f"{folder}/table")
    table = load_table(spark, folder)
    order = [F.col("doc_id").asc_nulls_first(), "hash", "row"]

    def put(batches):
        from pyspark import TaskContext
        task = TaskContext.get()
        batches = (b for b in batches if len(b))
        first = next(batches, None)
        if first is None:
            return
        fs, inner = file_system(f"{folder}/blocks")
        fs.create_dir(f"{inner}/_attempts", recursive=True)
        attempt = f"{inner}/_attempts/{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        with fs.open_output_stream(attempt) as f:
            out = FileWriter(f, table)
            for batch in (b for g in ([first], batches) for b in g):
                for doc, raw, width in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    out.add(doc, _array(raw.as_buffer(), width).astype(np.uint32))
            out.close()
        fs.move(attempt, f"{inner}/part-{task.partitionId():06d}.rans")
        yield pa.RecordBatch.from_pydict({"ids": pa.array([out.n_ids], pa.int64())})

    placed = ids.where("width > 0").repartitionByRange(files or parallelism(spark), *order).sortWithinPartitions(*order)
    placed.select("doc_id", "ids", "width").mapInArrow(put, "ids long").agg(F.sum("ids")).collect()


def _runs(spark: SparkSession, folder: str, table: Table) -> DataFrame:
    """(path, length, first, last, base): runs of blocks, with the ids of all files before theirs."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.rans").load(f"{folder}/blocks").select("path", "length")
    known = table.hash

    def index(batches):
        for batch in batches:
            rows = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, inner = file_system(path)
                with fs.open_input_file(inner) as f:
                    offsets, ids, _ = file_index(f, size, known)
                rows.append((path, size, len(offsets) - 1, ids))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "length", "n_blocks", "n_ids"])

    files = listing.mapInArrow(index, "path string, length long, n_blocks long, n_ids long")
    # one row per file: a file listing, not data
    before = F.sum("n_ids").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    files = files.withColumn("base", F.coalesce(before, F.lit(0)))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1, F.lit(RUN_BLOCKS).cast("long")))
    runs = files.where(F.col("n_blocks") > 0).select("path", "length", "base", "n_blocks", first.alias("first"))
    return runs.select("path", "length", "base", "first", F.least(F.col("n_blocks"), F.col("first") + RUN_BLOCKS).alias("last")) \
               .repartition(parallelism(spark), "path", "first")


def _has_blocks(spark: SparkSession, folder: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/blocks")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, piece, ids): the ids of every document from the files, in pieces of
    at most a block; ``start`` counts the ids of all documents before it."""
    table = load_table(spark, folder)
    schema = "doc_id long, start long, n_tokens long, piece int, ids array<int>"
    if not _has_blocks(spark, folder):
        return spark.createDataFrame([], schema)

    def run(batches):
        for run_ in _each(batches):
            piece = 0
            for doc, place, length, ids, done in _open_run(run_, table):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc], pa.int64()), pa.array([run_[2] + place], pa.int64()), pa.array([length], pa.int64()),
                     pa.array([piece], pa.int32()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))],
                    names=["doc_id", "start", "n_tokens", "piece", "ids"])
                piece = 0 if done else piece + 1

    return _runs(spark, folder, table).mapInArrow(run, schema)


def _each(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _open_run(run: tuple, table: Table) -> Iterator[tuple]:
    path, size, _, first, last = run
    fs, inner = file_system(path)
    with fs.open_input_file(inner) as f:
        offsets, _, _ = file_index(f, size, table.hash)
        yield from _documents(f, offsets, first, last, table)


def places(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded files."""
    table = load_table(spark, folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not _has_blocks(spark, folder):
        return spark.createDataFrame([], schema)

    def run(batches):
        for run_ in _each(batches):
            rows, crc = [], 0
            for doc, place, length, ids, done in _open_run(run_, table):
                crc = zlib.crc32(ids.astype("<u4"), crc)
                if done:
                    rows.append((doc, run_[2] + place, length, crc))
                    crc = 0
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _runs(spark, folder, table).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Encode, write and read back; ``folder`` defaults to a new one in the shared checkpoint folder."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    write(stored(token_ids(docs, path), "zstd"), folder)
    return places(spark, folder)
