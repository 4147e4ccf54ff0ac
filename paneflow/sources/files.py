"""File sources (SRC-1, SRC-2 … SRC-8, SRC-13): CSV position reports, text lines,
fixed-width binary records, file-drop streams.

Fixed-width binary records are decoded with numpy structured dtypes inside the tasks.  A
file is cut into record-aligned byte ranges and each task reads its ranges through the
file's URI, so one file of any size is read by many tasks and a task holds one range.
The layouts are declared once as field lists; byte order is a parameter (JVM writers use
big-endian, C++ writers the native order).
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Record layouts (fixed values: field, numpy type; total widths 78, 145, 40, 136 bytes).
YSB_LAYOUT = [("user_hi", "i8"), ("user_lo", "i8"), ("page_hi", "i8"), ("page_lo", "i8"),
              ("campaign_hi", "i8"), ("campaign_lo", "i8"), ("ad_type", "S9"),
              ("event_type", "S9"), ("current_ms", "i8"), ("ip", "u4")]
NYT_LAYOUT = [("medallion", "S30"), ("hack_license", "S30"), ("vendor_id", "S4"),
              ("rate_code", "u8"), ("pickup_ts", "i8"), ("dropoff_ts", "i8"),
              ("passenger_count", "u8"), ("trip_time_s", "u8"), ("trip_distance", "f8"),
              ("pickup_long", "f8"), ("pickup_lat", "f8"), ("dropoff_long", "f8"),
              ("dropoff_lat", "f8"), ("store_fwd", "u1")]
PING_LAYOUT = [("ip_pair", "S32"), ("rtt", "i8")]
AD_EVENT_LAYOUT = [("user_id", "S36"), ("page_id", "S36"), ("ad_id", "S36"), ("ad_type", "S16"),
                   ("event_type", "S8"), ("ip", "u4")]

LRB_COLUMNS = ("type time vid speed xway lane dir seg pos qid s_init s_end dow tod day").split()
LRB_SCHEMA = T.StructType([T.StructField(c, T.IntegerType()) for c in LRB_COLUMNS])


def dtype(layout, byte_order: str = ">") -> np.dtype:
    """Packed numpy structured dtype of a layout (``>`` big-endian, ``<`` little, ``=`` native)."""
    return np.dtype([(n, (byte_order + t) if t[0] in "iuf" else t) for n, t in layout])


def _spark_type(t: str) -> str:
    return {"i": "bigint", "u": "bigint", "f": "double", "S": "string"}[t[0]]


def _schema(layout, fields=None) -> str:
    return ", ".join(f"`{n}` {_spark_type(t)}" for n, t in layout if fields is None or n in fields)


#: Bytes of one range: what a task reads of a file; and the records it holds decoded at a time.
RANGE_BYTES = 16 << 20
BATCH_RECORDS = 16_384


def _open_fs(path: str):
    """(file system, path in it) of a URI or an absolute path."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return pa_fs.FileSystem.from_uri(path)


def byte_ranges(spark: SparkSession, path: str, unit: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, size): the files under ``path`` cut into ranges of whole units (the last
    unit of a file may be short).  Only names and lengths are read."""
    step = max(1, range_bytes // unit) * unit
    files = spark.read.format("binaryFile").load(path).select("path", "length").where(F.col("length") > 0)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long")))
    return (files.select("path", "length", starts.alias("start"))
            .select("path", "start", F.least(F.lit(step), F.col("length") - F.col("start")).alias("size"))
            .repartition("path", "start"))


def _read(path: str, start: int, size: int) -> bytes:
    fs, inner = _open_fs(path)
    with fs.open_input_file(inner) as f:
        f.seek(start)
        return f.read(size)


def _pieces(path: str, start: int, size: int, piece: int):
    """A range in pieces of at most ``piece`` bytes."""
    fs, inner = _open_fs(path)
    with fs.open_input_file(inner) as f:
        f.seek(start)
        while size > 0 and (raw := f.read(min(size, piece))):
            size -= len(raw)
            yield raw


def subset(dt: np.dtype, keep: list[str]) -> np.dtype:
    """The record type with only the fields ``keep``; the other bytes are skipped."""
    return np.dtype({"names": keep, "formats": [dt.fields[n][0] for n in keep],
                     "offsets": [dt.fields[n][1] for n in keep], "itemsize": dt.itemsize})


def _strings(a: np.ndarray) -> pa.Array:
    """A column of fixed-width byte strings as Arrow strings (latin-1, without the zero bytes at the end)."""
    width = a.dtype.itemsize
    flat = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), width)
    if flat.size and flat.max() >= 0x80:
        return pa.array(pd.Series(a).str.decode("latin-1").str.rstrip("\x00"), pa.string())
    at = np.arange(1, width + 1, dtype=np.int32)
    lengths = ((flat != 0) * at).max(axis=1, initial=0)
    offsets = np.zeros(len(a) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(len(a), pa.py_buffer(offsets), pa.py_buffer(flat[at <= lengths[:, None]]))


def decode_records(raw: bytes, part: np.dtype) -> dict[str, object]:
    """The fields of whole records as columns (bytes after the last whole record are left out)."""
    arr = np.frombuffer(raw, dtype=part, count=len(raw) // part.itemsize)
    cols: dict[str, object] = {}
    for n in part.names:
        a = arr[n]
        cols[n] = _strings(a) if a.dtype.kind == "S" else a.astype("float64" if a.dtype.kind == "f" else "int64")
    return cols


def _batch(cols: dict[str, object]) -> pa.RecordBatch:
    """The columns as a batch; a float that is no number is a null one."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, from_pandas=True) for c in cols.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(cols))


def read_fixed_width(spark: SparkSession, path: str, layout, byte_order: str = ">",
                     fields: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """SRC-2 / SRC-4 / SRC-7 / SRC-8 batch reader; ``fields`` decodes only those
    columns (SRC-3, early projection: the dtype is subset, other bytes are skipped).  A task holds
    ``BATCH_RECORDS`` records at a time, whatever the length of its ranges."""
    dt = dtype(layout, byte_order)
    keep = [n for n, _ in layout if fields is None or n in fields]
    part = subset(dt, keep)
    piece = BATCH_RECORDS * dt.itemsize

    def decode(batches):
        for batch in batches:
            for r in batch.select(["path", "start", "size"]).to_pylist():
                for raw in _pieces(r["path"], r["start"], r["size"], piece):
                    yield _batch(decode_records(raw, part))

    return byte_ranges(spark, path, dt.itemsize, range_bytes).mapInArrow(decode, _schema(layout, keep))


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """SRC-5: fixed-size chunks (path, start, chunk) of files; the last one of a file may be short."""
    def cut(batches):
        for pdf in batches:
            for file, start, size in zip(pdf["path"], pdf["start"], pdf["size"], strict=True):
                raw = _read(file, int(start), int(size))
                at = range(0, len(raw), chunk_bytes)
                yield pd.DataFrame({"path": [file] * len(at), "start": [int(start) + k for k in at],
                                    "chunk": [raw[k:k + chunk_bytes] for k in at]})

    return byte_ranges(spark, path, chunk_bytes, range_bytes).mapInPandas(cut, "path string, start bigint, chunk binary")


def _fixed_bytes(a: pa.Array, kind: np.dtype) -> np.ndarray:
    """An Arrow column as a column of fixed-width byte strings: latin-1, cut at the width."""
    if not pa.types.is_string(a.type) or a.null_count or len(a) == 0:
        return a.to_pandas().astype(str).str.encode("latin-1").values
    offsets = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4)
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    used = data[offsets[0]:offsets[-1]]
    if used.size and used.max() >= 0x80:
        return a.to_pandas().str.encode("latin-1").values
    lengths = np.minimum(np.diff(offsets), kind.itemsize)
    at = np.arange(kind.itemsize)
    filled = at < lengths[:, None]
    flat = np.zeros((len(a), kind.itemsize), np.uint8)
    flat[filled] = data[(offsets[:-1, None] + at)[filled]]
    return flat.view(kind).reshape(len(a))


def write_fixed_width(df: DataFrame, out_dir: str, layout, byte_order: str = ">") -> int:
    """Write ``df`` (columns named as the layout) as fixed-width records into ``out_dir`` (a
    folder on shared storage).  Returns the record count.

    A task writes an attempt file and renames it to the name of its partition at the end,
    so a retried or speculative task replaces its file and never adds a second one.  When all have
    ended, parts of an earlier write that this one has not replaced go, and ``_SUCCESS`` marks the
    folder as whole.
    """
    dt = dtype(layout, byte_order)
    names = [n for n, _ in layout]

    def write(batches):
        from pyspark import TaskContext
        task = TaskContext.get()
        fs, inner = _open_fs(out_dir)
        fs.create_dir(f"{inner}/_attempts", recursive=True)
        attempt = f"{inner}/_attempts/{task.partitionId()}-{task.taskAttemptId()}"
        n = 0
        with fs.open_output_stream(attempt) as f:
            for batch in batches:
                arr = np.zeros(batch.num_rows, dtype=dt)
                for c in names:
                    v = batch.column(c)
                    arr[c] = _fixed_bytes(v, dt[c]) if dt[c].kind == "S" else v.to_pandas().values
                f.write(arr.tobytes())
                n += batch.num_rows
        fs.move(attempt, f"{inner}/part-{task.partitionId():05d}.bin")
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "records": pa.array([n], pa.int64())})

    fs, inner = _open_fs(out_dir)
    if fs.get_file_info(f"{inner}/_SUCCESS").is_file:
        fs.delete_file(f"{inner}/_SUCCESS")
    done = df.select(*names).mapInArrow(write, "part int, records bigint").collect()  # one row per task
    fs.create_dir(inner, recursive=True)
    written = {f"part-{r['part']:05d}.bin" for r in done}
    for info in fs.get_file_info(pa_fs.FileSelector(inner)):
        if info.base_name.startswith("part-") and info.base_name not in written:
            fs.delete_file(info.path)
    fs.open_output_stream(f"{inner}/_SUCCESS").close()
    return sum(r["records"] for r in done)


def read_lrb_csv(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """SRC-1: LRB position reports, 15 int columns, many files read in parallel."""
    r = (spark.readStream if stream else spark.read).schema(LRB_SCHEMA).option("header", "false")
    return r.csv(path)


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """SRC-5: one record per text line (``value`` column)."""
    return (spark.readStream if stream else spark.read).text(path)


def file_drop_stream(spark: SparkSession, path: str, schema: T.StructType,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC-13: a stream fed by files dropped into ``path`` (Parquet)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


@contextmanager
def preloaded(df: DataFrame):
    """SRC-12: the whole input materialised before running (``persist`` + action), and released at
    the end of the block.

    Memory-and-disk, so partitions that do not fit spill instead of failing.  A result that leaves the
    block should be stored in it; otherwise it is computed again from the source."""
    from pyspark import StorageLevel
    p = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        p.count()
        yield p
    finally:
        p.unpersist()


def write_pairs(df: DataFrame, path: str) -> None:
    """A two-column dictionary or dimension as tab-separated text files."""
    df.write.option("sep", "\t").csv(path)


def read_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JN-6 / FN-8: a dictionary or dimension of tab-separated text lines (``schema`` names the two columns)."""
    return spark.read.schema(schema).option("sep", "\t").csv(path)
