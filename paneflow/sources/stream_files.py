"""Streaming sources on Spark's Python data source API: drops of binary records (SRC-2), of fixed-size
chunks (SRC-5), and epochs with a punctuation at their end (STR-2).

A drop is a folder below ``path`` that holds a ``_SUCCESS`` file; drops are read in the order of
their names, each once.  The offset is the name of the last drop read, so it stays small however
many files there are, and a restarted query goes on behind the last committed drop.  The driver lists
names and lengths only; tasks read byte ranges of the files through their URI.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from paneflow.sources import files as FS

# The readers run in Python processes that may not have this package on their path: ship the
# modules' code by value with the pickled reader.
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
    _cp.register_pickle_by_value(FS)
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to the shipped package
    pass

DONE = "_SUCCESS"
EPOCH_END = "_EPOCH"        # holds the epoch's end in microseconds


@dataclass
class Range(InputPartition):
    """Bytes of one file; ``size`` -1: the whole file."""

    path: str
    start: int
    size: int


class DropReader(DataSourceStreamReader):
    """Offsets and listing; subclasses cut files into partitions and read them."""

    def __init__(self, path: str):
        self.path = path

    def _drops(self) -> list[str]:
        fs, inner = FS._open_fs(self.path)
        if fs.get_file_info(inner).type != pa_fs.FileType.Directory:
            return []
        names = [x.base_name for x in fs.get_file_info(pa_fs.FileSelector(inner)) if x.type == pa_fs.FileType.Directory]
        return sorted(n for n in names if fs.get_file_info(f"{inner}/{n}/{DONE}").is_file)

    def initialOffset(self) -> dict:
        return {"drop": ""}

    def latestOffset(self) -> dict:
        return {"drop": max(self._drops(), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fs, inner = FS._open_fs(self.path)
        out = []
        for name in self._drops():
            if start["drop"] < name <= end["drop"]:
                found = fs.get_file_info(pa_fs.FileSelector(f"{inner}/{name}", recursive=True))
                out += [p for x in sorted(found, key=lambda x: x.path) if x.is_file and x.size
                        for p in self.cut(f"{self.path.rstrip('/')}{x.path[len(inner.rstrip('/')):]}", x.base_name, x.size)]
        return out

    def cut(self, path: str, name: str, size: int) -> Iterator[Range]:
        raise NotImplementedError

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _ranges(path: str, name: str, size: int, unit: int, range_bytes: int) -> Iterator[Range]:
    if not name.startswith(("_", ".")):
        step = max(1, range_bytes // unit) * unit
        for start in range(0, size, step):
            yield Range(path, start, min(step, size - start))


class RecordReader(DropReader):
    def __init__(self, path: str, layout: list, byte_order: str, keep: list[str], range_bytes: int):
        super().__init__(path)
        self.full = FS.dtype([tuple(x) for x in layout], byte_order)
        self.keep, self.range_bytes = keep, range_bytes

    def cut(self, path, name, size):
        return _ranges(path, name, size, self.full.itemsize, self.range_bytes)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        cols = FS.decode_records(FS._read(partition.path, partition.start, partition.size), FS.subset(self.full, self.keep))
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in map(cols.get, self.keep)], names=self.keep)


class RecordFiles(DataSource):
    """``record_drops``: fixed-width binary records of a layout (SRC-2), as columns."""

    @classmethod
    def name(cls) -> str:
        return "record_drops"

    def _layout(self) -> tuple[list, list[str]]:
        layout = json.loads(self.options["layout"])
        keep = json.loads(self.options.get("fields", "null")) or [n for n, _ in layout]
        return layout, [n for n, _ in layout if n in keep]

    def schema(self) -> str:
        return FS._schema(*self._layout())

    def streamReader(self, schema: StructType) -> RecordReader:
        layout, keep = self._layout()
        return RecordReader(self.options["path"], layout, self.options.get("byteorder", ">"), keep,
                            int(self.options.get("rangebytes", FS.RANGE_BYTES)))


class ChunkReader(DropReader):
    def __init__(self, path: str, chunk_bytes: int, range_bytes: int):
        super().__init__(path)
        self.chunk_bytes, self.range_bytes = chunk_bytes, range_bytes

    def cut(self, path, name, size):
        return _ranges(path, name, size, self.chunk_bytes, self.range_bytes)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        raw = FS._read(partition.path, partition.start, partition.size)
        at = range(0, len(raw), self.chunk_bytes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([partition.path] * len(at)), pa.array([partition.start + k for k in at], pa.int64()),
             pa.array([raw[k:k + self.chunk_bytes] for k in at], pa.binary())], names=["path", "start", "chunk"])


class ChunkFiles(DataSource):
    """``chunk_drops``: chunks of a fixed number of bytes (SRC-5); the last one of a file may be short."""

    @classmethod
    def name(cls) -> str:
        return "chunk_drops"

    def schema(self) -> str:
        return "path string, start bigint, chunk binary"

    def streamReader(self, schema: StructType) -> ChunkReader:
        return ChunkReader(self.options["path"], int(self.options["chunkbytes"]), int(self.options.get("rangebytes", FS.RANGE_BYTES)))


class EpochReader(DropReader):
    """Parquet rows of the epochs, and one row per epoch that carries only the epoch's end."""

    def __init__(self, path: str, schema: pa.Schema, time: str):
        super().__init__(path)
        self.schema_, self.time = schema, time

    def cut(self, path, name, size):
        if name == EPOCH_END or name.endswith(".parquet"):
            yield Range(path, 0, -1)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, inner = FS._open_fs(partition.path)
        if inner.endswith(EPOCH_END):
            with fs.open_input_file(inner) as f:
                end = int(f.read())
            yield pa.RecordBatch.from_arrays(
                [pa.array([True], pa.bool_()) if x.name == "mark" else pa.array([end if x.name == self.time else None], x.type)
                 for x in self.schema_], schema=self.schema_)
            return
        with fs.open_input_file(inner) as f:
            names = [x.name for x in self.schema_ if x.name != "mark"]
            for batch in pq.ParquetFile(f).iter_batches(columns=names):
                cols = {n: batch.column(n).cast(self.schema_.field(n).type) for n in names}
                cols["mark"] = pa.array(np.zeros(len(batch), bool))
                yield pa.RecordBatch.from_arrays([cols[x.name] for x in self.schema_], schema=self.schema_)


class EpochFiles(DataSource):
    """``epoch_drops``: each drop is an epoch of Parquet rows; its ``_EPOCH`` file says up to when the
    source is complete.  That end comes as a row of its own (``mark`` true, the time set, all else null)."""

    @classmethod
    def name(cls) -> str:
        return "epoch_drops"

    def schema(self) -> str:
        return self.options["columns"] + ", mark boolean"

    def streamReader(self, schema: StructType) -> EpochReader:
        from pyspark.sql.pandas.types import to_arrow_schema
        return EpochReader(self.options["path"], to_arrow_schema(schema), self.options.get("time", "ts"))


def write_epoch(df: DataFrame, path: str, name: str, end_us: int) -> None:
    """One epoch: the rows, its end, and last the mark that it is whole."""
    fs, inner = FS._open_fs(f"{path}/{name}")
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/{name}")
    for file, text in ((EPOCH_END, str(end_us)), (DONE, "")):
        with fs.open_output_stream(f"{inner}/{file}") as f:
            f.write(text.encode())


def _register(spark: SparkSession) -> None:
    for source in (RecordFiles, ChunkFiles, EpochFiles):
        spark.dataSource.register(source)


def record_stream(spark: SparkSession, path: str, layout, byte_order: str = ">", fields: list[str] | None = None) -> DataFrame:
    """SRC-2: the records of all drops below ``path`` as a stream; ``fields`` decodes only those."""
    _register(spark)
    r = spark.readStream.format("record_drops").option("path", path).option("layout", json.dumps(layout)).option("byteOrder", byte_order)
    return (r.option("fields", json.dumps(fields)) if fields else r).load()


def chunk_stream(spark: SparkSession, path: str, chunk_bytes: int) -> DataFrame:
    """SRC-5: (path, start, chunk) of all drops below ``path`` as a stream."""
    _register(spark)
    return spark.readStream.format("chunk_drops").option("path", path).option("chunkBytes", chunk_bytes).load()


def epoch_stream(spark: SparkSession, path: str, columns: str, time: str = "ts") -> DataFrame:
    """STR-2: rows and punctuations; with ``withWatermark`` on ``time`` the end of an epoch closes
    what lies before it, whatever the rows' own times are."""
    _register(spark)
    return spark.readStream.format("epoch_drops").option("path", path).option("columns", columns).option("time", time).load()
