"""Fixed-width records through Arrow: the same bytes, and a bounded piece of a file in a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paneflow.sources import files as FS


@pytest.mark.parametrize("values", [["abc", "sponsored-search", "", "x\0y", "z\0"], ["é", "a"], [None, "b"], []])
def test_fixed_width_strings_as_before(values):
    column, kind = pa.array(values, pa.string()), np.dtype("S9")
    want = np.zeros(len(values), kind)
    want[:] = column.to_pandas().astype(str).str.encode("latin-1").values
    got = np.zeros(len(values), kind)
    got[:] = FS._fixed_bytes(column, kind)
    assert got.tolist() == want.tolist()
    assert FS._strings(got).to_pylist() == pd.Series(want).str.decode("latin-1").str.rstrip("\x00").tolist()


def test_a_range_is_decoded_in_pieces(spark, tmp_path, monkeypatch):
    """the task holds BATCH_RECORDS records, not a range of any length."""
    monkeypatch.setattr(FS, "BATCH_RECORDS", 100)
    df = spark.range(1050).select(F.concat(F.lit("p"), "id").alias("ip_pair"), F.col("id").alias("rtt"))
    out = str(tmp_path / "bin")
    assert FS.write_fixed_width(df.coalesce(1), out, FS.PING_LAYOUT, "<") == 1050
    unit = FS.dtype(FS.PING_LAYOUT, "<").itemsize
    sizes = [len(p) // unit for p in FS._pieces(f"{out}/part-00000.bin", 0, 1050 * unit, 100 * unit)]
    assert sizes == [100] * 10 + [50]
    back = FS.read_fixed_width(spark, out, FS.PING_LAYOUT, "<")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_a_missing_float_comes_back_as_null(spark, tmp_path):
    layout = [("name", "S4"), ("x", "f8")]
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "name string, x double")
    FS.write_fixed_width(df.coalesce(1), str(tmp_path / "bin"), layout, "<")
    back = FS.read_fixed_width(spark, str(tmp_path / "bin"), layout, "<").collect()
    assert sorted(map(tuple, back)) == [("a", 1.5), ("b", None)]
