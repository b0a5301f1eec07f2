"""Matrix files as Spark data sources: ``npy``, ``fvecs`` and ``ivecs``, read in parallel by row ranges.

    spark.dataSource.register(NpySource)
    spark.read.format("npy").load(path)     # (row long, vector array<...>)

A file is opened by its path where the tasks run, so it must lie on storage that they all mount. Record
sizes are fixed, so a task seeks to its rows. Writers sort nothing: ``save_matrix`` numbers the rows.
"""

from __future__ import annotations

import ast
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from halyard.errors import Corrupt, InvalidInput

#: npy type codes and their Spark element types.
TYPES = {"<f4": "float", "<i4": "int", "<i8": "bigint", "<u8": "decimal(20,0)"}
#: First bytes of an npy file; its header is padded to a multiple of 64 bytes.
MAGIC, PAD = b"\x93NUMPY", 64
ROWS_A_TASK = 65_536


@dataclass
class Shape:
    rows: int
    cols: int
    type: str
    start: int
    record: int
    lead: int  # bytes before a record's values


def npy_shape(path: str) -> Shape:
    """The header of an npy file, versions 1 to 3; C order, one or two dimensions, and no byte too many."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(12)
        if head[:6] != MAGIC or len(head) < 10:
            raise Corrupt(f"{path}: not an npy file")
        if head[6] == 1:
            n, start = struct.unpack("<H", head[8:10])[0], 10
        elif head[6] in (2, 3) and len(head) == 12:
            n, start = struct.unpack("<I", head[8:12])[0], 12
        else:
            raise Corrupt(f"{path}: npy version {head[6]}")
        f.seek(start)
        text = f.read(n)
    try:
        d = ast.literal_eval(text.decode("utf-8" if head[6] == 3 else "latin1").strip())
        type_, order, shape = d["descr"], d["fortran_order"], d["shape"]
    except Exception:
        raise Corrupt(f"{path}: bad npy header") from None
    if len(text) < n or type_ not in TYPES or order is not False or not 1 <= len(shape) <= 2:
        raise Corrupt(f"{path}: only C-order {', '.join(TYPES)} of one or two dimensions")
    rows, cols = shape[0], shape[1] if len(shape) == 2 else 1
    record = cols * np.dtype(type_).itemsize
    if size != start + n + rows * record:
        raise Corrupt(f"{path}: {size} bytes, not {start + n + rows * record}")
    return Shape(rows, cols, type_, start + n, record, 0)


def vecs_shape(path: str, type_: str) -> Shape:
    """Of an fvecs or ivecs file: records of a 32-bit dimension and as many 32-bit values."""
    size = os.path.getsize(path)
    if size == 0:
        return Shape(0, 0, type_, 0, 4, 4)
    with open(path, "rb") as f:
        cols = struct.unpack("<i", f.read(4).ljust(4, b"\xff"))[0]
    if cols < 1 or size % (4 + 4 * cols):
        raise Corrupt(f"{path}: not records of one dimension")
    return Shape(size // (4 + 4 * cols), cols, type_, 0, 4 + 4 * cols, 4)


def shape_of(path: str, kind: str) -> Shape:
    return npy_shape(path) if kind == "npy" else vecs_shape(path, "<f4" if kind == "fvecs" else "<i4")


def kind_of(path: str) -> str:
    kind = os.path.splitext(path)[1][1:]
    if kind not in ("npy", "fvecs", "ivecs"):
        raise InvalidInput(f"{path}: not an npy, fvecs or ivecs file")
    return kind


@dataclass
class RowRange(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, most: int):
        self.path, self.kind, self.shape = path, kind, shape_of(path, kind)
        self.rows = min(self.shape.rows, most) if most else self.shape.rows

    def partitions(self) -> list[RowRange]:
        return [RowRange(i, min(i + ROWS_A_TASK, self.rows)) for i in range(0, self.rows, ROWS_A_TASK)] or [RowRange(0, 0)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        s = self.shape
        for first in range(part.first, part.last, 8192):
            n = min(8192, part.last - first)
            with open(self.path, "rb") as f:
                f.seek(s.start + first * s.record)
                raw = np.frombuffer(f.read(n * s.record), np.uint8).reshape(n, s.record)
            if s.lead and (raw[:, :4].copy().view("<i4") != s.cols).any():
                raise Corrupt(f"{self.path}: records of different dimensions")
            flat = raw[:, s.lead :].copy().view(s.type).ravel()
            values = pa.array([int(x) for x in flat], pa.decimal128(20, 0)) if s.type == "<u8" else pa.array(flat)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * s.cols, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([pa.array(range(first, first + n), pa.int64()), vectors], ["row", "vector"])


class _Source(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return f"row long, vector array<{TYPES[shape_of(self.options['path'], self.kind).type]}>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.kind, int(self.options.get("rows", 0)))


class NpySource(_Source):
    kind = "npy"


class FvecsSource(_Source):
    kind = "fvecs"


class IvecsSource(_Source):
    kind = "ivecs"


def register(spark: SparkSession) -> None:
    for source in (NpySource, FvecsSource, IvecsSource):
        spark.dataSource.register(source)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, vector) of a file, its format by the suffix."""
    register(spark)
    return spark.read.format(kind_of(path)).load(path)


def save_matrix(df: DataFrame, path: str, order: str = "row", column: str = "vector", type_: str = "<f4") -> int:
    """Writes ``column`` of ``df`` in ascending ``order`` to one file; rows stream through the driver."""
    kind = kind_of(path)
    type_ = {"fvecs": "<f4", "ivecs": "<i4"}.get(kind, type_)
    part, rows, cols = f"{path}.part", 0, None
    with open(part, "wb") as f:
        for (vector,) in df.orderBy(order).select(column).toLocalIterator():
            values = np.array(vector, np.dtype(type_))
            if cols not in (None, len(values)):
                raise InvalidInput("vectors differ in length")
            cols = len(values)
            if kind != "npy":
                f.write(struct.pack("<i", cols))
            f.write(values.tobytes())
            rows += 1
    if kind == "npy":
        text = f"{{'descr': '{type_}', 'fortran_order': False, 'shape': ({rows}, {cols or 0}), }}"
        text += " " * (-(len(text) + 11) % PAD) + "\n"
        with open(part, "rb") as body, open(f"{path}.head", "wb") as f:
            f.write(MAGIC + b"\x01\x00" + struct.pack("<H", len(text)) + text.encode())
            while block := body.read(1 << 20):
                f.write(block)
        os.remove(part)
        part = f"{path}.head"
    os.replace(part, path)
    return rows


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(row, id) of a one-dimensional npy file of integer ids; negative ids are an error."""
    df = read_matrix(spark, path).selectExpr("row", "cast(vector[0] as long) as id", "size(vector) as n")
    if df.where("n <> 1").take(1) or df.where("id < 0").take(1):
        raise InvalidInput(f"{path}: ids are one column of integers from 0")
    return df.select("row", "id")
