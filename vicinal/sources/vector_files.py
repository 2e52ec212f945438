"""Flat binary vector files as Spark data sources.

fbin: u32 rows, u32 dim, then components (version 1; the component type is an option), or u32 magic, u32
type, u32 rows, u32 dim (version 2, which names its type). fvecs: rows of i32 dim and floats. knn_ids: i32
rows, i32 k, u32 ids, and optionally f32 distances. f32: bare floats.

Each reader cuts its file into ranges of rows, one task each, and reads only its range. Filters on `id` are
pushed down to the ranges. Files are opened by path in the tasks, so the path must be mounted on all of them.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Fixed values of the format: the magic of version 2, component types by code, and how they are read.
MAGIC = 0x31424A44
TYPES = {0: "float32", 1: "int8", 2: "uint8"}
NUMPY = {"float32": "<f4", "int8": "i1", "uint8": "u1"}
SQL = {"float32": "float", "int8": "tinyint", "uint8": "smallint"}  # Spark has no unsigned byte
#: Bytes of components that a task reads, on average, and rows of an Arrow batch.
RANGE_BYTES, BATCH = 64 << 20, 8192


@dataclass
class Header:
    rows: int
    dim: int
    dtype: str
    offset: int

    @property
    def row_bytes(self) -> int:
        return self.dim * np.dtype(NUMPY[self.dtype]).itemsize


def read_header(path: str, dtype: str = "float32") -> Header:
    """The header; a file that looks like version 2 but whose size says otherwise is read as version 1."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(16)
    if len(head) < 8:
        raise ValueError(f"{path}: too short for a header")
    if len(head) == 16:
        magic, code, rows, dim = struct.unpack("<4I", head)
        if magic == MAGIC and code in TYPES:
            found = Header(rows, dim, TYPES[code], 16)
            if size == 16 + rows * found.row_bytes:
                return found
        if magic == MAGIC and code == 3:
            raise ValueError(f"{path}: half precision is not supported")
    if dtype not in NUMPY:
        raise ValueError(f"no such type: {dtype}")
    rows, dim = struct.unpack("<2I", head[:8])
    found = Header(rows, dim, dtype, 8)
    if size != 8 + rows * found.row_bytes:
        raise ValueError(f"{path}: {size} bytes, not {8 + rows * found.row_bytes}")
    return found


def check_header(found: Header, rows: int | None = None, dim: int | None = None, dtype: str | None = None) -> None:
    for name, want in (("rows", rows), ("dim", dim), ("dtype", dtype)):
        if want is not None and getattr(found, name) != want:
            raise ValueError(f"{name} is {getattr(found, name)}, not {want}")


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class _Ranges(DataSourceReader):
    """Reads rows [first, last) of a file; subclasses say how many there are, how large, and how to read."""

    def __init__(self, path: str, options: dict) -> None:
        self.path, self.low, self.high = path, 0, None
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("id",) and isinstance(f.value, int):
                v = f.value
                if isinstance(f, EqualTo | GreaterThanOrEqual):
                    self.low = max(self.low, v)
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, v + 1)
                if isinstance(f, EqualTo | LessThanOrEqual):
                    self.high = min(self.high if self.high is not None else v + 1, v + 1)
                if isinstance(f, LessThan):
                    self.high = min(self.high if self.high is not None else v, v)
            else:
                yield f

    def partitions(self) -> list[Rows]:
        rows, size = self.extent()
        low, high = max(0, self.low), min(rows, rows if self.high is None else self.high)
        step = max(1, self.range_bytes // max(1, size))
        return [Rows(a, min(high, a + step)) for a in range(low, high, step)] or [Rows(0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        for a in range(part.first, part.last, BATCH):
            yield self.batch(a, min(part.last, a + BATCH))

    def slice(self, offset: int, count: int, dtype: str) -> np.ndarray:
        """Components of the file, mapped into memory: only the pages that are used are read."""
        return np.asarray(np.memmap(self.path, dtype, "r", offset, (count,))) if count else np.zeros(0, dtype)


def _vectors(first: int, rows: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    n, dim = rows.shape
    flat = pa.array(np.ascontiguousarray(rows).ravel()).cast(kind)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim or 1, dtype=np.int32)[: n + 1]), flat)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), lists], names=["id", "vec"])


class FbinReader(_Ranges):
    def __init__(self, path: str, options: dict, header: Header) -> None:
        super().__init__(path, options)
        self.header = header

    def extent(self) -> tuple[int, int]:
        return self.header.rows, self.header.row_bytes

    def batch(self, a: int, b: int) -> pa.RecordBatch:
        h = self.header
        rows = self.slice(h.offset + a * h.row_bytes, (b - a) * h.dim, NUMPY[h.dtype]).reshape(b - a, h.dim)
        return _vectors(a, rows, {"float32": pa.float32(), "int8": pa.int8(), "uint8": pa.int16()}[h.dtype])


class FbinSource(DataSource):
    """format("fbin"): id, vec. Options: path, dtype (version 1), expectRows, expectDim, expectDtype, rangeBytes;
    for writing also version (2)."""

    @classmethod
    def name(cls) -> str:
        return "fbin"

    def _header(self) -> Header:
        found = read_header(self.options["path"], self.options.get("dtype", "float32"))
        number = lambda k: int(self.options[k]) if k in self.options else None
        check_header(found, number("expectRows"), number("expectDim"), self.options.get("expectDtype"))
        return found

    def schema(self) -> str:
        return f"id bigint, vec array<{SQL[self._header().dtype]}>"

    def reader(self, schema) -> DataSourceReader:
        return FbinReader(self.options["path"], self.options, self._header())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FbinWriter(self.options["path"], self.options.get("dtype", "float32"), int(self.options.get("version", 2)))


@dataclass
class _Part(WriterCommitMessage):
    path: str
    rows: int
    dim: int
    first: int


class FbinWriter(DataSourceArrowWriter):
    """Tasks write parts beside the file; the commit puts them in order of their first id behind one header.
    Sort or range-partition by id first, so that parts follow each other."""

    def __init__(self, path: str, dtype: str, version: int) -> None:
        self.path, self.dtype, self.version = path, dtype, version

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import uuid

        part, rows, dim, first = f"{self.path}.{uuid.uuid4().hex}.part", 0, 0, -1
        with open(part, "wb") as f:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
                first = batch.column("id")[0].as_py() if first < 0 else first
                rows, dim = rows + batch.num_rows, len(flat) // batch.num_rows
                f.write(np.ascontiguousarray(flat, NUMPY[self.dtype]).tobytes())
        return _Part(part, rows, dim, first)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first)
        rows, dim = sum(m.rows for m in parts), parts[0].dim if parts else 0
        code = next(k for k, v in TYPES.items() if v == self.dtype)
        head = struct.pack("<4I", MAGIC, code, rows, dim) if self.version == 2 else struct.pack("<2I", rows, dim)
        with open(f"{self.path}.new", "wb") as out:
            out.write(head)
            for m in parts:
                with open(m.path, "rb") as f:
                    while piece := f.read(1 << 24):
                        out.write(piece)
        os.replace(f"{self.path}.new", self.path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class FvecsReader(_Ranges):
    def extent(self) -> tuple[int, int]:
        size = os.path.getsize(self.path)
        if not size:
            return 0, 4
        self.dim = int(self.slice(0, 1, "<i4")[0])
        row = 4 + 4 * self.dim
        if self.dim < 0 or size % row:
            raise ValueError(f"{self.path}: not rows of {self.dim} floats")
        return size // row, row

    def batch(self, a: int, b: int) -> pa.RecordBatch:
        dim = int(self.slice(0, 1, "<i4")[0])
        raw = self.slice(a * (4 + 4 * dim), (b - a) * (1 + dim), "<i4").reshape(b - a, 1 + dim)
        if (raw[:, 0] != dim).any():
            raise ValueError(f"{self.path}: rows of different dimensions")
        return _vectors(a, np.ascontiguousarray(raw[:, 1:]).view("<f4"), pa.float32())


class FvecsSource(DataSource):
    """format("fvecs"): id, vec."""

    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def schema(self) -> str:
        return "id bigint, vec array<float>"

    def reader(self, schema) -> DataSourceReader:
        return FvecsReader(self.options["path"], self.options)


class KnnReader(_Ranges):
    def extent(self) -> tuple[int, int]:
        rows, k = self.slice(0, 2, "<i4").tolist()
        size = os.path.getsize(self.path)
        if size not in (8 + 4 * rows * k, 8 + 8 * rows * k):
            raise ValueError(f"{self.path}: {size} bytes for {rows} rows of {k}")
        return rows, 8 * k

    def batch(self, a: int, b: int) -> pa.RecordBatch:
        rows, k = self.slice(0, 2, "<i4").tolist()
        ids = self.slice(8 + 4 * a * k, (b - a) * k, "<u4").astype(np.int64)
        offsets = pa.array(np.arange(0, (b - a) * k + 1, k or 1, dtype=np.int32)[: b - a + 1])
        lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
        if os.path.getsize(self.path) > 8 + 4 * rows * k:
            d = self.slice(8 + 4 * rows * k + 4 * a * k, (b - a) * k, "<f4")
            dist = pa.ListArray.from_arrays(offsets, pa.array(d))
        else:
            dist = pa.nulls(b - a, pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), lists, dist], names=["id", "neighbours", "distances"])


class KnnSource(DataSource):
    """format("knn_ids"): id, neighbours, distances (null if the file has none)."""

    @classmethod
    def name(cls) -> str:
        return "knn_ids"

    def schema(self) -> str:
        return "id bigint, neighbours array<bigint>, distances array<float>"

    def reader(self, schema) -> DataSourceReader:
        return KnnReader(self.options["path"], self.options)


class FloatReader(_Ranges):
    def extent(self) -> tuple[int, int]:
        return os.path.getsize(self.path) // 4, 4

    def batch(self, a: int, b: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(self.slice(4 * a, b - a, "<f4"))], names=["id", "value"])


class FloatSource(DataSource):
    """format("f32"): id, value of a file of bare floats."""

    @classmethod
    def name(cls) -> str:
        return "f32"

    def schema(self) -> str:
        return "id bigint, value float"

    def reader(self, schema) -> DataSourceReader:
        return FloatReader(self.options["path"], self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FbinSource, FvecsSource, KnnSource, FloatSource):
        spark.dataSource.register(source)
