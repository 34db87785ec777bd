"""Matrix files as a Spark data source: compressed columns or a dense array, read by ranges.

Compressed columns are three arrays: ``jc`` (where each column begins among the
entries, and the end), ``ir`` (the row of each entry) and ``data``.  They are a
folder of ``jc.npy``, ``ir.npy`` and ``data.npy``, or a group of these names in
an HDF5 file.  A dense matrix is one ``.npy`` file, or an HDF5 set of items x
users, as column-major writers leave it.  A task reads its range of entries (of
a dense file: of lines) and searches the column pointers for where it begins.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rankweave.sources.files import listed, open_fs

#: Entries (of a dense file: cells) that a task reads, and that it holds at once.
SPLIT_ENTRIES, CHUNK_ENTRIES = 1 << 22, 1 << 18


class Npy:
    """Ranges of an array file, from any store: its header is read, then what is asked for."""

    def __init__(self, path: str):
        fs, own = open_fs(path)
        self.file = fs.open_input_file(own)
        head = self.file.read(12)
        if head[:6] != b"\x93NUMPY":
            raise ValueError(f"{path} is no array file")
        size, self.start = (struct.unpack("<H", head[8:10])[0], 10) if head[6] == 1 else (struct.unpack("<I", head[8:12])[0], 12)
        self.file.seek(self.start)
        told = ast.literal_eval(self.file.read(size).decode("latin-1"))
        self.start += size
        self.dtype, self.shape, self.column_major = np.dtype(told["descr"]), told["shape"], told["fortran_order"]
        self.line = int(np.prod(self.shape[:-1] if self.column_major else self.shape[1:], dtype=np.int64))  # cells of one line of the file

    def lines(self) -> int:
        return self.shape[-1 if self.column_major else 0]

    def __getitem__(self, own: slice) -> np.ndarray:
        """Lines of the file, in its own order."""
        size = self.line * self.dtype.itemsize
        self.file.seek(self.start + own.start * size)
        raw = self.file.read((own.stop - own.start) * size)
        return np.frombuffer(raw, self.dtype).reshape(own.stop - own.start, *([self.line] if len(self.shape) > 1 else []))


class Hdf5:
    """The same of an HDF5 set (with the optional package h5py; a local file)."""

    def __init__(self, path: str, field: str):
        import h5py

        self.own = h5py.File(path.removeprefix("file://"), "r")[field]
        self.shape, self.column_major = self.own.shape, True  # its lines are columns of the matrix

    def lines(self) -> int:
        return self.shape[0]

    def __getitem__(self, own: slice) -> np.ndarray:
        return self.own[own]


def arrays(path: str, field: str | None) -> dict[str, Npy | Hdf5]:
    """jc, ir and data, or dense."""
    if path.endswith((".mat", ".h5", ".hdf5")):
        import h5py

        with h5py.File(path.removeprefix("file://"), "r") as f:
            parts = list(f[field]) if isinstance(f[field], h5py.Group) else None
        return {"dense": Hdf5(path, field)} if parts is None else {c: Hdf5(path, f"{field}/{c}") for c in ("jc", "ir", "data")}
    if path.endswith(".npy"):
        return {"dense": Npy(path)}
    names = {p.rsplit("/", 1)[-1]: p for p, _ in listed(path)}
    missing = {"jc.npy", "ir.npy", "data.npy"} - set(names)
    if missing:
        raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
    return {c: Npy(names[f"{c}.npy"]) for c in ("jc", "ir", "data")}


class Part(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.field = options["path"], options.get("field")
        self.split = int(options.get("splitentries", SPLIT_ENTRIES))

    def partitions(self) -> list[Part]:
        own = arrays(self.path, self.field)
        if "dense" in own:
            total, step = own["dense"].lines(), max(1, self.split // max(1, int(np.prod(own["dense"].shape)) // max(1, own["dense"].lines())))
        else:
            total, step = own["data"].lines(), self.split
        return [Part(a, min(a + step, total)) for a in range(0, total, step)] or [Part(0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        own = arrays(self.path, self.field)
        walk = self._dense(own["dense"], partition) if "dense" in own else self._columns(own, partition)
        for rows, columns, values in walk:
            known = values != 0
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[known].astype(t)) for x, t in ((rows, np.int64), (columns, np.int64), (values, np.float64))], names=["row", "col", "value"])

    def _dense(self, own, part: Part) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        width = max(1, int(np.prod(own.shape)) // max(1, own.lines()))
        step = max(1, CHUNK_ENTRIES // width)
        for a in range(part.start, part.end, step):
            some = own[a : min(a + step, part.end)]
            line, inside = np.nonzero(some)
            yield (inside, line + a, some[line, inside]) if own.column_major else (line + a, inside, some[line, inside])

    def _columns(self, own: dict, part: Part) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        jc, columns = own["jc"], own["jc"].lines() - 1
        low, high = 0, columns  # the last column that begins at or before the range
        while low + 1 < high:
            mid = (low + high) // 2
            low, high = (mid, high) if int(jc[mid : mid + 1][0]) <= part.start else (low, mid)
        column = low
        at = part.start
        while at < part.end and column < columns:
            some = jc[column : min(column + CHUNK_ENTRIES, columns) + 1].astype(np.int64)
            until = min(int(some[-1]), part.end)
            while at < until:
                end = min(at + CHUNK_ENTRIES, until)
                yield own["ir"][at:end], column + np.searchsorted(some, np.arange(at, end), "right") - 1, own["data"][at:end]
                at = end
            column += len(some) - 1


class MatrixFile(DataSource):
    """``spark.read.format("matrix_file")`` with options ``path``, ``field`` (HDF5) and ``splitEntries``."""

    @classmethod
    def name(cls) -> str:
        return "matrix_file"

    def schema(self) -> str:
        return "row long, col long, value double"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader({k.lower(): v for k, v in self.options.items()})


def read_matrix(spark: SparkSession, path: str, field: str = "M", split_entries: int = SPLIT_ENTRIES) -> DataFrame:
    """(row, col, value) of the cells that are not zero, rows and columns counted from 0."""
    spark.dataSource.register(MatrixFile)
    return spark.read.format("matrix_file").option("field", field).option("splitEntries", split_entries).load(path)


def read_matrix_ratings(spark: SparkSession, path: str, field: str = "M", swap_axes: bool = False, split_entries: int = SPLIT_ENTRIES) -> DataFrame:
    """Ratings of a matrix of users x items; ``swap_axes`` for items x users."""
    user, item = ("col", "row") if swap_axes else ("row", "col")
    cells = read_matrix(spark, path, field, split_entries)
    return cells.select(F.col(user).alias("user_id"), F.col(item).alias("item_id"), F.col("value").alias("rating"), F.lit(None).cast("long").alias("ts"))
