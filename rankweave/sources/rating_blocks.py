"""Files of rating blocks as a Spark data source: a line ``item:`` and then lines ``user,rating[,date]``.

Files are read by byte ranges, each by a task of its own.  A range's lines
belong to headers before it, so headers are counted first, one row a range, and
what precedes a range is carried over into the plan of the second read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rankweave.sources.files import listed, open_fs

SPLIT_BYTES, CHUNK_BYTES = 32 << 20, 4 << 20
HEADERS = "part long, headers long, last string"
RATINGS = "user_id long, item_id long, rating double, ts long, source_item_id long"


class Range(InputPartition):
    def __init__(self, part: int, path: str, start: int, end: int, before: int = 0, source: str | None = None):
        self.part, self.path, self.start, self.end, self.before, self.source = part, path, start, end, before, source


def ranges(paths: list[str], split: int) -> list[Range]:
    """Byte ranges of the files in the given order."""
    files = [f for path in paths for f in listed(path)]
    cuts = [(path, a, min(a + split, size)) for path, size in files for a in range(0, size, split)]
    return [Range(i, *cut) for i, cut in enumerate(cuts)]


def chunks(own: Range) -> Iterator[np.ndarray]:
    """Whole lines that begin in a range, some at a time."""
    fs, path = open_fs(own.path)
    with fs.open_input_file(path) as f:
        size = f.size()
        at = own.start
        if at:
            f.seek(at - 1)
            while True:  # the line that began before the range is its predecessor's
                some = f.read(min(1 << 16, size - at + 1))
                end = some.find(b"\n")
                if end >= 0 or not some:
                    at += end
                    break
                at += len(some)
        f.seek(at)
        held = b""
        while at < own.end:
            held += f.read(min(CHUNK_BYTES, own.end - at))
            at = min(at + CHUNK_BYTES, own.end)
            if at >= own.end:
                while not held.endswith(b"\n") and (more := f.read(1 << 12)):  # the last line may go on
                    end = more.find(b"\n")
                    held += more if end < 0 else more[: end + 1]
                    if end >= 0:
                        break
            cut = held.rfind(b"\n") + 1 if at < own.end else len(held)
            if cut:
                yield np.frombuffer(held[:cut] if held[:cut].endswith(b"\n") else held[:cut] + b"\n", np.uint8)
            held = held[cut:]


def lines_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines (spaces and carriage returns at their end left out), and which of them are headers."""
    stops = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], stops[:-1] + 1])
    ends = stops.copy()
    while True:
        blank = (ends > starts) & np.isin(data[np.maximum(ends - 1, 0)], (13, 32, 9))
        if not blank.any():
            return starts, ends, (ends > starts) & (data[np.maximum(ends - 1, 0)] == 58)
        ends[blank] -= 1


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.carried = json.loads(options["carried"]) if "carried" in options else None

    def partitions(self) -> list[Range]:
        own = ranges(self.paths, self.split)
        if self.carried is not None:
            for r, (before, source) in zip(own, self.carried, strict=True):
                r.before, r.source = before, source
        return own or [Range(0, "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        if self.carried is None:
            n, last = 0, None
            for data in chunks(partition):
                starts, ends, header = lines_of(data)
                n += int(header.sum())
                for i in np.flatnonzero(header)[-1:]:
                    last = data[starts[i] : ends[i] - 1].tobytes().decode()
            yield pa.RecordBatch.from_pydict({"part": [partition.part], "headers": [n], "last": pa.array([last], pa.string())})
            return
        before, source = partition.before, int(partition.source) if partition.source is not None else None
        for data in chunks(partition):
            starts, ends, header = lines_of(data)
            at = np.flatnonzero(header)
            names = np.array([-1 if source is None else source, *(int(data[starts[i] : ends[i] - 1].tobytes()) for i in at)], np.int64)
            kept = (ends > starts) & ~header
            block = np.cumsum(header)[kept]
            if kept.any():
                whole = np.repeat(kept, np.diff(np.concatenate([starts, [len(data)]])))
                columns = ratings_of(data[whole].tobytes())
                yield pa.RecordBatch.from_arrays([columns[0], pa.array(before + block), columns[1], pa.nulls(len(block), pa.int64()), pa.array(names[block])], names=["user_id", "item_id", "rating", "ts", "source_item_id"])
            before, source = before + len(at), int(names[-1]) if len(names) > 1 or source is not None else None


def ratings_of(lines: bytes) -> list[pa.Array]:
    """User and rating, the first two fields of every line, with or without further ones."""
    wide = max(2, lines[: lines.find(b"\n")].count(b",") + 1)
    names = ["user", "rating", *(f"more{i}" for i in range(wide - 2))]
    types = {"user": pa.int64(), "rating": pa.float64()}
    read = lambda data, names: pacsv.read_csv(pa.BufferReader(data), pacsv.ReadOptions(column_names=names, use_threads=False), convert_options=pacsv.ConvertOptions(column_types=types, include_columns=["user", "rating"]))
    try:
        own = read(lines, names)
    except pa.ArrowInvalid:  # lines of different numbers of fields
        own = read(b"\n".join(b",".join(x.split(b",")[:2]) for x in lines.splitlines()), names[:2])
    return [own[c].combine_chunks() for c in ("user", "rating")]


class RatingBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rating_blocks"

    def schema(self) -> str:
        return RATINGS if "carried" in self.options else HEADERS

    def reader(self, schema) -> BlockReader:
        return BlockReader({k.lower(): v for k, v in self.options.items()})


def read_blocks(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Ratings of files or folders of blocks.

    ``item_id`` is the block's number from 1, counted on through the files in
    the given order (a folder's in order of their names); ``source_item_id`` is
    what its line says.  A block may go on in the next file.  Lines before the
    first header have item 0 and source -1; empty lines are left out.
    """
    spark.dataSource.register(RatingBlocks)
    source = spark.read.format("rating_blocks").option("paths", json.dumps(paths)).option("splitBytes", split_bytes)
    rows = sorted(source.load().collect(), key=lambda r: r["part"])  # a row a range
    carried, before, last = [], 0, None
    for r in rows:
        carried.append((before, last))
        before, last = before + r["headers"], r["last"] if r["last"] is not None else last
    return source.option("carried", json.dumps(carried)).load()


def write_blocks(ratings: DataFrame, folder: str) -> None:
    """Ratings as a folder of text files: ranges of items, each with its header and then its users in order.

    A block that fills more than one range goes on in the next file.
    """
    from pyspark.sql import functions as F

    lines = ratings.select("item_id", F.lit(1).alias("kind"), "user_id", F.concat(F.col("user_id").cast("string"), F.lit(","), F.col("rating").cast("string")).alias("value"))
    headers = ratings.select("item_id").distinct().select("item_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("user_id"), F.concat(F.col("item_id").cast("string"), F.lit(":")).alias("value"))
    keys = ["item_id", "kind", "user_id"]
    lines.unionByName(headers).repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.text(folder)
