"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import ctypes
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where it is unset in a local session (tests), an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='rankweave-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own file-system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables of one job.

    ``keep`` writes a table and reads it back, which cuts the lineage and
    survives lost executors.  ``clear`` removes what is no longer needed; the
    rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        atexit.register(self._clear_quietly)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        self.paths.append(new_path(self.spark, name))
        return self.paths[-1]

    def clear(self, *but: DataFrame) -> None:
        """Remove all tables except those that the given frames read."""
        held = " ".join(" ".join(df.inputFiles()) for df in but)
        for path in [p for p in self.paths if p.rsplit("/", 1)[-1] not in held]:
            drop(self.spark, path)
            self.paths.remove(path)

    def _clear_quietly(self) -> None:
        if self.spark.sparkContext._jsc is None:  # the session has ended
            return
        try:
            self.clear()
        except Exception:  # noqa: BLE001  the JVM may end first
            pass


def send(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast a value whose class executors need not have installed; ``received`` gives it back."""
    return spark.sparkContext.broadcast([cloudpickle.dumps(value)])


def received(sent: Broadcast) -> object:
    """The value that was sent, which later tasks of the same worker share."""
    box = sent.value
    if len(box) == 1:
        box.append(pickle.loads(box[0]))
    return box[1]


def give_back() -> None:
    """Return freed memory of this process to the system where the C library can (glibc): Spark keeps a Python worker for later tasks, and with it what the last one left."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back when its task has ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run
