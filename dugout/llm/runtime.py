"""What the operators of this subpackage share: stored intermediate tables, workers' import path, column names."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from dugout.sources.store import shared_folder

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the checkout is mounted; elsewhere ship it with ``--py-files``."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (_ROOT, known)))


def release() -> None:
    """Give memory that this worker process has freed back to the system.

    Workers are kept for later tasks and stages; the allocators of C and Arrow
    would hold the most that any of them needed.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, with ``release`` at the task's end."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return task


class Scratch:
    """Tables written below the shared folder, so that their lineage is cut and a lost executor costs no more than a task.

    A table may be dropped once nothing reads it any more; the ones a returned
    frame reads stay until the folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count}-{name}"

    def store(self, frame: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        frame.write.parquet(path)
        stored = self.spark.read.schema(frame.schema).parquet(path)
        stored.stored_at = path
        return stored

    def drop(self, *stored: DataFrame) -> None:
        for frame in stored:
            self.remove(frame.stored_at)

    def remove(self, path: str) -> None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
