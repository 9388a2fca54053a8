"""What several operators share: intermediate tables, files of tasks, hashes, slices of batches."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.session import fresh, written


def delete(spark: SparkSession, *paths: str) -> None:
    """Removes folders of intermediate data by way of Hadoop, so that any store works."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is executed inside passes so many rows at a time to Python: whole texts in a batch take memory in both processes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Intermediate tables of one run in a folder of their own; they are removed as soon as nothing reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, fresh(spark, name), {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back; a name may be used again."""
        path = f"{self.folder}/{name}-{len(self.paths)}"
        out = written(df, name, path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        self._remove(lambda t: any(t is x for x in tables))

    def keep(self, *tables: DataFrame) -> None:
        """Removes all others."""
        self._remove(lambda t: t is not None and not any(t is x for x in tables))

    def _remove(self, which) -> None:
        for path, t in self.paths.items():
            if t is not None and which(t):
                delete(self.spark, path)
                self.paths[path] = None


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def filesystem(uri: str):
    """The pyarrow file system of a URI and the path in it; plain and file: paths are local (shared) folders."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_file(uri: str, *parts: bytes) -> None:
    """Writes a file under a hidden name and moves it, so that a task that runs twice leaves one whole file."""
    store, path = filesystem(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        for part in parts:
            out.write(part)
    store.move(hidden, path)


def byte_slices(batch, column: int, most: int):
    """Slices of a record batch with up to so many bytes in a string column, at least one row each."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


def binary_slices(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column whose rows are an array's bytes between neighbouring edges, without a copy. (pyarrow 23 never frees
    what a memoryview that is given as a value belongs to.)"""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])
