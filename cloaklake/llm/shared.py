"""Tables, and the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

ARROW = "spark.sql.execution.arrow."


table = read_table


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where none is set and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 4096, size: int = 1 << 24) -> Iterator[None]:
    """Batches between Spark and Python of so many rows and bytes at the most, for what runs inside."""
    names = {f"{ARROW}maxRecordsPerBatch": str(rows), f"{ARROW}maxBytesPerBatch": str(size)}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which the worker gives the memory that it has freed back to the system: workers outlive their tasks."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in glibc
            if trim:
                trim(0)

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what follows starts from files, whichever executor is lost."""
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _open():
        _open()[-1].append((out, path))
    return out


_thread = threading.local()


def _open() -> list[list[tuple[DataFrame, str]]]:
    """Tables written inside the scratch() blocks that this thread has open, innermost last."""
    if not hasattr(_thread, "scratches"):
        _thread.scratches = []
    return _thread.scratches


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Tables written inside are removed at the end, but those given to what this yields: they are what is still read later."""
    own: list[tuple[DataFrame, str]] = []
    kept: list[DataFrame] = []
    _open().append(own)
    try:
        yield lambda *tables: kept.extend(tables)
    finally:
        _open().pop()
        stay = [(t, p) for t, p in own if any(t is k for k in kept)]
        for t, p in own:
            if not any(t is k for k, _ in stay):
                _remove(spark, p)
        if _open():
            _open()[-1].extend(stay)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
