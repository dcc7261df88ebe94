"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """Sets the checkpoint folder that spark.checkpoint.dir names. Only a session within one process may name none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^,\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Materialises df in the shared checkpoint folder, so that later steps survive lost executors without a recompute.

    In at most `parts` files. Each file costs a task and, on a local file system without Hadoop's native library, processes
    that the JVM forks to set rights; a forked process counts as a second executor for a moment.
    """
    checkpoint_dir(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table written to the shared checkpoint folder and read again.

    For loops: a checkpoint keeps the size that the optimizer estimated for its plan, and estimates of joined checkpoints multiply
    from round to round until the numbers themselves fill the driver. A table has the size of its files.
    """
    checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `rows` rows and about `size` bytes; a longer single row comes alone."""
    for batch in batches:
        n, at = batch.num_rows, 0
        step = max(1, min(rows, int(n * size / max(1, batch.nbytes)))) if n else 1
        while at < n:
            yield batch.slice(at, step)
            at += step


def arrow_map(df: DataFrame, columns: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over df's columns (selected and renamed c0, c1, ...), in Arrow batches."""
    picked = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    return picked.mapInArrow(lambda it: fn(slices(it)), schema)


def batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names=names)


_HELD: dict = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task for one operator at a time; another operator's is let go."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Lets go of what an earlier operator has kept in this worker, and hands freed memory back: workers live from task to task."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
