"""Python workers that give their memory back.

Spark keeps workers between tasks and forks new ones beside idle ones, so what a worker holds after a task adds up in an
executor. `lean` wraps the functions of mapInArrow: arrays of MAPPED bytes or more, and Arrow's buffers, come from the
system and go back to it when they are freed, and when a task ends, its worker returns what else is free. `slim` does the
same for the JVMs of executors, whose heaps otherwise stay as large as any earlier step has made them.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

MAPPED = 1 << 20
_MMAP_THRESHOLD = -3  # of mallopt()

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trim() -> None:
    """Return freed memory of Arrow's pool and of the C heap (where its library can) to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    heap = ctypes.CDLL(None)
    if hasattr(heap, "malloc_trim"):
        heap.malloc_trim(0)


def settle() -> None:
    """Take large arrays from the system, not from a heap that keeps them (where the C library can), and Arrow's too."""
    heap = ctypes.CDLL(None)
    if hasattr(heap, "mallopt"):
        heap.mallopt(_MMAP_THRESHOLD, MAPPED)
    pa.set_memory_pool(pa.system_memory_pool())


def lean(run: Run) -> Run:
    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def slim(spark: SparkSession) -> None:
    """A full garbage collection in the executors, a task a core: G1 returns heap that is free after one to the system.

    No result depends on it, nor on whether it reaches every executor.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("reflect('java.lang.System', 'gc') AS done").collect()
