"""What bounds the memory of Python workers: small batches, and freed memory given back when a task ends."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of a batch handed to Python, at most.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> dict[str, str]:
    """The settings of BATCHES; lower ones of the session's stay."""
    now = {name: int(spark.conf.get(name).rstrip("bB")) for name in BATCHES}
    return {name: str(now[name] if 0 < now[name] < most else most) for name, most in BATCHES.items()}


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with other settings, for a while."""
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def give_back() -> None:
    """What this worker freed goes back to the system: it waits for its next task beside those that run."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)
