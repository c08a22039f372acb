"""Helpers that the training-data operators share: scratch tables, table reading, lookups safe against hot keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Parts into which the rows of one key are dealt by `attach`.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of local sessions that name none, by application.
_local: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share. A local session without one gets its own; a cluster must name one."""
    if root := spark.conf.get("spark.checkpoint.dir", "") or "":
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.gettempdir() + f"/florilege-{uuid.uuid4().hex}")


#: Lists of scratch tables written within each `scratch_tables` that is open, innermost last.
_open: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the scratch tables that were written in it, for callers that have written what they made of them."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def materialize(df: DataFrame, tag: str, narrow: bool = False) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    `narrow` rows, of a few numbers for each text, are first dealt into files of a fair size: a file a task would be a host of
    small ones."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/florilege/{uuid.uuid4().hex}-{tag}"
    if _open:
        _open[-1].append(path)
    (df.hint("rebalance") if narrow else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._florilege_path = path
    return out


def kept(df: DataFrame) -> DataFrame:
    """`df`, a scratch table, which the `scratch_tables` around does not delete."""
    if _open and (path := getattr(df, "_florilege_path", None)) in _open[-1]:
        _open[-1].remove(path)
    return df


def forget(*frames: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_florilege_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, through the file system that Spark reads it by."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def lean_batches(spark: SparkSession) -> None:
    """Hand texts to Python a few at a time, so that a worker's memory does not follow the texts' length.

    Two settings of the session are lowered, for a plan reads them when it runs; lower ones of the caller's stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        if not 0 < int(spark.conf.get(name).rstrip("bB")) <= most:
            spark.conf.set(name, str(most))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over a task's batches, after which the worker gives freed memory back: it stays, beside its executor's JVM."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; the short way is for texts of one byte a character."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def salt(*row: Column) -> Column:
    return F.pmod(F.xxhash64(*row), F.lit(SALTS)).cast("int")


def salt_mask(part: Column) -> Column:
    """Aggregate: which parts the rows of a key fall into, as the bits of a long."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), part))


def salted(df: DataFrame, mask: str, part: str) -> DataFrame:
    """One copy of each row of a per-key table for each part that has rows of the key: never more rows than it serves."""
    parts = F.expr(
        f"CASE WHEN bit_count(`{mask}`) = 1 AND `{mask}` > 0 THEN array(cast(round(log2(`{mask}`)) AS int)) "
        f"ELSE filter(sequence(0, {SALTS - 1}), s -> (shiftright(`{mask}`, s) & 1L) = 1L) END"
    )
    return df.withColumn(part, F.explode(parts)).drop(mask)
