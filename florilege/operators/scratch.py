"""Tables that a query writes for itself, in the folder that all executors share, and what is built once a session from a table."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_built: dict[tuple, str] = {}


def root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a local session without one gets a folder of its own."""
    if named := spark.conf.get("spark.checkpoint.dir", "") or "":
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.gettempdir() + f"/florilege-{uuid.uuid4().hex}")


def written(df: DataFrame, tag: str) -> str:
    """The path of `df`, written once as Parquet."""
    path = f"{root(df.sparkSession)}/florilege/{uuid.uuid4().hex}-{tag}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def stamp(spark: SparkSession, path: str) -> tuple:
    """The names of a table's files, their size, and the time of the folder or file: another stamp is another table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    names = hashlib.sha256("\n".join(sorted(spark.read.parquet(path).inputFiles())).encode()).hexdigest()
    return names, system.getContentSummary(hadoop).getLength(), system.getFileStatus(hadoop).getModificationTime()


def once(spark: SparkSession, source: str, build: Callable[[], DataFrame], *key) -> DataFrame:
    """What `build` makes of the table at `source`, written once a session and again if the table changes; made anew at each use
    where there is no folder to share it in."""
    try:
        root(spark)
    except ValueError:
        return build()
    key = (spark.sparkContext.applicationId, stamp(spark, source), *key)
    if key not in _built:
        # files of few row groups are read by as many tasks; what is built of them has a share for every core
        # (the source's tasks are counted, as to ask a plan with a shuffle for its partitions runs all that is before it)
        made, cores = build(), spark.sparkContext.defaultParallelism
        _built[key] = written(made.repartition(cores) if spark.read.parquet(source).rdd.getNumPartitions() < cores else made, "built")
    return spark.read.parquet(_built[key])
