"""Session helpers: shared storage for cut lineage, partition counts and broadcast objects."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from collections.abc import Callable
from typing import TypeVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a new one where that is unset (local runs)."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("stratafold.shared.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stratafold-")
        spark.conf.set("stratafold.shared.dir", base)
    return base.rstrip("/")


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # The JVM is gone: the folder is left to whoever cleans the shared one.
        pass


def scratch_path(spark: SparkSession) -> str:
    """A new path in the application's part of the shared folder, which is deleted when the driver ends."""
    folder = f"{shared_dir(spark)}/stratafold/{spark.sparkContext.applicationId}"
    if folder not in _SCRATCH:
        _SCRATCH.add(folder)
        atexit.register(_remove, spark, folder)
    return f"{folder}/{uuid.uuid4().hex}"


_SCRATCH: set[str] = set()


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back, so later jobs neither recompute nor resample it.

    The table lives as long as the application; ``release`` ends it earlier.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.stratafold_path = path
    return written


def release(written: DataFrame) -> None:
    """Delete the files of what ``materialize`` gave, when nothing that is still to run reads them."""
    _remove(written.sparkSession, written.stratafold_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, partitions: int | None) -> DataFrame:
    """``df`` dealt out over that many partitions, or left where it lies if None: for callers that know their input to be a
    single small file, which Spark cannot split."""
    return df.repartition(partitions) if partitions else df


def few_splits(df: DataFrame) -> int | None:
    """For ``dealt``: the cores, if a file scan has fewer than half as many splits; None for all others and for shuffled plans."""
    if df._jdf.queryExecution().executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return None
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores if df._jdf.rdd().getNumPartitions() < cores / 2 else None


V = TypeVar("V")


def broadcast_object(spark: SparkSession, value: V) -> Callable[[], V]:
    """Broadcast an object of a bounded size; the result, called on a worker, gives it. Its class travels by value too."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(shared.value)
