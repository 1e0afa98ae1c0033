"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. One of this process's own only where it is unset, in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="sparkloom-"))
    return _OWN_DIR[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(hadoop)
    # With the store's name, so that Python on the executors finds the same place.
    return re.sub("^file:/+", "file:///", store.makeQualified(hadoop).toString())


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Spark deletes a query's shuffle files when it has ended; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """df as Parquet files, and its shuffle files deleted; the session's settings stay as they were."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and any executor can read it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    write_table(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for df in tables:
        delete_path(df.sparkSession, df.scratch_path)


class Shared:
    """An object broadcast by value, with its class, so that executors need no copy of this package; made once in a worker."""

    def __init__(self, spark: SparkSession, thing: object) -> None:
        self.broadcast = spark.sparkContext.broadcast(cloudpickle.dumps(thing))

    @property
    def value(self):
        held = self.broadcast
        if not hasattr(held, "_thing"):
            held._thing = cloudpickle.loads(held.value)
            held.__dict__.pop("_value", None)  # the bytes have served
        return held._thing


def bounded_arrow(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """Lowers the session's Arrow batches to so many rows and bytes (or one row), for texts may be very long; smaller ones stay.

    The setting counts when a result is read, so it can't be put back here.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(f"spark.sql.execution.arrow.{key}"))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of an integer column, by which the batches are in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)] if len(values) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and held[0].column(key)[0].as_py() != int(values[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
