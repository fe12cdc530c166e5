"""Cutting the lineage of iterative jobs, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one on a local master; elsewhere that is an error."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(own)
    return own


def stash(df: DataFrame, name: str = "rounds") -> DataFrame:
    """df written to the shared folder and read back, so that a lost executor costs no earlier step."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stash/{name}-{uuid.uuid4().hex}"
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")  # what was shuffled for the table goes as soon as it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def stash_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as stash gives it, in buckets of key: what is grouped by key (and more) or joined on key reads it without a shuffle."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/stash/{table}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)  # a file a bucket
    finally:
        spark.conf.set(clean, before)
    out = spark.table(table)
    out.stash_path, out.stash_table = path, table
    return out


def unstash(*tables: DataFrame) -> None:
    """Free the disk of tables that stash returned and that nothing will read again."""
    for df in tables:
        if hasattr(df, "stash_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.stash_table}")  # its files stay: the path was given
        df.sparkSession.range(0).write.mode("overwrite").parquet(df.stash_path)


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/places/{name}-{uuid.uuid4().hex}"


def give_back() -> None:
    """Return what this process has freed to the system; its own allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which gives back the memory of a task when it ends."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        give_back()

    return tidied
