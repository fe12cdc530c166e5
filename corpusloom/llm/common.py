"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import shared_dir, stash, unstash  # noqa: F401

#: Words are runs of characters other than these ASCII blanks.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows whose measured size is at most this many bytes may be broadcast.
BROADCAST_BYTES = 8 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df for broadcast if its counted rows take at most limit bytes; else leave it to a shuffle join.

    row_bytes bounds the width of a row, so df must have fixed-width columns only.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def stash_by(df: DataFrame, name: str, key: str) -> tuple[DataFrame, int]:
    """df written to the shared folder in buckets of key, and read back, and the number of buckets. Groupings by key, of it or of its union
    with what is dealt to as many partitions by key, read it without a shuffle."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark).rstrip('/')}/stash/{table}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    return spark.table(table), buckets


_held: dict[str, object] = {}


def give_back() -> None:
    """Return what this process has freed to the system; its own allocators keep it otherwise, beside what the next operator takes."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """run, which gives back the memory of a task when it ends."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied


def worker_state(key: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks. It keeps one thing: that of the operator it works for."""
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def push(acc: Column, item: Column, keep: Column) -> tuple[Column, Column]:
    """The fields recent and older of a fold's state, with item, a string without semicolons, added where keep holds. collected(acc) is all
    that was added.

    An array or a string that takes in one item at a time is copied for each; of these two, one stays short and the other is
    copied once for each 4,000 bytes.
    """
    full = F.octet_length(acc["recent"]) >= 4000
    recent = F.when(keep, F.concat(F.when(full, "").otherwise(acc["recent"]), item, F.lit(";"))).otherwise(acc["recent"])
    return recent.alias("recent"), F.when(keep & full, F.concat(acc["older"], acc["recent"])).otherwise(acc["older"]).alias("older")


def nothing() -> tuple[Column, Column]:
    """The fields recent and older at the start of a fold that collects items."""
    return F.lit("").alias("recent"), F.lit("").alias("older")


def collected(acc: Column) -> Column:
    """The items that a fold collected."""
    return F.array_remove(F.split(F.concat(acc["older"], acc["recent"]), ";"), "")


def words(text: Column) -> Column:
    """The words of a text, null as none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def n_words(text: Column) -> Column:
    """The number of words of a text, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
