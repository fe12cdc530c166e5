"""Rows of the tasks, repositories and chats tables: freshness, upsert, update, delete, latest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_stale(at: Column, now: Column, days: int) -> Column:
    """Older than days before now; null times are stale, and a negative number of days never is."""
    return F.lit(False) if days < 0 else at.isNull() | (at < now - F.expr(f"INTERVAL {days} DAYS"))


def needs_refresh(at: Column, now: Column, fields: list[Column], seconds: int = 86400) -> Column:
    """No time, too old a time, or none of the fields known."""
    unknown = F.lit(True)
    for f in fields:
        unknown = unknown & f.isNull()
    return at.isNull() | (F.unix_seconds(now) - F.unix_seconds(at.cast("timestamp")) >= seconds) | unknown


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with rows of changes added, or laid over the row of their key where a field isn't null."""
    b, c = base.alias("b"), changes.alias("c")
    fields = [F.coalesce(F.col(f"c.{x}"), F.col(f"b.{x}")).alias(x) for x in base.columns]
    return b.join(c, F.col(f"b.{key}") == F.col(f"c.{key}"), "full_outer").select(*fields)


def update_where(df: DataFrame, test: Column, values: dict[str, Column]) -> DataFrame:
    """df with the values set in the rows that meet the test, and updated: whether a row did."""
    changed = {k: F.when(F.col("updated"), v).otherwise(F.col(k)) for k, v in values.items()}
    return df.withColumn("updated", F.coalesce(test, F.lit(False))).withColumns(changed)


def delete_cascade(parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those of the doomed keys."""
    keys = doomed.select(key).distinct()
    return parents.join(keys, key, "left_anti"), children.join(keys, key, "left_anti")


def delete_owned(parents: DataFrame, children: DataFrame, asked: DataFrame, key: str, owner: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parents and children without those that their owner asks to delete, and asked with deleted: whether the key was there and the owner's.

    asked: key and owner. A null owner owns nothing. Requests that repeat are answered each.
    """
    own = asked.join(parents.select(key, owner).distinct(), [key, owner], "left_semi").select(key).distinct()
    told = asked.join(own.withColumn("deleted", F.lit(True)), key, "left").join(parents.select(key, F.col(owner).alias("_owner")), key, "left")
    told = told.withColumn("deleted", F.coalesce(F.col("deleted") & (F.col(owner) == F.col("_owner")), F.lit(False))).select(*asked.columns, "deleted")
    return *delete_cascade(parents, children, own, key), told


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key: the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def last_turns(df: DataFrame, group: str, turn: str, text: Column, n: int) -> DataFrame:
    """group and recent: the last n turns in order, one line each."""
    w = Window.partitionBy(group).orderBy(F.desc(turn))
    rows = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).select(group, F.struct(F.col(turn).alias("t"), text.alias("x")).alias("s"))
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "\n").alias("recent"))
