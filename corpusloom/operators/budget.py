"""Prefixes of an order that fit a budget, over tables of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .shared import stash

#: Bytes of part totals that may be broadcast.
BROADCAST_BYTES = 8 << 20


def token_count(text: Column) -> Column:
    """Tokens of a text as the sparse search sees them; null as 0."""
    return F.size(tokenize(text)).cast("long")


def running_total(rows: DataFrame, order: list[Column], cost: str, name: str = "used", part_rows: int = 1_000_000) -> DataFrame:
    """rows with name, the sum of cost over all rows up to this one in the order. Null costs are 0.

    A prefix sum in parts: the order is cut into ranges of about part_rows rows, each sums its own, and the totals of the parts
    before are added. The order is of columns of rows. Rows that the order doesn't tell apart are ordered by a hash of their columns, and by their place where
    they are equal, so that ties are cut like anything else. A column of rows with the new one's name is replaced.
    """
    own = [c for c in rows.columns if c.lower() != name.lower()]
    clear = rows.select(*own, F.coalesce(F.col(cost), F.lit(0)).cast("long").alias("_cost"), F.xxhash64(*own).alias("_tie"), F.monotonically_increasing_id().alias("_place"))
    ties = [F.col("_tie"), F.col("_place")]
    parts = max(1, -(-rows.count() // part_rows))
    dealt = stash(clear.repartitionByRange(parts, *order, *ties).withColumn("_part", F.spark_partition_id()), "ranges")
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    totals = dealt.groupBy("_part").agg(F.sum("_cost").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before"))
    totals = F.broadcast(totals) if parts * 16 <= BROADCAST_BYTES else totals
    within = F.sum("_cost").over(Window.partitionBy("_part").orderBy(*order, *ties).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_within", within).join(totals, "_part").select(*own, (F.col("_within") + F.col("_before")).alias(name))


def within_tokens(rows: DataFrame, order: list[Column], text: Column, budget: int, tokens: Callable[[Column], Column] = token_count) -> DataFrame:
    """The longest prefix of rows, in the order, whose texts have at most budget tokens together, with used, the tokens so far.

    tokens counts the tokens of a text; the default is the sparse search's, a tokenizer's own count is another.
    """
    own = [c for c in rows.columns if c.lower() != "used"]
    return running_total(rows.select(*own, tokens(text).alias("_tokens")), order, "_tokens").where(F.col("used") <= budget).drop("_tokens")
