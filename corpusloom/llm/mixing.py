"""Operator 1: mixing sources to target weights.

A document's place is a hash. Each source takes whole rounds of its documents and, for the rest of its
target, those below a threshold of the hash. The threshold comes from nested histograms: words are summed
by source and hash bucket, the bucket in which the target falls is found, and only that bucket is summed
again by finer ones. Documents are then filtered by comparing hashes; nothing is sorted but bucket sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stash

#: Bits of the hash that each level of histograms resolves; after the last a bucket is 2**-36 of a source.
LEVELS = (12, 12, 12)
#: Shares of a source's rows, so that a join with the few rows of a plan spreads a large source.
SALTS = 32


def _place(text: str = "text") -> Column:
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.col(text)), 4)


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size in words and place (a hash of 60 bits) of every document."""
    return docs.select("doc_id", "source", n_words(F.col(text)).alias("size"), _place(text).alias("place"))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size and target of each source.

    Sources by code point, null last, have the weights, repeating. They share `share` times all sizes by
    weight; a target stops at `most` times its source's size, and the excess is shared again by weight among
    the others until none is above. The water level is found from sums over the sources ordered by the level
    at which each is full, so no round of sharing is needed.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    choice = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.get(choice, (rank % len(weights)).cast("int"))).withColumn("cap", most * F.col("source_size"))
    full_first = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    per = per.withColumn("full", F.coalesce(F.sum("cap").over(full_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("left", F.sum("w").over(full_first.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", (share * F.sum("source_size").over(everything) - F.col("full")) / F.col("left"))
    # the first source that the level of the rest doesn't fill sets the level for all after it
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything)
    return per.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def _cumulative(level: int) -> tuple[Column, int]:
    """Bucket number of a place at a level, and the bits below it."""
    below = 60 - sum(LEVELS[: level + 1])
    return F.shiftright("place", below), below


def thresholds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """source, source_size, target, rounds (times that all of the source is taken) and below (documents with a
    lower place are taken once more)."""
    at = plan.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    at = at.withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
    state, rows = stash(at, "mix-plan"), sizes
    for level in range(len(LEVELS)):
        bucket, below = _cumulative(level)
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        sums = sums.withColumn("upto", upto).withColumnRenamed("source", "s")
        hit = sums.join(state, F.col("s").eqNullSafe(F.col("source"))).where("upto > rest and upto - words <= rest")
        last = level == len(LEVELS) - 1
        # the final bucket is taken if that brings the sum nearer to the target
        limit = F.when(F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("words")), F.col("bucket") + 1).otherwise(F.col("bucket")) if last else F.col("bucket")
        found = hit.select("source", F.shiftleft(limit, below).alias("b"), (F.col("rest") - (F.col("upto") - F.col("words"))).alias("r"), F.col("bucket").alias("k"))
        found = stash(found, "mix-buckets")
        other = found.select(F.col("source").alias("s"), "b", "r")
        state = stash(
            state.join(other, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "rounds", F.coalesce("r", "rest").alias("rest"),
                F.coalesce("b", *([F.col("below")] if level else []), F.lit(0).cast("long")).alias("below"),
            ),
            "mix-plan",
        )
        if not last:
            edge = found.select(F.col("source").alias("s"), "k")
            rows = stash(rows.join(edge, F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("k"))).select("source", "size", "place"), "mix-edge")
    return state.drop("rest")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, place) with source_size, target and copies; a large source is spread over SALTS shares."""
    dealt = plan.withColumnRenamed("source", "_s").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod("place", F.lit(SALTS)).cast("int")
    joined = rows.withColumn("_own", own).join(dealt, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_own") == F.col("_k")))
    return joined.withColumn("copies", F.col("rounds") + (F.col("place") < F.col("below")).cast("long")).drop("_s", "_k", "_own", "rounds", "below")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (how often the mix takes the document) of every row of docs.

    Sizes are words of the whole text (null: 0). A null source is a source. Rows of one source with the same
    doc_id and text have one place and are taken alike. Other columns of docs are not read. An empty table
    gives no rows. Deterministic: places depend on doc_id and text only.
    """
    sizes = stash(sized(docs), "mix-sizes")
    plan = thresholds(sizes, targets(sizes, weights, share, most))
    return _with_plan(sizes, plan).select("doc_id", "source", "size", "source_size", "target", "copies")


def take(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs as the mix takes them, each as often as it has copies."""
    sizes = stash(sized(docs), "mix-sizes")
    plan = thresholds(sizes, targets(sizes, weights, share, most)).select("source", "rounds", "below")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "source", _place().alias("place"))
    placed = _with_plan(rows, plan).where("copies > 0")
    return placed.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")
