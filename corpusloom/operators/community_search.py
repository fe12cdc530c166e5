"""Retrieval through communities: find the communities of a question, then search inside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import bm25, fuse, min_max, top_k
from .shared import stash


def community_search(
    summaries: DataFrame, members: DataFrame, questions: DataFrame, communities: int = 3, each: int = 5, k: int = 10, deep: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """qid, id, score and rank: the best documents inside the communities whose summaries match best.

    summaries: community, text; members: community, id, text; questions: qid, text. Inside a community its own
    statistics count. A document keeps its best score. Questions that no summary matches search all members, which
    are read for those only. deep(questions with community) gives the scores inside communities from a stored index
    of the members; without it they are read here.
    """
    matched = stash(top_k(bm25(summaries.withColumnRenamed("community", "id"), questions), ["qid"], "score", "id", communities).select("qid", F.col("id").alias("community")), "matched")
    scoped = matched.join(questions.select("qid", "text"), "qid")
    found = deep(scoped) if deep else bm25(members, scoped, ["community"])
    best = top_k(found, ["qid", "community"], "score", "id", each).groupBy("qid", "id").agg(F.max("score").alias("score"))
    rest = questions.join(matched.select("qid").distinct(), "qid", "left_anti")
    if not rest.isEmpty():
        everywhere = bm25(members.select("id", "text").dropDuplicates(["id"]), rest)
        best = best.unionByName(everywhere.select("qid", "id", "score"))
    return top_k(best, ["qid"], "score", "id", k)


def community_hybrid(inside: DataFrame, dense: DataFrame, weight: float = 0.6, k: int = 10) -> DataFrame:
    """Community hits and dense hits (qid, id, score), each scaled per question, fused and cut to k."""
    scaled = lambda df: df.withColumn("score", min_max("score", ["qid"]))
    return top_k(fuse(scaled(dense), scaled(inside), ["qid"], weight), ["qid"], "final", "id", k)
