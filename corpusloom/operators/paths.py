"""Matching paths, sections and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Heads of paths that name a machine and not a place in a repository.
MACHINE_HEADS = (r"^/home/[^/]+/", r"^/Users/[^/]+/", r"^/root/", r"^/app/", r"^/tmp/[^/]+/", r"^[A-Za-z]:[\\/]", r"^\./")


def suffixes(path: Column) -> Column:
    """The endings of a path that begin at a segment, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def match_paths(asked: DataFrame, known: DataFrame) -> DataFrame:
    """path, key and how of each asked path (path) with the known one (key, place) it means.

    The same path; else the lowest place of those that end in the path, or in which it ends, by whole segments; else
    what stands before a colon. Endings are keys, so each step is an equality join.
    """
    k = known.select("key", "place", F.explode(suffixes(F.col("key"))).alias("end"))
    a = asked.select("path").distinct()
    bare = a.withColumn("file", F.regexp_replace("path", ":[^/]*$", ""))
    exact = bare.join(known.select(F.col("key").alias("path"), F.col("key"), "place"), "path").select("path", "key", "place", F.lit(1).alias("how"))
    longer = bare.join(k.select(F.col("end").alias("path"), "key", "place"), "path").select("path", "key", "place", F.lit(2).alias("how"))
    shorter = bare.select("path", F.explode(suffixes(F.col("path"))).alias("end")).join(known.select(F.col("key").alias("end"), "key", "place"), "end").select("path", "key", "place", F.lit(2).alias("how"))
    inside = bare.where("file <> path").join(known.select(F.col("key").alias("file"), "key", "place"), "file").select("path", "key", "place", F.lit(3).alias("how"))
    order = Window.partitionBy("path").orderBy("how", "place")
    return exact.unionByName(longer).unionByName(shorter).unionByName(inside).withColumn("n", F.row_number().over(order)).where("n = 1").select("path", "key", "how")


def without_machine(path: Column) -> Column:
    for p in MACHINE_HEADS:
        path = F.regexp_replace(path, p, "")
    return path


def split_valid(asked: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The asked rows (path) whose path is known, and the others; paths that climb are never valid."""
    climbs = F.array_contains(F.split("path", "/"), "..")
    good = asked.where(~climbs).join(known.select("path").distinct(), "path", "left_semi")
    bad = asked.join(known.select("path").distinct(), "path", "left_anti").unionByName(asked.where(climbs).join(known.select("path").distinct(), "path", "left_semi"))
    return good, bad


def section_dependencies(files: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """section and needs: the first files, by path, outside a section that its files (section, file) point to (src, dst)."""
    out = files.join(edges.select(F.col("src").alias("file"), "dst"), "file").select("section", F.col("dst").alias("file")).distinct()
    out = out.join(files, ["section", "file"], "left_anti")
    first = out.withColumn("n", F.row_number().over(Window.partitionBy("section").orderBy("file"))).where(F.col("n") <= most)
    return first.groupBy("section").agg(F.array_join(F.array_sort(F.collect_list("file")), ", ").alias("needs"))


def class_hierarchy(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """id, parents, children, methods (the first by name) and more for each class."""
    c = nodes.where("type = 'class'").select("id")
    names = lambda kind, near, far, to: (
        edges.where(F.col("type") == kind).join(nodes.select(F.col("id").alias(far), "name"), far).groupBy(F.col(near).alias("id")).agg(F.array_sort(F.collect_list("name")).alias(to))
    )
    out = c.join(names("inherits", "src", "dst", "p"), "id", "left").join(names("inherits", "dst", "src", "q"), "id", "left").join(names("contains", "src", "dst", "m"), "id", "left")
    some = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    m = some(F.col("m"))
    return out.select("id", F.array_join(some(F.col("p")), ",").alias("parents"), F.array_join(some(F.col("q")), ",").alias("children"), F.array_join(F.slice(m, 1, most), ",").alias("methods"), F.greatest(F.size(m) - most, F.lit(0)).alias("more"))
