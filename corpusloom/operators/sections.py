"""Sections of a table of contents: names, order, contents within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .shared import stash


def collision_free_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """df with form (what colliding names share) and file_name; the n-th holder of a form, by order, gets -n."""
    n = F.row_number().over(Window.partitionBy("form").orderBy(order))
    base = X.safe_filename(F.col(name))
    return df.withColumn("form", X.collision_form(F.col(name))).withColumn("n", n).withColumn(
        "file_name", F.when(F.col("n") == 1, base).otherwise(F.concat(base, F.lit("-"), F.col("n").cast("string")))
    ).drop("n")


def within_budget(df: DataFrame, group: list[str], order: list, size: str, budget: int, whole: bool) -> DataFrame:
    """The rows of each group, in order, that fit a budget of characters.

    whole: the running sum, the row included, stays within budget; else a row is taken while the sum of the rows
    before it is below the budget.
    """
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if whole else -1)
    used = F.coalesce(F.sum(size).over(w), F.lit(0))
    return df.withColumn("used", used).where(F.col("used") <= budget if whole else F.col("used") < budget)


def check_toc(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (id, title, parent) of a table of contents that can stand, with their titles trimmed, and the others with why.

    why: "id" where it is null or blank, "title" likewise, "repeated" for all but the first by title and parent of an id. Whether a
    node hangs on a root is told by flatten.
    """
    title = F.trim(F.col("title"))
    why = F.when(F.coalesce(F.trim(F.col("id").cast("string")), F.lit("")) == "", "id").when(F.coalesce(title, F.lit("")) == "", "title")
    seen = rows.withColumns({"title": title, "why": why})
    first = seen.where("why is null").groupBy("id").agg(F.min(F.struct("title", F.coalesce(F.col("parent").cast("string"), F.lit("")).alias("p"), "parent")).alias("f"), F.count("*").alias("n"))
    good = first.select("id", "f.title", "f.parent")
    again = first.where("n > 1").select("id", F.explode(F.sequence(F.lit(2), F.col("n"))).alias("k")).select("id", F.lit(None).cast("string").alias("title"), F.lit("repeated").alias("why"))
    return good, seen.where("why is not null").select("id", "title", "why").unionByName(again)


def flatten(rows: DataFrame, gap: str = " > ") -> tuple[DataFrame, DataFrame]:
    """id, title, crumbs (titles from the root) and depth of the nodes (id, title, parent) of a tree, and the nodes (id, title) that hang on no root.

    Level by level; each level is written, so that none is computed again. Nodes of a circle, or below a parent that isn't there, hang on
    no root. ids are to be distinct, as check_toc leaves them; a tree has as many rounds as levels.
    """
    level = stash(rows.where("parent is null").select("id", "title", F.col("title").alias("crumbs"), F.lit(0).alias("depth")), "toc")
    out, below = level, stash(rows.where("parent is not null"), "toc")
    while not level.isEmpty():
        up = level.select(F.col("id").alias("parent"), F.col("crumbs").alias("above"), "depth")
        level = stash(below.join(up, "parent").select("id", "title", F.concat("above", F.lit(gap), "title").alias("crumbs"), (F.col("depth") + 1).alias("depth")), "toc")
        out = out.unionByName(level)
    return out, rows.join(out.select("id"), "id", "left_anti").select("id", "title")
