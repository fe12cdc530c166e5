"""Operator 4: chat formatting from reply trees.

Replies form trees (one per conversation). Iterative self-joins double the reach of each node's ancestor
link and of each leaf's path, so that a path of n replies takes log2(n) rounds; the joins carry ids only.
Branches are ranked by score, and each chosen path is written as one string with a loss mask.

The template of a turn is "### <role>: <text></turn>" and a newline. Inside roles and texts a backslash
becomes "\\b", "<" becomes "\\l" and "#" becomes "\\h" (in roles ":" becomes "\\c" as well), so no text can
hold a control string, and the change can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import collected, nothing, push, stash

HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
NODES = ["tree", "node", "parent", "role", "text", "score"]


def escape(x: Column) -> Column:
    for raw, safe in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def unescape(x: Column) -> Column:
    for raw, safe in (("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        x = F.replace(x, F.lit(safe), F.lit(raw))
    return x


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit(":"), F.lit("\\c"))


def unescape_role(x: Column) -> Column:
    return unescape(F.replace(x, F.lit("\\c"), F.lit(":")))


def reply_nodes(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each row answers the row before it.

    Rows are ordered by turn, then role and text (nulls first); rows without conv_id form one tree.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return conversations.select(
        F.col("conv_id").alias("tree"), n.alias("node"), F.when(n > 1, n - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def root_to_leaf(nodes: DataFrame) -> DataFrame:
    """tree, leaf, node and steps (replies from the node down to the leaf) of every root-to-leaf path.

    nodes has tree, node and parent; the pair (tree, node) is unique. A node whose parent is missing is a root.
    A cycle, and what hangs on one, has no root and so no path.
    """
    ids = stash(nodes.select("tree", "node", "parent"), "reply-links")
    parents = ids.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    same = lambda a, b: a.eqNullSafe(b)
    jump = stash(
        ids.join(parents, same(F.col("tree"), F.col("t")) & (F.col("parent") == F.col("n")), "left").select("tree", "node", F.col("n").alias("up")), "reply-jumps"
    )
    children = ids.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    path = ids.join(children, same(F.col("tree"), F.col("t")) & (F.col("node") == F.col("p")), "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("steps")
    )
    reach, most = 1, ids.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while reach <= most and not (up := jump.where("up is not null")).isEmpty():
        link = up.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        further = path.join(link, same(F.col("tree"), F.col("t")) & (F.col("node") == F.col("n"))).select(
            "tree", "leaf", F.col("up").alias("node"), (F.col("steps") + reach).alias("steps")
        )
        path = stash(path.unionByName(further), "reply-paths")
        onward = link.withColumnRenamed("up", "up2")
        jump = stash(
            up.join(onward, same(F.col("tree"), F.col("t")) & (F.col("up") == F.col("n"))).select("tree", "node", F.col("up2").alias("up")), "reply-jumps"
        )
        reach *= 2
    if reach <= most or jump.where("up is not null").isEmpty():
        return path
    roots = ids.join(parents, same(F.col("tree"), F.col("t")) & (F.col("parent") == F.col("n")), "left_anti").select(F.col("tree").alias("t"), F.col("node").alias("n"))
    whole = path.join(roots, same(F.col("tree"), F.col("t")) & (F.col("node") == F.col("n")), "left_semi").select(F.col("tree").alias("t"), F.col("leaf").alias("l"))
    return path.join(whole, same(F.col("tree"), F.col("t")) & (F.col("leaf") == F.col("l")), "left_semi")


def best_paths(nodes: DataFrame, paths: DataFrame, branches: int | None = 1) -> DataFrame:
    """The replies on the chosen paths of each tree: all paths, or the best few by summed score (ties: lowest leaf)."""
    n = nodes.withColumnsRenamed({"tree": "t", "node": "n"})
    on_path = paths.join(n, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).drop("t", "n", "parent")
    if branches is None:
        return on_path
    ranked = on_path.groupBy("tree", "leaf").agg(F.sum("score").alias("s"), F.count("*").alias("c"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("s"), "leaf"))).where(F.col("r") <= branches)
    chosen = ranked.select(F.col("tree").alias("t"), F.col("leaf").alias("l"))
    return on_path.join(chosen, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l")), "left_semi")


def write_template(replies: DataFrame) -> DataFrame:
    """tree, leaf, formatted and loss_mask (array of start, end; code points of formatted, end exclusive).

    The mask covers the text of each assistant reply and nothing else. A null role or text counts as empty.
    """
    turn = F.struct((-F.col("steps")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_path = replies.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(HEAD), escape_role(t["role"]), F.lit(MIDDLE))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    start = F.struct(F.lit(0).cast("long").alias("at"), *nothing())

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["head"])
        z = a + F.length(p["body"])
        return F.struct((z + len(TAIL)).alias("at"), *push(acc, F.concat_ws(" ", a.cast("string"), z.cast("string")), p["loss"]))

    def read(acc: Column) -> Column:
        said = F.transform(collected(acc), lambda x: F.split(x, " "))
        return F.transform(said, lambda x: F.struct(x[0].cast("long").alias("start"), x[1].cast("long").alias("end")))

    return by_path.select("tree", "leaf", pieces.alias("pieces")).select(
        "tree",
        "leaf",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(TAIL))), "").alias("formatted"),
        F.aggregate("pieces", start, step, read).alias("loss_mask"),
    )


def format_chats(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """One formatted conversation for each chosen root-to-leaf path of the reply trees.

    nodes: tree, node, parent, role, text, score; other columns are left out. An empty table gives no rows.
    """
    nodes = nodes.select(*NODES)
    return write_template(best_paths(nodes, root_to_leaf(nodes), branches))


def read_template(formatted: DataFrame) -> DataFrame:
    """formatted plus turns (array of role, text) and loss_text, both read back from the formatted string."""
    rows = F.slice(F.split("formatted", "</turn>\n", -1), F.lit(1), F.size(F.split("formatted", "</turn>\n", -1)) - 1)

    def turn(x: Column) -> Column:
        cut = F.locate(MIDDLE, x)
        role = F.substring(x, F.lit(len(HEAD) + 1), cut - 1 - len(HEAD))
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(x, cut + len(MIDDLE), F.length(x))).alias("text"))

    masked = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return formatted.withColumn("turns", F.transform(rows, turn)).withColumn("loss_text", F.array_join(masked, ""))


def chat_digest(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
