"""Stored postings, budgets, line searches in rows, tables of contents, ownership, communities by levels, settled ranks."""

import random

import numpy as np
import pytest
from corpusloom.operators import budget, graph, lines, search, sections, tables
from corpusloom.operators.shared import place
from corpusloom.sources import postings
from pyspark.sql import functions as F


def scores(df, by=("qid", "id")):
    return sorted((*(r[c] for c in by), round(r.score, 9)) for r in df.collect())


def test_stored_postings_grow_by_batches(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join(rnd.choices(words, k=rnd.randint(0, 40)))) for k in range(60)] + [(60, None), (61, "the only one")]
    docs = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w2 only"), (2, "nothing here"), (3, None)], "qid long, text string")
    index = postings.create_index(spark, place(spark, "test"), buckets=4)
    assert postings.search(index, asked).count() == 0
    postings.add_documents(index, docs.where("id < 20"))
    postings.add_documents(index, docs.where("id < 40").unionByName(docs.where("id = 30")))  # the first rows and one of the new come twice
    postings.add_documents(index, docs.unionByName(spark.createDataFrame([(None, "w1")], docs.schema)))
    want = scores(search.bm25(docs, asked))
    assert want and scores(postings.search(index, asked)) == want
    assert index.sizes().first().n == 62
    again = postings.open_index(spark, index.path)
    assert scores(postings.search(again, asked)) == want
    # a batch that broke off: its postings are there, its row of statistics isn't
    spark.table(postings._name(index.path, "postings")).withColumns({"batch": F.lit("lost"), "id": F.col("id") + 1000}).write.format("parquet").mode("append").bucketBy(4, "key").sortBy("key").option(
        "path", f"{index.path}/postings"
    ).saveAsTable(postings._name(index.path, "postings"))
    assert scores(postings.search(again, asked)) == want


def test_postings_are_not_shuffled(spark):
    docs = spark.createDataFrame([(k, f"a b{k}") for k in range(50)], "id long, text string")
    index = postings.create_index(spark, place(spark, "test"), buckets=4)
    postings.add_documents(index, docs)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = postings.search(index, spark.createDataFrame([(1, "a")], "qid long, text string"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rows = plan.splitlines()
    at = next(k for k, x in enumerate(rows) if "postings_" in x)
    assert "SelectedBucketsCount: 1 out of 4" in rows[at]
    depth = lambda x: len(x) - len(x.lstrip(" :|+-"))
    here, above = depth(rows[at]), []
    for x in reversed(rows[:at]):
        if depth(x) < here:
            here = depth(x)
            above.append(x)
            if "Join" in x:
                break
    assert "SortMergeJoin" in above[-1] and not any("Exchange" in x for x in above)


def test_postings_in_slices_and_parts(spark):
    docs = spark.createDataFrame([(k, f"a b{k % 3}", ["x", "y", None][k % 3]) for k in range(40)], "id long, text string, part string")
    asked = spark.createDataFrame([(1, "a b1")], "qid long, text string")
    index = postings.create_index(spark, place(spark, "test"), part={"part": "string"}, documents=12_000_000, buckets=4)
    assert index.slices == 3
    postings.add_documents(index, docs)
    known = docs.where("part is not null")
    assert scores(postings.search(index, asked), ("qid", "part", "id")) == scores(search.bm25(known, asked, ["part"]), ("qid", "part", "id"))
    scoped = asked.withColumn("part", F.lit("y"))
    assert scores(postings.search(index, scoped), ("qid", "part", "id")) == scores(search.bm25(known, scoped, ["part"]), ("qid", "part", "id"))


@pytest.mark.parametrize("part_rows", [1, 7, 1000])
def test_running_total_with_ties(spark, part_rows):
    rnd = random.Random(part_rows)
    rows = [(rnd.choice([1, 2, None]), rnd.choice([0, 1, 5, None]), "mine") for _ in range(60)] + [(1, 3, "same")] * 20
    df = spark.createDataFrame(rows, "k int, cost int, used string")
    got = sorted(budget.running_total(df, [F.desc("k")], "cost", part_rows=part_rows).collect(), key=lambda r: r.used)
    total = sum(c or 0 for _, c, _ in rows)
    assert len(got) == len(rows) and got[-1].used == total
    keys = [-1 if r.k is None else r.k for r in sorted(got, key=lambda r: (r.used, -(r.k or -1)))]
    assert keys == sorted(keys, reverse=True)
    at = 0
    for k in (2, 1, None):  # each key's rows fill its stretch
        own = [r for r in got if r.k == k]
        at += sum(r.cost or 0 for r in own)
        assert max(r.used for r in own) == at
    assert budget.running_total(df.limit(0), [F.desc("k")], "cost").count() == 0


def test_token_budget(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d"), (3, None), (4, "e f"), (5, "g")], "k int, text string")
    took = lambda n, **k: sorted((r.k, r.used) for r in budget.within_tokens(df, [F.asc("k")], F.col("text"), n, **k).collect())
    assert took(2) == [] and took(4) == [(1, 3), (2, 4), (3, 4)] and took(6)[-1] == (4, 6) and len(took(100)) == 5
    letters = lambda t: F.coalesce(F.length(t), F.lit(0)).cast("long")
    assert took(6, tokens=letters) == [(1, 5), (2, 6), (3, 6)]


def test_lines_in_rows(spark):
    texts = [("a", "x\nHit one\ny\nz\nhit"), ("b", "hit"), ("c", ""), ("d", None), ("e", "no"), ("b", "hit")]
    files = lines.file_lines(spark.createDataFrame(texts, "path string, text string"))
    got = sorted(tuple(r) for r in lines.grep(files, lambda t: lines.line_test(t, "hit")).collect())
    assert got == [("a", 2, "Hit one", "x", "y\nz"), ("a", 5, "hit", "y\nz", ""), ("b", 1, "hit", "", ""), ("b", 1, "hit", "", "")]
    scopes = sorted((r.path, r.line, r.scope or "") for r in lines.enclosing(files, lambda t: F.when(t.startswith("H"), t)).collect() if r.path in "ac")
    assert scopes == [("a", 1, ""), ("a", 2, "Hit one"), ("a", 3, "Hit one"), ("a", 4, "Hit one"), ("a", 5, "Hit one"), ("c", 1, "")]
    shown = [tuple(r) for r in lines.shown_from(files, lambda t: F.regexp_extract(t, r"^Hit (\w+)", 1), 3).collect()]
    assert shown == [("a", 2, "one", "Hit one\ny\nz")]
    for most, want in ((2, True), (4, False)):
        more, hits = lines.match_summary(files, lambda t: lines.line_test(t, "hit"), most)
        assert hits.agg(more).first()[0] is want
    for at, want in (([1, 1], "│x\n│Hit one\n⋮"), ([5, 9], "⋮\n│z\n│hit"), ([], ""), ([1, 4], "│x\n│Hit one\n│y\n│z\n│hit"), ([1, 5], "│x\n│Hit one\n⋮\n│z\n│hit")):
        row = files.where("path = 'a'").select(lines.of_interest(F.col("lines"), F.array(*map(F.lit, at)).cast("array<int>"))).first()[0]
        assert row == want
    assert lines.grep(files.limit(0), lambda t: lines.line_test(t, "hit")).count() == 0


def test_toc(spark):
    rows = [(1, "root", None), (2, " a ", 1), (3, "b", 2), (None, "x", 1), (4, " ", 1), (5, None, 1), (2, "z", 3), (2, "y", 3), (6, "circle", 7), (7, "circle", 6), (8, "lost", 99), (9, "self", 9)]
    good, bad = sections.check_toc(spark.createDataFrame(rows, "id long, title string, parent long"))
    assert sorted((r.why, r.id) for r in bad.collect() if r.id) == [("repeated", 2), ("repeated", 2), ("title", 4), ("title", 5)] and bad.where("why = 'id'").count() == 1
    placed, lost = sections.flatten(good)
    assert sorted(map(tuple, placed.collect())) == [(1, "root", "root", 0), (2, "a", "root > a", 1), (3, "b", "root > a > b", 2)]
    assert sorted(r.id for r in lost.collect()) == [6, 7, 8, 9]
    assert [df.count() for df in sections.flatten(good.limit(0))] == [0, 0]


def test_only_owners_delete(spark):
    chats = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "chat long, user string")
    messages = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, "w")], "chat long, text string")
    asked = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, None), (9, "a")], "chat long, user string")
    left, kept, told = tables.delete_owned(chats, messages, asked, "chat", "user")
    assert sorted(r.chat for r in left.collect()) == [2, 3] and sorted(r.text for r in kept.collect()) == ["w", "z"]
    assert sorted((r.chat, r.deleted) for r in told.collect()) == [(1, True), (1, True), (2, False), (3, False), (9, False)]


def test_communities_by_levels(spark):
    rnd = random.Random(1)
    pairs = [(j, i, rnd.choice([1.0, 2.0])) for i in range(60) for j in range(i) if rnd.random() < (0.6 if i // 12 == j // 12 else 0.02)]
    edges, nodes = spark.createDataFrame(pairs, "a long, b long, weight double"), spark.range(62)
    found = graph.communities(edges, nodes, resolution=1.0)
    label = {r.id: r.community for r in found.collect()}
    assert len(label) == 62 and sorted(set(label.values())) == list(range(max(label.values()) + 1)) and label[60] != label[61]
    assert label == {r.id: r.community for r in graph.communities(edges.repartition(3), nodes, resolution=1.0).collect()}
    planted = nodes.select("id", F.floor(F.col("id") / 12).alias("label"))
    got = graph.modularity(edges, found.withColumnRenamed("community", "label"))
    assert got >= 0.95 * graph.modularity(edges, planted)
    near = {i: {i} for i in label}  # each community hangs together
    for a, b, _ in pairs:
        if label[a] == label[b]:
            near[a].add(b)
            near[b].add(a)
    for c in set(label.values()):
        own = {i for i in label if label[i] == c}
        seen, todo = set(), [min(own)]
        while todo:
            seen.add(i := todo.pop())
            todo += near[i] - seen
        assert seen == own
    ones = graph.communities(edges, nodes, resolution=1.0, weighted=False)
    assert {r.id: r.community for r in ones.collect()} == {r.id: r.community for r in graph.communities(edges.withColumn("weight", F.lit(1.0)), nodes, resolution=1.0).collect()}


def test_settled_ranks(spark):
    rnd = random.Random(4)
    n, names = 30, [f"n{k}" for k in range(12)]
    defs = sorted({(rnd.randrange(n), rnd.choice(names)) for _ in range(25)})
    refs = sorted({(rnd.randrange(n), rnd.choice(names)) for _ in range(60)})
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string")
    got = {r.id: r.rank for r in graph.name_pagerank(frame(defs), frame(refs), spark.range(n), rounds=200, tolerance=1e-9).collect()}
    weight = np.zeros((n, n))
    for a, x in refs:
        for b, y in defs:
            if x == y and a != b:
                weight[b, a] += 1
    out = weight.sum(0)
    step = np.where(out > 0, weight / np.where(out > 0, out, 1), 1.0 / n)
    rank = np.linalg.solve(np.eye(n) - 0.85 * step, np.full(n, 0.15 / n))
    assert np.allclose([got[k] for k in range(n)], rank, atol=1e-7)
