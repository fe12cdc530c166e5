"""Operators that SQL can't check, against plain Python, and edge cases."""

from collections import Counter

import pytest
from corpusloom.functions import text as X
from corpusloom.operators import chunks, files, graph, lines, search, tables
from corpusloom.sources import stores
from pyspark.sql import functions as F


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("git@GitHub.com:Own/Repo.git", "https://github.com/own/repo"), ("https://GitHub.com/Own/Repo.git/", "https://github.com/own/repo"), ("https://host/", "https://host"),
        ("https://h/a//b/c", "https://h/a/b"), ("  ", ""), (None, ""), ("Local.git/", "local"),
    ],
)
def test_repo_urls(spark, url, want):
    assert one(spark, url, X.normalize_repo_url) == want


def test_titles_and_text(spark):
    assert one(spark, "", X.chat_title) == "New chat"
    assert one(spark, "Question:  Why? Because", X.chat_title) == "Why"
    assert one(spark, "a" * 50, X.chat_title) == "a" * 40 + "..."
    assert one(spark, "x {a: {b}} y }", X.json_block) is None and one(spark, "```json\n{\"a\": 1}\n```", X.json_block) == '{"a": 1}'
    assert one(spark, "a.py:12", X.line_in_text) == 12 and one(spark, "none", X.path_in_text) == "unknown"
    assert one(spark, None, X.lexical_intent) is None and one(spark, "Thanks!!", X.lexical_intent) == "general"
    assert one(spark, "你好 World_1", X.tokenize) == ["你好", "world_1"]


def test_paragraphs_with_long_ones(spark):
    long = " ".join(f"Sentence number {i} is here." for i in range(150))
    fence = "```\n" + "x\n" * 1500 + "```"
    text = "\n\n".join(["first", "second", long, "third", fence, "", "last"])
    got = one(spark, text, chunks.paragraphs)
    assert got[0] == "first\n\nsecond" and got[-1].endswith("last") and all(len(c) <= 2000 for c in got if "```" not in c)
    assert got[1:3] == one(spark, long, chunks.sentences)[:2] and any(c.startswith("third") for c in got)
    assert one(spark, "", chunks.paragraphs) == [] and one(spark, "a" * 2001, chunks.paragraphs) == ["a" * 2001]


def test_normalized_code_chunks(spark):
    rows = [("f", 1, 2, "a", "x" * 100), ("f", 3, 4, "b", "y" * 100), ("f", 5, 6, "c", "z" * 500), ("f", 7, 8, "d", "l\n" * 1500), ("g", 1, 1, "e", "w")]
    out = chunks.normalize_code_chunks(spark.createDataFrame(rows, "file string, start_line int, end_line int, name string, content string")).orderBy("file", "chunk", "part").collect()
    assert [(r.file, r.start_line, r.end_line, r.name) for r in out] == [("f", 5, 6, "c"), ("f", 7, 8, "d"), ("f", 7, 8, "d"), ("g", 1, 1, "e")]
    assert out[0].content == "x" * 100 + "\n\n" + "y" * 100 + "\n\n" + "z" * 500


def test_mmr(spark):
    docs = {1: "a b c", 2: "a b c", 3: "a d", 4: "x y", 5: ""}
    rows = [(7, i, t.split(), "a b".split(), 0.1 * i) for i, t in docs.items()]
    got = search.mmr(spark.createDataFrame(rows, "qid long, id long, tokens array<string>, question_tokens array<string>, final double"), n=5).orderBy("pick").collect()
    left, chosen, count = dict(docs), [], {i: Counter(t.split()) for i, t in docs.items()}
    while left:
        score = {}
        for i in left:
            like = search.cosine(count[i], Counter("ab")) or 0.1 * i
            score[i] = (round(0.5 * like - 0.5 * max([search.cosine(count[i], count[j]) for j in chosen], default=0), 12), 0.1 * i)
        chosen.append(max(score, key=score.get))
        del left[chosen[-1]]
    assert [r.id for r in got] == chosen


def test_dense_search_blocks_and_nulls(spark):
    v = spark.createDataFrame([(i, [float(i % 3), float(i % 5)]) for i in range(30)] + [(99, None)], "id long, embedding array<double>")
    asked = v.where("id in (3, 4, 5, 99)").withColumnRenamed("id", "qid")
    one_block, many = (sorted(map(tuple, search.dense_search(v, asked, 3, block=b).collect())) for b in (10, 1))
    assert one_block == many and len(many) == 9
    assert search.dense_search(v, asked.limit(0), 3).count() == 0


def test_communities(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abc" for i in range(5) for j in range(i)] + [("a0", "b0", 1.0), ("b1", "c1", 1.0)]
    edges = spark.createDataFrame(cliques, "a string, b string, weight double")
    nodes = spark.createDataFrame([(f"{c}{i}",) for c in "abcd" for i in range(5)], "id string")
    got = graph.communities(edges, nodes, resolution=1.0).collect()
    assert len(got) == 20 and len({r.id for r in got}) == 20
    by = {r.id: r.community for r in got}
    for u, v, _ in cliques:
        assert (by[u] == by[v]) == (u[0] == v[0])
    labels = spark.createDataFrame([(k, str(v)) for k, v in by.items()], "id string, label string")
    alone = nodes.withColumn("label", F.col("id"))
    assert graph.modularity(edges, labels) > max(graph.modularity(edges, alone), 0)
    assert {r.community for r in graph.communities(edges.limit(0), nodes).collect()} == {0}


def test_import_candidates(spark):
    files = spark.createDataFrame([(x,) for x in ("a/b.py", "a/c/__init__.py", "web/x.tsx", "web/lib/index.ts", "top.py")], "file string")
    asked = [("a/d.py", ".b"), ("a/d.py", "a.c"), ("a/e/f.py", "..b"), ("a/d.py", "os"), ("web/y.ts", "./x"), ("web/y.ts", "./lib"), ("web/q/z.ts", "../x"), ("web/y.ts", "react"), ("top.py", "top")]
    got = graph.resolve_imports(spark.createDataFrame(asked, "file string, module string"), files).collect()
    assert {(r.src, r.dst) for r in got} == {("a/d.py", "a/b.py"), ("a/d.py", "a/c/__init__.py"), ("a/e/f.py", "a/b.py"), ("web/y.ts", "web/x.tsx"), ("web/y.ts", "web/lib/index.ts"), ("web/q/z.ts", "web/x.tsx")}


def test_files(spark):
    paths = ["a/.git/x", "LICENSE", "src/a.py", "node_modules/m/a.js", "x/node_modules/b.js", "a.min.js", "b[1].txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in df.where(~files.excluded(F.col("path"), ["./node_modules/", "*.min.js"]) & files.kept(F.col("path"))).collect()] == ["src/a.py", "b[1].txt"]
    assert one(spark, "../etc", lambda c: files.under(c, "src")) is False and one(spark, "srcx/a", lambda c: files.under(c, "src")) is False


def test_line_test_refuses_empty():
    with pytest.raises(ValueError, match="empty"):
        lines.line_test(None, "")


def test_update_of_null_test(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, x int")
    assert sorted(map(tuple, tables.update_where(df, F.col("x") > 1, {"x": F.lit(0)}).collect())) == [(1, None, False), (2, 0, True)]


def test_scan_tree(spark, tmp_path):
    for name, body in (("a.py", b"x = 1\n"), ("b.bin", b"\x00\x01"), ("d/c.txt", "é".encode()), ("bad.txt", b"\xff\xfe"), (".git/h", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    good, bad = stores.decoded(stores.scan_tree(spark, str(tmp_path)))
    assert {r.path: r.text for r in good.collect()} == {"a.py": "x = 1\n", "d/c.txt": "é"} and [r.path for r in bad.collect()] == ["bad.txt"]


def test_ranks_through_names_are_those_of_all_edges(spark):
    from corpusloom.operators import graph as G

    defs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c"), (4, None)], "id long, name string")
    refs = spark.createDataFrame([(1, "a"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (4, "z")], "id long, name string")
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    edges = refs.withColumnRenamed("id", "src").join(defs.withColumnRenamed("id", "dst"), "name").where("src <> dst").groupBy("src", "dst").count().withColumnRenamed("count", "weight")
    want = {r.id: round(r["rank"], 9) for r in G.pagerank(edges, nodes).collect()}
    assert {r.id: round(r["rank"], 9) for r in G.name_pagerank(defs, refs, nodes).collect()} == want
    assert G.name_pagerank(defs.limit(0), refs, nodes).count() == 5 and G.name_pagerank(defs, refs, nodes.limit(0)).count() == 0


def test_values_from_outside(spark):
    from corpusloom.functions import values as V

    raws = [None, "", "{", "{} x", "{}}", "{}]", '{},{"a":1}', "{},null", "[{}]", '"{}"', " {\"a\": [1]} ", "{}"]
    got = [r.o for r in spark.createDataFrame(list(enumerate(raws)), "i int, raw string").orderBy("i").select(V.json_object(F.col("raw")).alias("o")).collect()]
    assert got == ["{}"] * 10 + raws[10:]
    stars = spark.createDataFrame([(" 12 ",), ("-3",), ("--3",), ("3.5",), ("",), (None,), ("9" * 30,)], "s string").select(V.star_count(F.col("s")).alias("n")).collect()
    assert [r.n for r in stars] == [12, -3, None, None, None, None, None]
