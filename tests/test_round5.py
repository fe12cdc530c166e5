"""Memory that workers keep; searches, ranks and communities whose work grows with their input."""

import random
import re
import time
from collections import Counter

import pyarrow as pa
from corpusloom.llm import alignment, common
from corpusloom.llm.queries import BYTE_BPE, PIECES
from corpusloom.operators import graph, lines, shared
from corpusloom.sources import postings


def test_aligner_forgets_after_a_task(spark):
    """A worker that has aligned stays idle beside those of the next stages: what it remembers of texts goes with the task."""
    docs = spark.createDataFrame([(i, f"some words, number {i}") for i in range(400)], "doc_id long, text string").repartition(4)
    assert len(alignment.align(docs, BYTE_BPE, PIECES).collect()) == 400

    def held(batches):
        for _ in batches:
            time.sleep(0.2)
            aligners = [len(x.stretch) + len(x) + len(x.shown) for x in common._held.values() if isinstance(x, alignment.Aligner)]
            yield pa.RecordBatch.from_pydict({"n": aligners}, pa.schema([("n", pa.int64())]))

    kept = [r.n for r in spark.range(0, 16, 1, 16).mapInArrow(held, "n long").collect()]
    assert kept and not any(kept)


def shuffles(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_links_stay_where_they_lie(spark):
    links = spark.range(1000).selectExpr("id % 50 AS a", "id % 7 AS b", "1.0D AS weight")
    both = shared.stash_by(links, "links", "a")
    label = spark.range(50).selectExpr("id AS b", "id % 3 AS label")
    near = both.join(graph._few(label.selectExpr("b AS id"))(label), "b").groupBy("a", "label").agg({"weight": "sum"})
    assert shuffles(near) == 0 and sum(r["sum(weight)"] for r in near.collect()) == 1000.0
    shared.unstash(both)
    assert not spark.catalog.tableExists(both.stash_table)


FORMS = (
    r"(?:def|class)\s+{}\b", r"(?:function|class)\s+{}\b", r"(?:const|let|var)\s+{}\s*(?:=|:)", r"export\s+(?:function|class|const)\s+{}\b",
    r"func\s+{}\b", r"fn\s+{}\b", r"(?:public|private|protected|static).*\s{}\s*\(",
)


def test_definitions_by_names(spark):
    rnd = random.Random(3)
    parts = ["def", "class", "function", "func", "fn", "undef", "export", "const", "let", "var", "public", "static", "Foo", "bar", "x1", "=", ":", "(", " (", "é", ".", ",", ";", "\t", "_"]
    texts = ["def class Foo", "export const bar;", "var bar: int", "var bar, Foo = 1", "public void Foo (x) bar(", "const  x1=2", "undef Foo(", "def Fooé", "static bar"]
    texts += ["".join(rnd.choice(parts) + rnd.choice(["", " ", " ", "  "]) for _ in range(rnd.randint(1, 9))) for _ in range(800)]
    words = ["Foo", "bar", "x1", "class", "const", "_", "Fo"]
    frame = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "path long, line int, text string")
    asked = spark.createDataFrame([(w, None) for w in words], "symbol string, hint long")
    holds = lambda w, t: w in re.findall(r"\w+", t, re.A) and any(re.search(f.replace("{}", w), t, re.A) for f in FORMS)
    want = {(w, k) for w in words for k, t in enumerate(texts) if holds(w, t)}
    got = {(r.symbol, r.path) for r in lines.definitions(frame, asked).collect()}
    assert got == {(w, min(k for v, k in want if v == w)) for w in {w for w, _ in want}}
    for t in range(0, len(texts), 90):
        some = frame.where(f"path >= {t}")
        assert {(r.symbol, r.path) for r in lines.definitions(some, asked).collect()} == {(w, min(k for v, k in want if v == w and k >= t)) for w in {w for w, k in want if k >= t}}


def test_references_are_dealt_once(spark, monkeypatch):
    """Rounds read a file's names in buckets of files; they aren't shuffled again for each."""
    plans = []
    monkeypatch.setattr(graph, "stash", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), shared.stash(df, *a))[1])
    rows = [(i, f"n{i % 7}") for i in range(40)]
    defs, refs = (spark.createDataFrame(x, "id long, name string") for x in (rows, [(i, f"n{k}") for i in range(40) for k in range(9)]))
    ranks = {r.id: r["rank"] for r in graph.name_pagerank(defs, refs, spark.range(41), rounds=2).collect()}
    assert len(ranks) == 41 and abs(sum(ranks.values()) - 1) < 1e-9
    rounds = [p for p in plans if "through" in p]
    assert len(rounds) == 2 and all("Bucketed: true" in p for p in rounds)


def test_terms_are_counted_inside_of_their_row(spark, monkeypatch):
    plans, append = [], postings._append
    monkeypatch.setattr(postings, "_append", lambda rows, index, kind: (plans.append((kind, rows._jdf.queryExecution().executedPlan().toString())), append(rows, index, kind)))
    texts = ["b a b", "", None, "a", "a a A", "c " * 300 + "a", "..", "b a c a b"]
    docs = spark.createDataFrame([*enumerate(texts)], "id long, text string")
    index = postings.create_index(spark, shared.place(spark, "test"), buckets=4)
    postings.add_documents(index, docs)
    want = {(i, w, n, len((t or "").replace(".", "").split())) for i, t in enumerate(texts) for w, n in Counter((t or "").lower().replace(".", "").split()).items()}
    got = [(r.id, r.term, r.tf, r.dl) for r in index.table("postings").collect()]
    assert set(got) == want and len(got) == len(want)
    assert {r.term: r.n for r in postings.term_totals(index).collect()} == Counter(" ".join(t or "" for t in texts).lower().replace(".", "").split())
    assert [p.count("Exchange") for kind, p in plans if kind == "postings"] == [0]
