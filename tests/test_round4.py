"""Searches of many long questions, paragraphs of whole conversations, and what the steps hold at a time."""

import random

import duckdb
import numpy as np
import pyarrow as pa

from corpusloom.operators import generate, graph
from corpusloom.operators import search as S
from corpusloom.plans import chunks, graphs, retrieval


def rows(df, digits=9):
    return sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_sparse_search_is_bm25_in_blocks(spark):
    """the same hits as bm25's, ties and repeated words too, whatever the blocks of questions."""
    dice = random.Random(3)
    text = lambda: " ".join(dice.choice("the of and") if dice.random() < 0.4 else f"w{int(dice.paretovariate(0.6)) % 300}" for _ in range(dice.randrange(60)))
    data = [(i, "ab"[i % 3 == 0], text() if i % 17 else None) for i in range(700)]
    data += [(1000 + i, "a", data[5][2]) for i in range(30)]
    docs = spark.createDataFrame(data, "id long, part string, text string").repartition(3)
    asked = docs.where("id % 20 = 0").select(docs.id.alias("qid"), "text")
    want = rows(S.top_k(S.bm25(docs, asked, ["part"]), ["qid", "part"], "score", "id", 7).select("qid", "part", "id", "score", "rank"), 6)
    for block, entries in ((2048, 1_000_000), (5, 1_000_000), (2048, 100)):
        got = S.sparse_search(docs, asked, 7, "part", block, entries)
        assert rows(got.select("qid", "part", "id", "score", "rank"), 6) == want
    assert S.sparse_search(docs, asked.limit(0), 3, "part").count() == 0 and S.sparse_search(docs.limit(0), asked, 3, "part").count() == 0


def test_best_keeps_ties_by_id_over_blocks():
    dice = np.random.default_rng(1)
    scores, ids = np.round(dice.random((9, 400)), 1), np.arange(400)
    best = S._Best(25)
    for at in np.array_split(dice.permutation(400), 7):
        at = np.sort(at)
        best.add(scores[:, at], ids[at])
    assert (best.ids == np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :25]).all()


def test_hybrid_reads_no_pair_of_texts_as_rows(spark, tmp_path):
    """no join of questions' words with documents' words is left in the plan."""
    n = 100
    spark.createDataFrame([(i, f"common words of all {i % 7}", "en") for i in range(n)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for query in (retrieval.hybrid_search_chat, retrieval.hybrid_search_tool, retrieval.mmr_rerank):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().toString()
        assert "postings" not in plan and "term" not in plan


def test_paragraph_chunks_of_long_and_broken_turns(spark, tmp_path):
    """the SQL says what the query does with turns above 2,000 characters, blank lines in turns and fences."""
    said = "One sentence of some words stands here. " * 30
    turns = [said * 2, "short", said.strip(), "a\n \n\n b", "```\n" + said * 2, "", "x" * 2500, None, said, "tail " * 390, "end"]
    data = [(c, t, "user", turns[(t * (c + 1) + c) % len(turns)]) for c in range(12) for t in range(9)]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = chunks.paragraph_chunks(spark, str(tmp_path))
    want = con.sql(chunks.ORACLES["paragraph_chunks"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_dense_search_holds_few_scores():
    """a large Arrow batch is scored a few hundred vectors at a time."""
    b = pa.RecordBatch.from_pydict({"id": list(range(2000)), "by": ["a", "b"] * 1000})
    seen = [(g, len(at)) for g, at, _ in S._groups(b, "by")]
    assert max(n for _, n in seen) <= S.SCORED and sum(n for _, n in seen) == 2000


def test_generate_hands_out_few_texts_at_a_time(spark):
    """F8: a model gets and holds a bounded number of texts, not an Arrow batch of ten thousand."""
    prompts = spark.range(1500, numPartitions=1).selectExpr("id", "IF(id % 7 = 0, NULL, concat('t', id)) AS prompt")
    got = generate.generate(prompts, lambda texts: [f"{t} {len(texts)}" for t in texts]).collect()
    assert len(got) == 1500 and all((r.answer is None) == (r.id % 7 == 0) for r in got)
    said = [r.answer.split() for r in got if r.answer]
    assert all(int(n) <= generate.ASKED for _, n in said) and {t for t, _ in said} == {f"t{i}" for i in range(1500) if i % 7}


def test_pairs_of_files_are_counted_once_and_not_sorted(spark, tmp_path):
    """the pairs are read from where they were written and meet the degrees without a shuffle; an order gives each pair once."""
    orders = [(1, 5), (1, 3), (1, 5), (1, 9), (2, 3), (2, 5), (3, 7), (None, 3), (None, 5), (4, None), (4, 3)]
    spark.createDataFrame(orders, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    links = graphs.supplier_pairs(spark, str(tmp_path))
    assert sorted(map(tuple, links.collect())) == [(3, 5), (3, 5), (3, 9), (5, 9)]
    edges = graph.file_edges(links)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted(map(tuple, edges.collect())) == [(3, 5, 2.0), (3, 9, 1.0), (5, 9, 1.0)]
