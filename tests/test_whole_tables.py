"""Queries over whole tables: nothing of a table is left out before its operator runs."""

from corpusloom.plans import graphs, retrieval


def test_mmr_rerank_sees_all_documents_and_vectors(spark, tmp_path):
    text = lambda k: " ".join(["common"] * 12) + f" own{k // 2}"
    # 0 asks; 1 shares a late word with it and has no vector; 20 asks and has none; 21 shares a late word with 20; 2 has a vector, but no document
    docs = [(0, text(0)), (1, text(1)), (3, text(30)), (20, text(20)), (21, text(21)), (5, text(50))]
    spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got: dict[int, list] = {}
    for r in retrieval.mmr_rerank(spark, str(tmp_path)).orderBy("qid", "pick").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert set(got) == {0, 20}
    assert set(got[0]) == {0, 1, 2, 3, 5, 20, 21} and set(got[20]) == {0, 1, 3, 5, 20, 21}
    # the late words decide: without them all other documents are alike and the lowest id comes first
    assert got[20][0] in (20, 21)


def test_communities_use_all_edges(spark, tmp_path):
    groups = [(1, 2, 3, 4), (5, 6, 7, 8), (9, 10, 11)]
    orders = [(a, b) for g in groups for a in g for b in g if a < b]
    spark.createDataFrame([(k, s) for k, o in enumerate(orders) for s in o], "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(s,) for g in groups for s in g], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got: dict[int, set] = {}
    for r in graphs.communities(spark, str(tmp_path)).collect():
        got.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))
