"""Rows that no operator may lose, and texts above a megabyte."""

import zlib

import numpy as np
import pytest
from corpusloom.llm import decontaminate, language_id, line_dedup, mixing, ngram_join, pii, quality_rules, token_counts, token_shards
from corpusloom.llm.queries import BYTE_BPE, PIECES, WORD_BPE
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
LONG = ["lorem ipsum dolor " * 60_000, "x" * 1_100_000, "\n".join(f"line {k} of many, each of them with some more words" for k in range(22_000)), "a\u0301" * 800]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_language_id_keeps_columns_of_its_own_names(spark, docs):
    clash = docs.withColumns({"score": F.lit("mine"), "lang_pred": F.lit(7), "own_0": F.lit("too")})
    clash = clash.unionByName(clash.limit(3)).unionByName(clash.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    kept = language_id.keep_identified(clash, PIECES)
    assert kept.columns == clash.columns and kept.dtypes == clash.dtypes
    rows = kept.collect()
    assert {r.score for r in rows} == {"mine"} and {r.lang_pred for r in rows} == {7} and sum(r.doc_id is None for r in rows) == 2
    assert language_id.keep_identified(clash.limit(0), PIECES).count() == 0


def test_native_operators_keep_columns_of_helper_names(spark, docs):
    names = ["_gone", "_id", "_kept", "_lines", "_words", "_pii_text", "__words"]
    clash = docs.select("doc_id", "text").withColumns({c: F.lit(c) for c in names})
    for out in (quality_rules.quality_rules(clash), pii.find_pii(clash), line_dedup.dedup_lines(clash), line_dedup.dedup_passages(clash)):
        r = out.select(names).distinct().collect()
        assert [tuple(x) for x in r] == [tuple(names)]


def test_long_texts(spark):
    df = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").repartition(4)
    item = "this very passage of a benchmark stands somewhere deep inside of a long text"
    deep = spark.createDataFrame([(9, "word " * 150_000 + item + " word" * 150_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "ipsum")], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contaminated(df.unionByName(deep), bench).collect()))
    assert got == [(0, 2, 0, 6, 11), (9, 1, 0, 750_000, 750_000 + len(item))]
    assert quality_rules.quality_rules(df).count() == pii.find_pii(df).where("size(pii) = 0").count() == line_dedup.dedup_passages(df).count() == len(LONG)
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(df).collect()} == {k: k for k in range(len(LONG))}
    assert mixing.mix(df.withColumn("source", F.lit("a"))).agg(F.sum("size")).first()[0] == sum(len(t.split()) for t in LONG)
    model = language_id.learn(spark.read.parquet(f"{DIR}/documents.parquet"), PIECES)
    assert language_id.identify(df, model).where("lang_pred <> 'und'").count() == len(LONG)


def test_long_texts_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [LONG[0], LONG[2], "y" * 30_000, LONG[3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = Tokenizer.from_file(BYTE_BPE)
    token_shards.write_shards(df, BYTE_BPE, str(tmp_path / "s"))
    got = {r.doc_id: r.ids_crc32 for r in token_shards.documents(token_shards.read_shards(spark, str(tmp_path / "s"))).collect()}
    assert got == {k: zlib.crc32(np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for k, t in enumerate(texts)}
    words = Tokenizer.from_file(WORD_BPE)
    counts = token_counts.prefix_counts(df, WORD_BPE).select("doc_id", token_counts.n_tokens(F.col("prefix_counts")).alias("n")).collect()
    assert {r.doc_id: r.n for r in counts} == {k: len(words.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
