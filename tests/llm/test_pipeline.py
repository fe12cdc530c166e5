"""The pipeline, stage by stage, against plain Python."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
from corpusloom.llm.common import stash
from corpusloom.llm.queries import BYTE_BPE

from .test_corpus import brute_components

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    copies = docs.where("doc_id % 5 = 0").withColumn("doc_id", docs["doc_id"] + 100_000)
    docs = docs.unionByName(copies).unionByName(docs.limit(1)).unionByName(spark.createDataFrame([(-1, None, "en", "a", 0), (-2, "12 34 ...", None, None, 9)], docs.schema))
    (_, identified), (_, distinct), (_, clean), (_, mixed), (_, tokens) = corpus_pipeline.STAGES

    one = stash(identified(spark, docs, DIR), "one")
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or ""))

    rows = [(r.doc_id, r.text) for r in one.collect()]
    want = {i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c}
    two = stash(distinct(spark, one, DIR), "two")
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(want)

    items = [r.text.lower().replace("\n", " ") for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    three = stash(clean(spark, two, DIR), "three")
    kept = {r.doc_id for r in three.collect()}
    assert three.columns == columns and kept <= want
    held = {r.doc_id for r in two.collect() if any(i in r.text.lower().replace("\n", " ") for i in items)}
    assert held and not held & kept and len(want - kept) <= len(held) + 2

    four = stash(mixed(spark, three, DIR), "four")
    size, taken, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in three.collect():
        size[r.source] += len(r.text.split())
    for r in four.collect():
        taken[r.source] += len(r.text.split())
        count[r.doc_id] += 1
    assert four.columns == columns and max(count.values()) <= 2 and all(taken[s] <= 2 * size[s] for s in size)
    assert abs(sum(taken.values()) / sum(size.values()) - 1.5) < 0.25

    from tokenizers import Tokenizer

    whole, at = Tokenizer.from_file(BYTE_BPE), 0
    got = sorted((tuple(r) for r in tokens(spark, four, DIR).collect()), key=lambda r: r[1])
    for (doc, start, n, crc), r in zip(got, sorted(four.collect(), key=lambda r: r.doc_id), strict=True):
        ids = [*whole.encode(r.text, add_special_tokens=False).ids, 0]
        assert (doc, start, n, crc) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
