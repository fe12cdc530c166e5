"""Files in and out: source trees, graphs, communities, chunks, vectors, sections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators.files import folder_of, is_binary, kept

#: Declared shape of a communities file: members and summaries by community number.
COMMUNITIES = "communities map<string,array<string>>, summaries map<string,string>"
GRAPH = "nodes array<struct<id:string,type:string,name:string,file:string>>, links array<struct<source:string,target:string,type:string>>"


def scan_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (below root), size, mtime, content of the files under root, without version control, legal and binary files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = "/" + root.split("://")[-1].strip("/") + "/"
    path = F.expr(f"substring(path, position('{base}' in path) + {len(base)})")
    files = found.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    return files.where(kept(F.col("path")) & ~is_binary(F.col("content")))


def decoded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with their text, and those (path, size) whose content isn't UTF-8."""
    with_text = files.withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
    return with_text.where("text is not null").drop("content"), with_text.where("text is null").select("path", "size")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as JSON lines, one per directory of files: nodes, and the links that leave them, stay together."""
    n = nodes.groupBy(folder_of(F.col("file")).alias("part")).agg(F.collect_list(F.struct("id", "type", "name", "file")).alias("nodes"))
    at = edges.join(nodes.select(F.col("id").alias("src"), folder_of(F.col("file")).alias("part")), "src")
    e = at.groupBy("part").agg(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type")).alias("links"))
    n.join(e, "part", "left").drop("part").write.json(path)


def load_graph(spark: SparkSession, path: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of node-link JSON: lines, or whole files of one object each."""
    g = spark.read.schema(GRAPH).option("multiLine", whole).json(path)
    edges = g.select(F.explode("links").alias("l")).select(F.col("l.source").alias("src"), F.col("l.target").alias("dst"), "l.type")
    return g.select(F.explode("nodes").alias("n")).select("n.*"), edges


def save_communities(members: DataFrame, summaries: DataFrame, path: str) -> None:
    """members (community, node) and summaries (community, summary) as JSON, one object for each community."""
    m = members.groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    both = m.join(summaries, "community", "left")
    key = F.col("community").cast("string")
    both.select(F.create_map(key, "nodes").alias("communities"), F.create_map(key, "summary").alias("summaries")).write.json(path)


def load_communities(spark: SparkSession, path: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """members (community, node) and summaries (community, summary); keys that aren't numbers are left out."""
    g = spark.read.schema(COMMUNITIES).option("multiLine", whole).json(path)
    number = lambda c: F.expr(f"try_cast({c} as int)")
    members = g.select(F.explode("communities").alias("k", "v")).select(number("k").alias("community"), F.explode("v").alias("node")).where("community is not null")
    summaries = g.select(F.explode("summaries").alias("k", "summary")).select(number("k").alias("community"), "summary").where("community is not null")
    return members, summaries


def save_chunks(chunks: DataFrame, path: str, order: list[str]) -> None:
    """Chunks (content, metadata columns) as JSON lines with their order, size and content."""
    meta = [c for c in chunks.columns if c != "content"]
    chunks.select(F.struct(*order).alias("chunk_id"), F.length("content").alias("char_count"), F.struct(*meta).alias("metadata"), "content").write.json(path)


def hashed_terms(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An embedding without a model: counts of hashed terms, of unit length. Equal texts get equal vectors."""
    import re
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            for w in re.findall("[a-z0-9_一-鿿]+", t.lower()):
                out[i, zlib.crc32(w.encode()) % size] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(docs: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "content", batch: int = 64) -> DataFrame:
    """docs with embedding: model() makes, once a task, a function from texts to vectors; blank texts go as one blank."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = model()
        for t in frames:
            said = [x if x and x.strip() else " " for x in t[text]]
            made = [v for a in range(0, len(said), batch) for v in np.asarray(f(said[a : a + batch]), np.float32)]
            yield t.assign(embedding=made)

    schema = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes) + ", embedding array<float>"
    return docs.mapInPandas(run, schema)


def append_vectors(docs: DataFrame, path: str, by: str = "kb_category") -> None:
    """Add documents with vectors to a store that is laid out by category."""
    docs.write.mode("append").partitionBy(by).parquet(path)


def load_vectors(spark: SparkSession, path: str, category: str | None = None, by: str = "kb_category") -> DataFrame:
    """A store, or one category of it, of which alone the files are read."""
    df = spark.read.parquet(path)
    return df if category is None else df.where(F.col(by) == category)


def save_sections(sections: DataFrame, path: str, name: str = "file_name") -> None:
    """A JSON text in a folder of its own for each section, named by its file name."""
    body = F.to_json(F.struct(*[c for c in sections.columns if c != name]))
    sections.select(F.col(name).alias("section_file"), body.alias("value")).write.partitionBy("section_file").text(path)


def chunk_terms(docs: DataFrame, key: Column, text: str) -> DataFrame:
    """doc_key, term and tf of documents."""
    return docs.select(key.alias("doc_key"), F.explode(tokenize(F.col(text))).alias("term")).groupBy("doc_key", "term").agg(F.count("*").alias("tf"))
