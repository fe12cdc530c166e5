"""Round trips through the stores, and the streaming jobs over the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stores as S
from ..streaming import jobs as J
from . import graphs as P
from .common import Registry, table
from .retrieval import TOPICS, summaries_of
from .tables import TASKS

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles


@reg.add(f"WITH {P.SYMS} SELECT 'node' AS kind, file || ':' || name AS a, kind AS b FROM sy UNION ALL SELECT 'node', file, 'file' FROM files UNION ALL SELECT 'edge', file, file || ':' || name FROM sy UNION ALL SELECT 'edge', src, dst FROM ie")
def graph_store(spark: SparkSession, d: str) -> DataFrame:
    nodes, contains = S_nodes(spark, d)
    at = J.place(spark, "graph")
    S.save_graph(nodes, contains.unionByName(P.import_edges(spark, d)), at)
    n, e = S.load_graph(spark, at)
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("type").alias("b")).unionByName(e.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


def S_nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return P.G.build_nodes(P.files_of(spark, d), P.symbols_of(spark, d))


@reg.add(f"WITH {TOPICS} SELECT CAST(substring(source, 4) AS INTEGER) AS community, CAST(doc_id AS VARCHAR) AS node, text AS summary FROM (SELECT source, doc_id FROM documents) JOIN summaries s ON s.id = source WHERE TRY_CAST(substring(source, 4) AS INTEGER) IS NOT NULL")
def community_store(spark: SparkSession, d: str) -> DataFrame:
    number = F.expr("try_cast(substring(source, 4) as int)")
    members = table(spark, d, "documents").select(number.alias("community"), F.col("doc_id").cast("string").alias("node")).where("community is not null")
    s = summaries_of(spark, d).withColumnRenamed("community", "source").select(number.alias("community"), F.col("text").alias("summary"))
    at = J.place(spark, "communities")
    S.save_communities(members, s, at)
    m, s = S.load_communities(spark, at)
    return m.join(s, "community")


@reg.add("SELECT doc_id, length(text) AS char_count, source, md5(text) AS digest FROM documents")
def chunk_store(spark: SparkSession, d: str) -> DataFrame:
    at = J.place(spark, "chunks")
    S.save_chunks(table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("content")), at, ["doc_id"])
    back = spark.read.schema("chunk_id struct<doc_id:long>, char_count int, metadata struct<doc_id:long,source:string>, content string").json(at)
    return back.select("chunk_id.doc_id", "char_count", "metadata.source", F.md5("content").alias("digest"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts():
    """An embedding that SQL can tell: how often each letter stands in a text."""
    return lambda texts: np.array([[t.lower().count(c) for c in LETTERS] for t in texts], float)


_COUNTS = ", ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in LETTERS)


@reg.add(f"WITH v AS (SELECT doc_id, [{_COUNTS}] AS v FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE lang = 'de')) SELECT doc_id, 'de' AS kb_category, array_to_string(v, ',') AS vector FROM v")
def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """Vectors appended in two goes, and read back for one category."""
    at = J.place(spark, "vectors")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.col("lang").alias("kb_category"))
    S.append_vectors(S.embed(docs.where("doc_id % 2 = 0"), letter_counts), at)
    S.append_vectors(S.embed(docs.where("doc_id % 2 = 1"), letter_counts), at)
    return S.load_vectors(spark, at, "de").select("doc_id", "kb_category", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@reg.add("SELECT source AS section, count(*) AS n FROM documents GROUP BY source")
def section_store(spark: SparkSession, d: str) -> DataFrame:
    at = J.place(spark, "sections")
    per = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("file_name", F.concat("source", F.lit(".json")))
    S.save_sections(per, at)
    body = S.scan_tree(spark, at, "*.txt").select(F.col("content").cast("string").alias("b"))
    return body.select(F.get_json_object("b", "$.source").alias("section"), F.get_json_object("b", "$.n").cast("long").alias("n"))


@reg.add(r"SELECT doc_id AS doc_key, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_\x{4e00}-\x{9fff}]+')) AS term FROM documents) GROUP BY ALL")
def stream_index(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "documents").schema
    return J.incremental_postings(spark, f"{d}/documents.parque[t]", schema, J.place(spark, "index"))


@reg.add("SELECT source || '/' || doc_id AS path, n_chars AS mtime FROM documents UNION SELECT source || '/' || doc_id, n_chars + 1 FROM documents WHERE doc_id % 3 = 0")
def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    at, docs = J.place(spark, "changes"), table(spark, d, "documents")
    v = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("mtime"), "doc_id")
    v.select("path", "mtime").write.parquet(f"{at}/in/1")
    v.select("path", (F.col("mtime") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("mtime")).write.parquet(f"{at}/in/2")
    return J.changed_files(spark, f"{at}/in/*", v.select("path", "mtime").schema, at).select("path", "mtime")


@reg.add(f"""WITH {TASKS}, e AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY CASE status WHEN 'failed' THEN 0 ELSE 1 END, CASE status WHEN 'failed' THEN epoch_us(ts) ELSE -epoch_us(ts) END, CASE status WHEN 'failed' THEN event_id ELSE -event_id END) AS n FROM tasks)
SELECT task_id, event_id, status, progress FROM e WHERE n = 1""")
def stream_task_states(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{d}/events.parque[t]")
    return J.task_states(tasks_of_frame(stream), J.place(spark, "tasks"), late="90 days", idle="180 days")


def tasks_of_frame(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind == "view", "processing").when(kind == "purchase", "completed").when(kind == "click", "cached").otherwise("failed")
    return e.select(F.get_json_object("props", "$.k").cast("long").alias("task_id"), "ts", "event_id", status.alias("status"), F.col("value").alias("progress"))


@reg.add("SELECT event_type, count(*) AS n, CAST(sum(CAST(coalesce(json_extract_string(props, '$.k'), '0') AS BIGINT)) AS BIGINT) AS k_total FROM events GROUP BY event_type")
def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return J.event_counts(spark.readStream.schema(e.schema).parquet(f"{d}/events.parque[t]").select("event_type", "props"), J.place(spark, "counts"))


@reg.add("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(coalesce(json_extract_string(props, '$.k'), '0') AS BIGINT)) AS BIGINT) AS k_total FROM events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{d}/events.parque[t]").select("ts", "event_type", "props")
    return J.event_counts(stream, J.place(spark, "daily"), every="1 day", late="90 days")
