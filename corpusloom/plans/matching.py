"""Matching paths to communities and sections, class hierarchies, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paths as M
from .common import Registry, table
from .graphs import FILES, files_of, import_edges

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

KNOWN = "kn AS (SELECT 'lib/' || source || '/' || doc_id || '.py' AS key, doc_id AS place FROM documents)"
ASKED = """aq AS (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN 'lib/' || source || '/' || doc_id || '.py' WHEN 1 THEN source || '/' || (doc_id - 1) || '.py' WHEN 2 THEN '/app/x/lib/' || source || '/' || doc_id || '.py' ELSE 'lib/' || source || '/' || (doc_id + 1) || '.py:Thing' END AS path FROM documents)"""


@reg.add(f"""WITH {KNOWN}, {ASKED}, m AS (SELECT path, key, place, CASE WHEN path = key THEN 1 WHEN ends_with(key, '/' || path) OR ends_with(path, '/' || key) THEN 2 WHEN split_part(path, ':', 1) = key THEN 3 END AS how FROM aq JOIN kn ON path = key OR ends_with(key, '/' || path) OR ends_with(path, '/' || key) OR split_part(path, ':', 1) = key)
SELECT path, key, how FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY how, place) AS n FROM m) WHERE n = 1""")
def chunk_to_community_node(spark: SparkSession, d: str) -> DataFrame:
    docs, i = table(spark, d, "documents"), F.col("doc_id")
    s = lambda c: c.cast("string")
    lib = lambda n, z=".py": F.concat(F.lit("lib/"), "source", F.lit("/"), s(n), F.lit(z))
    known = docs.select(lib(i).alias("key"), i.alias("place"))
    path = F.when(i % 4 == 0, lib(i)).when(i % 4 == 1, F.concat("source", F.lit("/"), s(i - 1), F.lit(".py"))).when(i % 4 == 2, F.concat(F.lit("/app/x/"), lib(i))).otherwise(lib(i + 1, ".py:Thing"))
    return M.match_paths(docs.select(path.alias("path")), known)


@reg.add("SELECT page_id, regexp_replace(url, '^https?://[^/]+/', '') AS path FROM pages")
def machine_paths(spark: SparkSession, d: str) -> DataFrame:
    heads = F.array(*[F.lit(x) for x in ("/home/me/", "/Users/me/", "/root/", "/app/", "/tmp/x/", "C:\\", "./")])
    rest = F.regexp_replace("url", "^https?://[^/]+/", "")
    return table(spark, d, "pages").select("page_id", M.without_machine(F.concat(F.get(heads, (F.col("page_id") % 7).cast("int")), rest)).alias("path"))


@reg.add(f"""WITH {FILES}, a AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN file WHEN 1 THEN 'x/../' || file ELSE file || 'x' END AS path FROM files)
SELECT doc_id, path, path IN (SELECT file FROM files) AS valid FROM a""")
def valid_files(spark: SparkSession, d: str) -> DataFrame:
    f, i = files_of(spark, d), F.col("doc_id")
    asked = f.select("doc_id", F.when(i % 3 == 0, F.col("file")).when(i % 3 == 1, F.concat(F.lit("x/../"), "file")).otherwise(F.concat("file", F.lit("x"))).alias("path"))
    good, bad = M.split_valid(asked, f.select(F.col("file").alias("path")))
    out = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return out.select("doc_id", "path", "valid")


@reg.add(f"""WITH {FILES}, s AS (SELECT coalesce(lang, 'none') AS section, file FROM files JOIN documents USING (doc_id)), o AS (SELECT DISTINCT section, dst AS file FROM s JOIN ie ON src = s.file WHERE (section, dst) NOT IN (SELECT section, file FROM s))
SELECT section, string_agg(file, ', ' ORDER BY file) AS needs FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY file) AS n FROM o) WHERE n <= 5 GROUP BY section""")
def section_dependencies(spark: SparkSession, d: str) -> DataFrame:
    f = files_of(spark, d).join(table(spark, d, "documents"), "doc_id").select(F.coalesce("lang", F.lit("none")).alias("section"), "file")
    return M.section_dependencies(f, import_edges(spark, d))


@reg.add("""WITH nd AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, 'class' AS type, s_name AS name FROM supplier UNION ALL SELECT 'm' || p_partkey, 'function', p_name || p_partkey FROM part),
  ed AS (SELECT CAST(s_suppkey AS VARCHAR) AS src, CAST(s_suppkey // 3 AS VARCHAR) AS dst, 'inherits' AS type FROM supplier WHERE s_suppkey > 3 UNION ALL SELECT CAST(p_partkey % 100 AS VARCHAR), 'm' || p_partkey, 'contains' FROM part)
SELECT id, coalesce((SELECT string_agg(n.name, ',' ORDER BY n.name) FROM ed JOIN nd n ON n.id = dst WHERE src = c.id AND ed.type = 'inherits'), '') AS parents, coalesce((SELECT string_agg(n.name, ',' ORDER BY n.name) FROM ed JOIN nd n ON n.id = src WHERE dst = c.id AND ed.type = 'inherits'), '') AS children,
  coalesce((SELECT array_to_string(list(n.name ORDER BY n.name)[1:10], ',') FROM ed JOIN nd n ON n.id = dst WHERE src = c.id AND ed.type = 'contains'), '') AS methods, CAST(greatest((SELECT count(*) FROM ed JOIN nd n ON n.id = dst WHERE src = c.id AND ed.type = 'contains') - 10, 0) AS INTEGER) AS more FROM nd c WHERE type = 'class'""")
def class_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    s, p, text = table(spark, d, "supplier"), table(spark, d, "part"), lambda c: F.col(c).cast("string")
    part = F.concat(F.lit("m"), text("p_partkey"))
    nodes = s.select(text("s_suppkey").alias("id"), F.lit("class").alias("type"), F.col("s_name").alias("name")).unionByName(p.select(part.alias("id"), F.lit("function").alias("type"), F.concat("p_name", text("p_partkey")).alias("name")))
    edges = s.where("s_suppkey > 3").select(text("s_suppkey").alias("src"), F.expr("cast(s_suppkey div 3 as string)").alias("dst"), F.lit("inherits").alias("type"))
    edges = edges.unionByName(p.select((F.col("p_partkey") % 100).cast("string").alias("src"), part.alias("dst"), F.lit("contains").alias("type")))
    return M.class_hierarchy(nodes, edges)


@reg.add("SELECT session, entity FROM (SELECT DISTINCT conv_id % 10 AS session, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS entity FROM conversations WHERE turn % 2 = 0) EXCEPT SELECT conv_id % 10, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) FROM conversations WHERE turn % 2 = 1")
def new_entities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "conversations").select((F.col("conv_id") % 10).alias("session"), (F.col("turn") % 2).alias("old"), F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("entity"))
    known = e.where("old = 1").select("session", "entity").distinct()
    return e.where("old = 0").select("session", "entity").distinct().join(known, ["session", "entity"], "left_anti")


@reg.add("SELECT page_id, url FROM pages WHERE contains(lower(url), '12') OR contains(lower(string_split(url, '/')[-1]), 'page')")
def source_panel_search(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.split("url", "/"), -1)
    return table(spark, d, "pages").where(F.lower("url").contains("12") | F.lower(name).contains("page")).select("page_id", "url")
