"""Symbol graph queries. Files: a path per document; symbols and calls: the documents' lines dressed as code; imports: a statement per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import lines as L
from ..operators.budget import running_total, token_count
from ..operators.shared import stash
from .common import Registry, table
from .lines import CODE, LINES, code_files_of, code_of

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

FILE = "coalesce(source, 'none') || '/' || doc_id || '.py'"
FILES = f"""files AS (SELECT doc_id, {FILE} AS file FROM documents),
  imp AS (SELECT file, CASE doc_id % 4 WHEN 0 THEN 'src' || (doc_id % 20) || '/' || (doc_id % 20 + 20 * (doc_id % 7)) || '.py' WHEN 1 THEN regexp_replace(file, '[^/]*$', '') || (doc_id + 20) || '.py' WHEN 2 THEN 'src' || (doc_id % 20) || '/' || (doc_id % 20) || '.py' ELSE 'os.py' END AS dst FROM files),
  ie AS (SELECT DISTINCT imp.file AS src, dst FROM imp JOIN files f ON f.file = dst WHERE imp.file <> dst)"""
SYMS = rf"""{LINES}, {CODE}, {FILES},
  fn AS (SELECT file, name, min(line) AS line FROM (SELECT path, line, regexp_extract(text, '^def (\w+)', 1) AS name FROM code) JOIN files ON doc_id = path WHERE name <> '' GROUP BY ALL),
  cl AS (SELECT file, name FROM (SELECT DISTINCT path, regexp_extract(text, '^export class (\w+)', 1) AS name FROM code) JOIN files ON doc_id = path WHERE name <> ''),
  sy AS (SELECT file, name, min(kind) AS kind FROM (SELECT file, name, 'function' AS kind FROM fn UNION ALL SELECT file, name, 'class' FROM cl) GROUP BY ALL)"""


def files_of(spark: SparkSession, d: str) -> DataFrame:
    file = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))
    return table(spark, d, "documents").select("doc_id", file.alias("file"))


def imports_of(spark: SparkSession, d: str) -> DataFrame:
    i, s = F.col("doc_id"), lambda c: c.cast("string")
    say = (
        F.when(i % 4 == 0, F.concat(F.lit("from src"), s(i % 20), F.lit("."), s(i % 20 + 20 * (i % 7)), F.lit(" import thing")))
        .when(i % 4 == 1, F.concat(F.lit("from ."), s(i + 20), F.lit(" import thing"))).when(i % 4 == 2, F.concat(F.lit("import src"), s(i % 20), F.lit("."), s(i % 20), F.lit(" as x"))).otherwise("import os")
    )
    return files_of(spark, d).select("file", G.module_of(say).alias("module"))


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.resolve_imports(imports_of(spark, d), files_of(spark, d))


def functions_of(spark: SparkSession, d: str) -> DataFrame:
    found = code_of(spark, d).select(F.col("path").alias("doc_id"), "line", F.regexp_extract("text", r"^def (\w+)", 1).alias("name")).where("name <> ''")
    per = found.join(files_of(spark, d), "doc_id").groupBy("file", "name").agg(F.min("line").alias("line"))
    return per.select(F.concat("file", F.lit(":"), "name").alias("id"), "file", "name", "line")


def symbols_of(spark: SparkSession, d: str) -> DataFrame:
    c = code_of(spark, d).select(F.col("path").alias("doc_id"), F.regexp_extract("text", r"^export class (\w+)", 1).alias("name")).where("name <> ''").join(files_of(spark, d), "doc_id")
    return functions_of(spark, d).select("file", "name", F.lit("function").alias("kind")).unionByName(c.select("file", "name", F.lit("class").alias("kind")).distinct())


def calls_of(spark: SparkSession, d: str) -> DataFrame:
    scope = L.enclosing(code_files_of(spark, d), lambda t: F.when(t.startswith("def "), F.regexp_extract(t, r"^def (\w+)", 1)))
    called = scope.select(F.col("path").alias("doc_id"), "scope", F.explode(F.regexp_extract_all("text", F.lit(r"return ([A-Za-z_]\w*)\("), F.lit(1))).alias("name")).where("scope <> ''")
    return called.join(files_of(spark, d), "doc_id").select("file", F.concat("file", F.lit(":"), "scope").alias("caller"), "name")


@reg.add(f"WITH {SYMS} SELECT file AS id, 'file' AS type, string_split(file, '/')[-1] AS name, file FROM files UNION ALL SELECT file || ':' || name, kind, name, file FROM sy")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.build_nodes(files_of(spark, d), symbols_of(spark, d))[0]


@reg.add(f"WITH {FILES} SELECT src, dst, 'imports' AS type FROM ie")
def import_resolution(spark: SparkSession, d: str) -> DataFrame:
    return import_edges(spark, d)


SCRIPTS = r"""sf AS (SELECT doc_id, source || '/' || CASE doc_id % 4 WHEN 0 THEN 'lib/' ELSE '' END || 'm' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.js' WHEN 3 THEN '/index.ts' ELSE '.mjs' END AS file FROM documents WHERE source IS NOT NULL),
  im AS (SELECT file, source || '/' || CASE WHEN t % 4 = 0 THEN 'lib/' ELSE '' END || 'm' || t AS base FROM (SELECT sf.*, source, doc_id // 2 AS t FROM sf JOIN documents USING (doc_id)) WHERE doc_id % 3 < 2)"""


def scripts_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Script files of the documents, and their statements that import a module of the same source, by a path from where the file is, or a package."""
    i, folder = F.col("doc_id"), lambda k: F.when(k % 4 == 0, "lib/").otherwise("")
    end = F.when(i % 5 == 0, ".ts").when(i % 5 == 1, ".tsx").when(i % 5 == 2, ".js").when(i % 5 == 3, "/index.ts").otherwise(".mjs")
    files = table(spark, d, "documents").where("source is not null").select("doc_id", F.concat("source", F.lit("/"), folder(i), F.lit("m"), i.cast("string"), end).alias("file"))
    other, up = F.expr("doc_id div 2"), F.repeat(F.lit("../"), F.when(i % 4 == 0, 1).otherwise(0) + F.when(i % 5 == 3, 1).otherwise(0))
    path = F.concat(F.when(up == "", "./").otherwise(up), folder(other), F.lit("m"), other.cast("string"))
    said = lambda a, z: F.concat(F.lit(a), path, F.lit(z))
    say = F.when(i % 3 == 0, said("import { thing } from '", "';")).when(i % 3 == 1, said("const x = require('", "');")).otherwise("import React from 'react';")
    return files.select("file"), files.select("file", G.module_of(say).alias("module"))


@reg.add(f"""WITH {SCRIPTS}, c AS (SELECT im.file AS src, sf.file AS dst, list_position(['.ts', '.tsx', '.js', '.jsx', '.mjs', '/index.ts'], substring(sf.file, length(base) + 1)) AS n FROM im JOIN sf ON starts_with(sf.file, base))
SELECT DISTINCT src, arg_min(dst, n) AS dst, 'imports' AS type FROM c WHERE n IS NOT NULL AND src <> dst GROUP BY src""")
def script_import_resolution(spark: SparkSession, d: str) -> DataFrame:
    files, imports = scripts_of(spark, d)
    return G.resolve_imports(imports, files)


CALLS = rf"""{SYMS},
  sc AS (SELECT path, text, last_value(CASE WHEN starts_with(text, 'def ') THEN regexp_extract(text, '^def (\w+)', 1) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM code),
  ca AS (SELECT DISTINCT file, file || ':' || scope AS caller, regexp_extract(text, 'return ([A-Za-z_]\w*)\(', 1) AS name FROM sc JOIN files ON doc_id = path WHERE scope <> '' AND regexp_matches(text, 'return [A-Za-z_]\w*\(')),
  t1 AS (SELECT ca.*, fn.file || ':' || fn.name AS dst FROM ca JOIN fn USING (file, name)),
  t2 AS (SELECT ca.*, fn.file || ':' || fn.name AS dst FROM ca JOIN ie ON ie.src = ca.file JOIN fn ON fn.file = ie.dst AND fn.name = ca.name WHERE (caller, ca.name) NOT IN (SELECT caller, name FROM t1)),
  t3 AS (SELECT * FROM (SELECT ca.file, caller, ca.name, fn.file || ':' || fn.name AS dst, row_number() OVER (PARTITION BY caller, ca.name ORDER BY CASE WHEN split_part(fn.file, '/', 1) = split_part(ca.file, '/', 1) THEN 0 ELSE 1 END, fn.file) AS n
    FROM ca JOIN fn ON fn.name = ca.name AND fn.file <> ca.file WHERE (caller, ca.name) NOT IN (SELECT caller, name FROM t1) AND (caller, ca.name) NOT IN (SELECT caller, name FROM t2)) WHERE n <= 2),
  ce AS (SELECT DISTINCT caller AS src, dst FROM (SELECT caller, dst FROM t1 UNION ALL SELECT caller, dst FROM t2 UNION ALL SELECT caller, dst FROM t3) WHERE caller <> dst)"""


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.resolve_calls(calls_of(spark, d), functions_of(spark, d), import_edges(spark, d))


@reg.add(f"WITH {CALLS} SELECT src, dst, 'calls' AS type FROM ce")
def call_resolution(spark: SparkSession, d: str) -> DataFrame:
    return call_edges(spark, d)


@reg.add(f"WITH {CALLS} SELECT dst AS target, src AS id, split_part(src, ':', 2) AS name, split_part(src, ':', 1) AS file FROM ce WHERE split_part(dst, ':', 2) = 'The'")
def find_callers(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = G.build_nodes(files_of(spark, d), symbols_of(spark, d))
    return G.neighbours(call_edges(spark, d), nodes, G.named(nodes, "The"), "calls", True)


@reg.add(f"WITH {CALLS} SELECT src AS target, dst AS id, split_part(dst, ':', 2) AS name, split_part(dst, ':', 1) AS file FROM ce WHERE split_part(src, ':', 2) = 'The'")
def find_callees(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = G.build_nodes(files_of(spark, d), symbols_of(spark, d))
    return G.neighbours(call_edges(spark, d), nodes, G.named(nodes, "The"), "calls", False)


@reg.add(f"WITH {SYMS} SELECT file || ':' || name AS id, kind AS type, file FROM sy WHERE name = 'The' AND contains(file, 'src1')")
def find_definition(spark: SparkSession, d: str) -> DataFrame:
    return G.named(G.build_nodes(files_of(spark, d), symbols_of(spark, d))[0], "The", "src1").select("id", "type", "file")


@reg.add(f"""WITH {SYMS} SELECT file, array_to_string((list(name ORDER BY name) FILTER (kind = 'function'))[1:20], ',') AS functions, greatest(count(*) FILTER (kind = 'function') - 20, 0) AS more, array_to_string(list(name ORDER BY name) FILTER (kind = 'class'), ',') AS classes FROM sy GROUP BY file""")
def file_symbols(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = G.build_nodes(files_of(spark, d), symbols_of(spark, d))
    names = lambda k: F.array_sort(F.collect_list(F.when(F.col("type") == k, F.col("name"))))
    per = nodes.where("type <> 'file'").groupBy("file").agg(names("function").alias("f"), names("class").alias("c"))
    first, more = G.capped(F.col("f"), 20)
    shown = lambda a: F.when(F.size(a) > 0, F.array_join(a, ","))
    return per.select("file", shown(first).alias("functions"), more.cast("long").alias("more"), shown(F.col("c")).alias("classes"))


@reg.add(f"WITH {FILES} SELECT src AS file, 'imports' AS direction, dst AS other FROM ie UNION ALL SELECT dst, 'imported_by', src FROM ie")
def find_imports(spark: SparkSession, d: str) -> DataFrame:
    return G.import_directions(import_edges(spark, d), files_of(spark, d).select("file"))


@reg.add(f"WITH {CALLS} SELECT DISTINCT split_part(a, '/', 1) AS module, b AS other, split_part(a, '/', 1) = split_part(b, '/', 1) AS internal FROM (SELECT src AS a, dst AS b FROM ie UNION ALL SELECT split_part(src, ':', 1), split_part(dst, ':', 1) FROM ce) WHERE a <> b")
def module_dependencies(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = G.build_nodes(files_of(spark, d), symbols_of(spark, d))
    return G.module_dependencies(import_edges(spark, d).unionByName(call_edges(spark, d)), nodes)


@reg.add(f"WITH {CALLS} SELECT (SELECT count(*) FROM files) + (SELECT count(*) FROM sy) AS n_nodes, (SELECT count(*) FROM sy) + (SELECT count(*) FROM ie) + (SELECT count(*) FROM ce) AS n_edges, (SELECT count(*) FROM files) AS n_files, count(*) FILTER (kind = 'class') AS n_classes, count(*) FILTER (kind = 'function') AS n_functions, array_to_string(list(DISTINCT name ORDER BY name)[1:15], ',') AS first_names FROM sy")
def graph_overview(spark: SparkSession, d: str) -> DataFrame:
    nodes, contains = G.build_nodes(files_of(spark, d), symbols_of(spark, d))
    edges = contains.unionByName(import_edges(spark, d)).unionByName(call_edges(spark, d)).agg(F.count("*").alias("n_edges"))
    of = lambda k: F.count_if(F.col("type") == k)
    first = nodes.where("type <> 'file'").select("name").distinct().orderBy("name").limit(15).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("first_names"))
    counts = nodes.agg(F.count("*").alias("n_nodes"), of("file").alias("n_files"), of("class").alias("n_classes"), of("function").alias("n_functions"))
    return counts.join(first).join(edges)  # one row each


TAGS = r"""rf AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_\x{4e00}-\x{9fff}]+')) AS name FROM documents),
  df AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9_\x{4e00}-\x{9fff}]+')[1] AS name FROM documents),
  hd AS (SELECT name, count(*) AS n_defs FROM df WHERE name IS NOT NULL GROUP BY name),
  ed AS (SELECT rf.doc_id AS src, df.doc_id AS dst, CAST(count(*) AS DOUBLE) AS weight FROM rf JOIN df USING (name) WHERE rf.doc_id <> df.doc_id GROUP BY ALL)"""


def tags_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Definitions (the first word of a document) and references (all its words), doc_id and name each."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.first_token(F.col("text")).alias("name")), docs.select("doc_id", F.explode(F.array_distinct(X.tokenize(F.col("text")))).alias("name"))


@reg.add(f"WITH {TAGS} SELECT doc_id, name, n_defs - CASE WHEN EXISTS (SELECT 1 FROM df WHERE df.doc_id = rf.doc_id AND df.name = rf.name) THEN 1 ELSE 0 END AS n_targets FROM rf JOIN hd USING (name)")
def reference_graph(spark: SparkSession, d: str) -> DataFrame:
    """References with the number of other documents that define the name: the edges of a name in one row, as a
    frequent name has as many edges as its referring documents times its defining ones."""
    defs, refs = tags_of(spark, d)
    own = defs.where("name is not null").select("doc_id", "name", F.lit(1).alias("own"))
    holders = own.groupBy("name").agg(F.count("*").alias("n_defs"))
    rows = refs.join(holders, "name").join(own, ["doc_id", "name"], "left")
    return rows.select("doc_id", "name", (F.col("n_defs") - F.coalesce("own", F.lit(0))).alias("n_targets"))


def pagerank_sql(rounds: int = 10, share: str = "1.0 / (SELECT count(*) FROM documents)") -> str:
    steps = [f"r0 AS (SELECT doc_id AS id, 1.0 / (SELECT count(*) FROM documents) AS rank, {share} AS share FROM documents)"]
    for k in range(1, rounds + 1):
        steps.append(f"""s{k} AS (SELECT dst AS id, sum(weight / w * rank) AS got FROM ed JOIN ow USING (src) JOIN r{k - 1} ON r{k - 1}.id = src GROUP BY dst),
  r{k} AS (SELECT o.id, 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE id NOT IN (SELECT src FROM ow)) * share) + 0.15 * share AS rank, share FROM r0 o LEFT JOIN s{k} ON s{k}.id = o.id)""")
    return f"WITH {TAGS}, ow AS (SELECT src, sum(weight) AS w FROM ed GROUP BY src), " + ",\n  ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in steps)


def document_ranks(spark: SparkSession, d: str, personal: DataFrame | None = None, **how) -> DataFrame:
    defs, refs = (x.withColumnRenamed("doc_id", "id") for x in tags_of(spark, d))
    return G.name_pagerank(defs, refs, table(spark, d, "documents").select(F.col("doc_id").alias("id")), personal, **how)


@reg.add(pagerank_sql() + " SELECT id, round(rank, 9) AS rank FROM r10")
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return document_ranks(spark, d).select("id", F.round("rank", 9).alias("rank"))


@reg.add()
def settled_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Ranks after as many rounds as they take to settle (1e-6 a node, 100 at most)."""
    return document_ranks(spark, d, rounds=100, tolerance=1e-6)


@reg.add(pagerank_sql(share="CASE WHEN lang = 'en' THEN 1.0 / (SELECT count(*) FROM documents WHERE lang = 'en') ELSE 0.0 END") + " SELECT id, round(rank, 9) AS rank FROM r10")
def personal_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Ranks where all jumps lead to English documents."""
    english = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    shares = english.withColumn("share", F.lit(1.0 / max(english.count(), 1)))
    return document_ranks(spark, d, shares).select("id", F.round("rank", 9).alias("rank"))


_BOOSTED = "rank * CASE WHEN fn.name IN ('The', 'La') THEN 10 ELSE 1 END * CASE WHEN r10.id = 7 THEN 5 ELSE 1 END * CASE WHEN r10.id = 9 THEN 20 ELSE 1 END"


@reg.add(pagerank_sql() + f""", {SYMS}, t AS (SELECT r10.id AS file, fn.name, fn.line, {_BOOSTED} AS rank FROM r10 JOIN files ON doc_id = r10.id JOIN fn ON fn.file = files.file)
SELECT file, name, line, round(rank, 9) AS rank, round(max(rank) OVER (PARTITION BY file), 9) AS top FROM t WHERE rank > 1e-4""")
def ranked_files(spark: SparkSession, d: str) -> DataFrame:
    """Functions by the rank of their file and what a question mentions, with the rank that orders the files."""
    tags = functions_of(spark, d).join(files_of(spark, d), "file").select(F.col("doc_id").alias("file"), "name", "line")
    ranked = G.file_order(G.ranked_tags(tags, document_ranks(spark, d), ["The", "La"], [7], [9], least=1e-4))
    return ranked.select("file", "name", "line", F.round("rank", 9).alias("rank"), F.round("top", 9).alias("top"))


TOKEN_SQL = r"regexp_extract_all(lower({}), '[A-Za-z0-9_\x{{4e00}}-\x{{9fff}}]+')"


@reg.add(pagerank_sql() + f""", {SYMS}, t AS (SELECT r10.id AS file, fn.name, fn.line, round({_BOOSTED}, 9) AS rank FROM r10 JOIN files ON doc_id = r10.id JOIN fn ON fn.file = files.file),
  co AS (SELECT t.*, len({TOKEN_SQL.format('text')}) + 1 + CASE WHEN row_number() OVER (PARTITION BY file ORDER BY rank DESC, t.line, name) = 1 THEN 3 ELSE 0 END AS cost FROM t JOIN code ON path = file AND code.line = t.line),
  us AS (SELECT *, sum(cost) OVER (ORDER BY rank DESC, file, line, name ROWS UNBOUNDED PRECEDING) AS used FROM co), pk AS (SELECT file, max(rank) AS rank, list(line) AS wanted FROM us WHERE used <= 2048 GROUP BY file),
  ne AS (SELECT file, line, text, coalesce(lag(line) OVER (PARTITION BY file ORDER BY line), 0) AS prior FROM pk JOIN code ON path = file WHERE len(list_filter(wanted, lambda x: abs(x - line) <= 1)) > 0),
  la AS (SELECT path AS file, max(line) AS last FROM code GROUP BY path)
SELECT file, any_value(rank) AS rank, string_agg(CASE WHEN prior < line - 1 THEN '⋮' || chr(10) ELSE '' END || '│' || text, chr(10) ORDER BY line) || CASE WHEN max(line) < any_value(last) THEN chr(10) || '⋮' ELSE '' END AS shown
FROM ne JOIN pk USING (file) JOIN la USING (file) GROUP BY file""")
def repo_map_lines(spark: SparkSession, d: str) -> DataFrame:
    """The best functions that fit 2,048 tokens, by file, each file with its lines of interest and what stands beside them."""
    budget, code = 2048, code_files_of(spark, d)
    tags = functions_of(spark, d).join(files_of(spark, d), "file").select(F.col("doc_id").alias("file"), "name", "line")
    ranked = G.ranked_tags(tags, document_ranks(spark, d), ["The", "La"], [7], [9]).withColumn("rank", F.round("rank", 9))
    order = [F.desc("rank"), F.asc("file"), F.asc("line"), F.asc("name")]
    # a tag costs a token at least, so no more tags than that can fit
    best = stash(ranked.orderBy(*order).limit(budget), "best-tags")
    said = best.join(code.withColumnRenamed("path", "file"), "file").select("file", "name", "line", "rank", F.get("lines", (F.col("line") - 1).cast("int")).alias("text"))
    first = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("rank"), "line", "name")) == 1
    costs = said.withColumn("cost", token_count(F.col("text")) + 1 + F.when(first, 3).otherwise(0)).drop("text")
    picked = running_total(costs, order, "cost").where(F.col("used") <= budget)
    files = picked.groupBy("file").agg(F.max("rank").alias("rank"), F.collect_list("line").alias("at"))
    return files.join(code.withColumnRenamed("path", "file"), "file").select("file", "rank", L.of_interest(F.col("lines"), F.col("at")).alias("shown"))


@reg.add(f"WITH {SYMS}, w AS (SELECT DISTINCT file FROM files JOIN documents USING (doc_id) WHERE lang = 'de') SELECT file AS id, 'file' AS type, file FROM w UNION ALL SELECT file || ':' || name, kind, file FROM sy WHERE file IN (SELECT file FROM w)")
def file_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All nodes of the German files."""
    nodes, _ = G.build_nodes(files_of(spark, d), symbols_of(spark, d))
    wanted = files_of(spark, d).join(table(spark, d, "documents").where("lang = 'de'").select("doc_id"), "doc_id", "left_semi")
    return nodes.join(wanted.select("file"), "file", "left_semi").select("id", "type", "file")


@reg.add(f"""WITH {CALLS}, li AS (SELECT src AS a, dst AS b FROM ie UNION ALL SELECT split_part(src, ':', 1), split_part(dst, ':', 1) FROM ce),
  pr AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM li WHERE a <> b GROUP BY ALL), dg AS (SELECT f, count(*) AS deg FROM (SELECT a AS f FROM pr UNION ALL SELECT b FROM pr) GROUP BY f), lm AS (SELECT greatest(3 * avg(deg), 5) AS lim FROM dg)
SELECT a, b, round(CASE WHEN greatest(x.deg, y.deg) > lim THEN n * sqrt(lim / greatest(x.deg, y.deg)) ELSE n END, 6) AS weight FROM pr JOIN dg x ON x.f = a JOIN dg y ON y.f = b JOIN lm ON true""")
def symbol_file_graph(spark: SparkSession, d: str) -> DataFrame:
    """Links between files, from their imports and calls."""
    file = lambda c: F.get(F.split(c, ":"), F.lit(0))
    links = import_edges(spark, d).unionByName(call_edges(spark, d)).select(file(F.col("src")).alias("a"), file(F.col("dst")).alias("b"))
    return G.file_edges(links).select("a", "b", F.round("weight", 6).alias("weight"))


def repo_map(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    ranks = document_ranks(spark, d)
    tags = docs.select(F.col("doc_id").alias("file"), X.first_token(F.col("text")).alias("name"))
    ranked = G.ranked_tags(tags, ranks, ["the", "la"], [], [])
    entry = F.concat(F.col("file").cast("string"), F.lit(": "), F.coalesce("name", F.lit("")))
    rows = ranked.select("file", "name", F.round("rank", 9).alias("rank"), F.length(entry).alias("cost"))
    mapped = running_total(rows, [F.desc("rank"), F.asc("file")], "cost")
    return mapped.where("used <= 4096").select("file", "name", "rank", "used")


reg.add(pagerank_sql() + """, t AS (SELECT r10.id AS file, df.name, round(rank * CASE WHEN df.name IN ('the', 'la') THEN 10 ELSE 1 END, 9) AS rank FROM r10 JOIN df ON df.doc_id = r10.id)
SELECT file, name, rank, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(length(file || ': ' || coalesce(name, ''))) OVER (ORDER BY rank DESC, file ROWS UNBOUNDED PRECEDING) AS used FROM t) WHERE used <= 4096""")(repo_map)


@reg.add(f"WITH {TAGS} SELECT (SELECT count(*) FROM df) AS n_defs, (SELECT count(*) FROM rf) AS n_refs, (SELECT count(*) FROM documents) AS n_files")
def tag_report(spark: SparkSession, d: str) -> DataFrame:
    defs, refs = tags_of(spark, d)
    kinds = defs.select("doc_id", F.lit("def").alias("kind")).unionByName(refs.select("doc_id", F.lit("ref").alias("kind")))
    return kinds.agg(F.count_if(F.col("kind") == "def").alias("n_defs"), F.count_if(F.col("kind") == "ref").alias("n_refs"), F.count_distinct("doc_id").alias("n_files"))


@reg.add(f"WITH {TAGS}, h AS (SELECT doc_id, name, 'def' AS kind FROM df UNION ALL SELECT doc_id, name, 'ref' FROM rf) SELECT doc_id, name, kind FROM h WHERE contains(name, 'tionthe') ORDER BY kind <> 'def', instr(name, 'tionthe'), name, doc_id LIMIT 50")
def identifier_search(spark: SparkSession, d: str) -> DataFrame:
    defs, refs = tags_of(spark, d)
    tags = defs.withColumn("kind", F.lit("def")).unionByName(refs.select("doc_id", "name").withColumn("kind", F.lit("ref")))
    return tags.where(F.lower("name").contains("tionthe")).orderBy(F.col("kind") != "def", F.instr("name", "tionthe"), "name", "doc_id").limit(50)


PAIRS = """se AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), pr AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM se a JOIN se b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL),
  dg AS (SELECT f, count(*) AS deg FROM (SELECT a AS f FROM pr UNION ALL SELECT b FROM pr) GROUP BY f), lm AS (SELECT greatest(3 * avg(deg), 5) AS lim FROM dg),
  fe AS (SELECT a, b, CASE WHEN greatest(x.deg, y.deg) > lim THEN n * sqrt(lim / greatest(x.deg, y.deg)) ELSE CAST(n AS DOUBLE) END AS weight FROM pr JOIN dg x ON x.f = a JOIN dg y ON y.f = b JOIN lm ON true)"""


def supplier_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that share an order, as links a, b; an order has at most seven lines, so its pairs are few."""
    of = table(spark, d, "lineitem").where("l_orderkey is not null").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    with_later = F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return of.where(F.size("s") > 1).select(F.inline(F.flatten(with_later)))


@reg.add(f"WITH {PAIRS} SELECT a, b, round(weight, 6) AS weight FROM fe")
def file_graph(spark: SparkSession, d: str) -> DataFrame:
    return G.file_edges(supplier_pairs(spark, d)).select("a", "b", F.round("weight", 6).alias("weight"))


@reg.add(f"""WITH {PAIRS}, w AS (SELECT a AS f FROM fe UNION SELECT b FROM fe),
  ch AS (SELECT s_suppkey AS a, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b FROM supplier),
  al AS (SELECT a, b, weight FROM fe UNION ALL SELECT a, b, 0.22 FROM ch WHERE b IS NOT NULL AND (a NOT IN (SELECT f FROM w) OR b NOT IN (SELECT f FROM w)))
SELECT a, b, round(sum(weight), 6) AS weight FROM al GROUP BY ALL""")
def directory_chain(spark: SparkSession, d: str) -> DataFrame:
    pairs = G.file_edges(supplier_pairs(spark, d))
    files = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.col("s_nationkey").alias("dir"))
    return G.directory_chain(files, pairs).select("a", "b", F.round("weight", 6).alias("weight"))


@reg.add()
def communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the suppliers over all their shared orders."""
    return G.communities(G.file_edges(supplier_pairs(spark, d)), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


MERGE = """m AS (SELECT CASE WHEN doc_id % 50 = 3 THEN 1000 + doc_id ELSE doc_id % 20 END AS community, 'src' || (doc_id % 20) || '/' || lang || '/' || doc_id AS file FROM documents)"""


def membership_of(spark: SparkSession, d: str) -> DataFrame:
    i, s = F.col("doc_id"), lambda c: c.cast("string")
    c = F.when(i % 50 == 3, 1000 + i).otherwise(i % 20)
    return table(spark, d, "documents").select(c.alias("community"), F.concat(F.lit("src"), s(i % 20), F.lit("/"), "lang", F.lit("/"), s(i)).alias("file"))


@reg.add(f"""WITH {MERGE}, sz AS (SELECT community, count(DISTINCT file) AS n, min(file) AS seed FROM m GROUP BY community),
  sc AS (SELECT t.community AS tiny, r.community AS c, r.n, max(CASE WHEN split_part(file, '/', 1) <> split_part(t.seed, '/', 1) THEN 0 WHEN split_part(file, '/', 2) <> split_part(t.seed, '/', 2) THEN 1 ELSE 7 END) AS s
    FROM sz t JOIN sz r ON t.n < 2 AND r.n >= 2 JOIN m ON m.community = r.community GROUP BY ALL),
  bt AS (SELECT tiny, c FROM (SELECT *, row_number() OVER (PARTITION BY tiny ORDER BY s DESC, n DESC, c) AS k FROM sc) WHERE k = 1),
  o AS (SELECT DISTINCT coalesce(bt.c, m.community) AS c, file FROM m LEFT JOIN bt ON tiny = community)
SELECT dense_rank() OVER (ORDER BY c) - 1 AS community, file FROM o""")
def merge_tiny_communities(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_tiny(membership_of(spark, d)).select(F.col("community").cast("long").alias("community"), "file")


@reg.add(f"WITH {MERGE} SELECT community, count(DISTINCT file) AS n_files, array_to_string(list(file ORDER BY file)[1:5], ',') AS core, string_agg('- ' || file || ' (file)', chr(10) ORDER BY file) FILTER (r <= 40) AS listing FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY file) AS r FROM m) GROUP BY community")
def community_listing(spark: SparkSession, d: str) -> DataFrame:
    m = membership_of(spark, d)
    m = m.withColumns({"r": F.row_number().over(Window.partitionBy("community").orderBy("file")), "n": F.count("*").over(Window.partitionBy("community"))})
    first = lambda k: F.array_sort(F.collect_list(F.when(F.col("r") <= k, F.col("file"))))
    per = m.groupBy("community").agg(F.max("n").alias("n_files"), first(5).alias("c"), first(40).alias("l"))
    return per.select("community", "n_files", F.array_join("c", ",").alias("core"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x, F.lit(" (file)"))), "\n").alias("listing"))
