"""File queries. Paths: varied by document. Sections: a source each, its documents the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import files as S
from ..operators import sections as T
from .common import Registry, table

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

DIRS = ("src", "docs", ".github/workflows", "node_modules/x", "lib/Sub", ".git", "a/dist", "")
NAMES = ("{}.py", "{}.md", "README.md", "LICENSE", "{}.png", "Dockerfile", "{}.yml", "{}.min.js", "{}", ".hidden", "{}.TXT")
_DIRS = "[" + ", ".join(f"'{x}'" for x in DIRS) + "]"
_NAMES = "[" + ", ".join(f"'{x}'" for x in NAMES) + "]"
PATHS = f"""pa AS (SELECT doc_id, n_chars, text, CASE {_DIRS}[doc_id % 8 + 1] WHEN '' THEN '' ELSE {_DIRS}[doc_id % 8 + 1] || '/' END || replace({_NAMES}[doc_id % 11 + 1], '{{}}', CAST(doc_id AS VARCHAR)) AS path FROM documents),
  px AS (SELECT *, string_split(path, '/')[-1] AS name, regexp_replace(path, '/?[^/]*$', '') AS dir FROM pa), pt AS (SELECT *, lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)) AS ext FROM px)"""


def paths_of(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    pick = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), (i % n).cast("int"))
    folder = pick(DIRS, 8)
    path = F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), F.replace(pick(NAMES, 11), F.lit("{}"), i.cast("string")))
    return table(spark, d, "documents").select("doc_id", "n_chars", "text", path.alias("path"))


def _in(xs: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


@reg.add(f"""WITH {PATHS} SELECT doc_id, path, CASE WHEN lower(name) IN {_in(S.CODE_NAMES)} THEN 'code' WHEN lower(name) IN {_in(S.TEXT_NAMES)} THEN 'text' WHEN ext IN {_in(S.CODE_EXTENSIONS)} THEN 'code' WHEN ext IN {_in(S.TEXT_EXTENSIONS)} THEN 'text'
  WHEN ext IN {_in(S.NOISE_EXTENSIONS)} THEN NULL ELSE 'text' END AS category, dir <> '.git' AND lower(name) NOT IN {_in(S.SKIP_NAMES)} AND NOT starts_with(dir, '.github') AS kept FROM pt""")
def classify_files(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return paths_of(spark, d).select("doc_id", "path", S.category(p).alias("category"), S.kept(p).alias("kept"))


@reg.add(f"""WITH {PATHS} SELECT doc_id, (dir = '.github/workflows' AND ext IN ('yml', 'yaml')) OR (dir = 'docs' AND regexp_matches(name, '\\.(md|rst|txt)$')) OR name IN {_in(S.IMPORTANT_NAMES)} AS important,
  NOT starts_with(dir, 'node_modules') AND dir NOT IN ('a/dist', '.git', '.github/workflows') AND NOT starts_with(name, '.') AND NOT regexp_matches(lower(path), '\\.(png|min\\.js)$') AND n_chars <= 2097152 AS searchable,
  dir = 'docs' OR dir LIKE 'docs/%' AS under_docs FROM pt""")
def file_scopes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return paths_of(spark, d).select("doc_id", S.is_important(p).alias("important"), S.searchable(p, F.col("n_chars")).alias("searchable"), S.under(p, "docs").alias("under_docs"))


@reg.add(f"WITH {PATHS} SELECT doc_id, path FROM pt WHERE NOT (starts_with(dir, 'node_modules') OR dir = 'a/dist' OR regexp_matches(name, '^[0-9]1\\.py$') OR ends_with(name, '.min.js'))")
def glob_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return paths_of(spark, d).where(~S.excluded(F.col("path"), ["./node_modules/", "*/dist", "[0-9]1.py", "*.min.js"])).select("doc_id", "path")


@reg.add("SELECT doc_id, contains(substring(text, 1, 1024), '!') AND strlen(split_part(substring(text, 1, 1024), '!', 1)) < 1024 AS is_binary FROM documents")
def binary_test(spark: SparkSession, d: str) -> DataFrame:
    body = F.encode(F.replace(F.left("text", F.lit(1024)), F.lit("!"), F.lit("\x00")), "UTF-8")
    return table(spark, d, "documents").select("doc_id", S.is_binary(body).alias("is_binary"))


@reg.add(f"WITH {PATHS} SELECT CASE ext WHEN '' THEN '(no ext)' ELSE ext END AS ext, count(*) AS n FROM pt GROUP BY 1 ORDER BY n DESC, ext LIMIT 15")
def file_statistics(spark: SparkSession, d: str) -> DataFrame:
    ext = F.when(S.extension(F.col("path")) == "", "(no ext)").otherwise(S.extension(F.col("path")))
    return paths_of(spark, d).groupBy(ext.alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(15)


@reg.add(f"""WITH {PATHS} SELECT count(*) FILTER (ext IN ('py', 'pyi')) AS n_py, count(*) FILTER (ext IN ('ts', 'tsx', 'js')) AS n_ts, CASE WHEN count(*) FILTER (ext IN ('py', 'pyi')) >= count(*) FILTER (ext IN ('ts', 'tsx', 'js')) THEN 'python' ELSE 'typescript' END AS main,
  bool_or(name = 'Dockerfile') AS has_docker, bool_or(starts_with(path, '.github/workflows/')) AS has_ci FROM pt""")
def tech_stack(spark: SparkSession, d: str) -> DataFrame:
    ext, p = S.extension(F.col("path")), F.col("path")
    py, ts = F.count_if(ext.isin("py", "pyi")), F.count_if(ext.isin("ts", "tsx", "js"))
    return paths_of(spark, d).agg(
        py.alias("n_py"), ts.alias("n_ts"), F.when(py >= ts, "python").otherwise("typescript").alias("main"), F.bool_or(S.name_of(p) == "Dockerfile").alias("has_docker"), F.bool_or(p.startswith(".github/workflows/")).alias("has_ci")
    )


@reg.add(f"""WITH {PATHS}, n AS (SELECT path, len(string_split(path, '/')) AS depth, false AS is_dir FROM pt UNION ALL SELECT dir, len(string_split(dir, '/')), true FROM pt WHERE dir <> '' UNION ALL SELECT split_part(dir, '/', 1), 1, true FROM pt WHERE contains(dir, '/')),
  u AS (SELECT path, depth, bool_or(is_dir) AS is_dir, regexp_replace(path, '/?[^/]*$', '') AS parent FROM n GROUP BY path, depth)
SELECT path, CAST(depth AS INTEGER) AS depth, is_dir, row_number() OVER w AS place, lead(path) OVER w IS NULL AS last FROM u WINDOW w AS (PARTITION BY parent ORDER BY is_dir DESC, lower(string_split(path, '/')[-1]), path)""")
def directory_tree(spark: SparkSession, d: str) -> DataFrame:
    return S.tree(paths_of(spark, d).select("path")).select("path", "depth", "is_dir", "place", "last")


@reg.add(f"""WITH {PATHS}, c AS (SELECT doc_id % 20 AS repo, path, text, CASE name WHEN 'README.md' THEN 1 ELSE 9 END AS prio FROM pt WHERE name = 'README.md')
SELECT repo, path, left(text, 2000) AS opening FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY prio, length(path), path, text) AS n FROM c) WHERE n = 1""")
def readme_pick(spark: SparkSession, d: str) -> DataFrame:
    prio = F.array_position(F.array(*[F.lit(x) for x in S.README_NAMES]), S.name_of(F.col("path")))
    c = paths_of(spark, d).withColumns({"prio": prio, "repo": F.col("doc_id") % 20}).where("prio > 0")
    n = F.row_number().over(Window.partitionBy("repo").orderBy("prio", F.length("path"), "path", "text"))
    return c.withColumn("n", n).where("n = 1").select("repo", "path", F.left("text", F.lit(2000)).alias("opening"))


@reg.add("""WITH f AS (SELECT source, doc_id, least(length(text), 4000) AS size, text FROM documents), u AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM f)
SELECT source, doc_id, CAST(used AS BIGINT) AS used, CASE WHEN length(text) > 4000 THEN left(text, 4000) || '...' ELSE text END AS body FROM u WHERE used < 16000""")
def section_contents(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").select("source", "doc_id", F.least(F.length("text"), F.lit(4000)).alias("size"), "text")
    body = F.when(F.length("text") > 4000, F.concat(F.left("text", F.lit(4000)), F.lit("..."))).otherwise(F.col("text"))
    return T.within_budget(f, ["source"], ["doc_id"], "size", 16000, whole=False).select("source", "doc_id", "used", body.alias("body"))


@reg.add("""WITH RECURSIVE e AS (SELECT r_regionkey AS id, r_name AS title, CAST(NULL AS BIGINT) AS parent FROM region UNION ALL SELECT 100 + n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 1000 + s_suppkey, s_name, 100 + s_nationkey FROM supplier),
  w AS (SELECT id, title, title AS crumbs, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.id, e.title, w.crumbs || ' > ' || e.title, depth + 1 FROM e JOIN w ON e.parent = w.id)
SELECT CAST(id AS BIGINT) AS id, title, crumbs, depth FROM w""")
def toc_flatten(spark: SparkSession, d: str) -> DataFrame:
    return T.flatten(toc_of(spark, d))[0]


def toc_of(spark: SparkSession, d: str) -> DataFrame:
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    long = lambda c: c.cast("long")
    rows = r.select(long(F.col("r_regionkey")).alias("id"), F.col("r_name").alias("title"), F.lit(None).cast("long").alias("parent"))
    rows = rows.unionByName(n.select(long(100 + F.col("n_nationkey")).alias("id"), F.col("n_name").alias("title"), long(F.col("n_regionkey")).alias("parent")))
    return rows.unionByName(s.select(long(1000 + F.col("s_suppkey")).alias("id"), F.col("s_name").alias("title"), long(100 + F.col("s_nationkey")).alias("parent")))


@reg.add("""WITH RECURSIVE c AS (SELECT 10000000 + c_custkey AS k, c_custkey, c_name, c_nationkey FROM customer),
  e AS (SELECT CAST(CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN k - 1 ELSE k END AS BIGINT) AS id, CASE WHEN c_custkey % 17 = 0 THEN '  ' ELSE c_name END AS title,
    CAST(CASE WHEN c_custkey % 19 = 0 THEN k WHEN c_custkey % 23 = 0 THEN -5 WHEN c_custkey % 100 = 1 THEN NULL ELSE 10000000 + c_custkey // 100 * 100 + 1 END AS BIGINT) AS parent FROM c),
  ok AS (SELECT * FROM e WHERE id IS NOT NULL AND trim(title) <> ''), g AS (SELECT id, title, parent FROM ok QUALIFY row_number() OVER (PARTITION BY id ORDER BY title, coalesce(CAST(parent AS VARCHAR), '')) = 1),
  w AS (SELECT id FROM g WHERE parent IS NULL UNION ALL SELECT g.id FROM g JOIN w ON g.parent = w.id)
SELECT why, id, count(*) AS n FROM (
  SELECT 'id' AS why, CAST(NULL AS BIGINT) AS id FROM e WHERE id IS NULL UNION ALL SELECT 'title', id FROM e WHERE id IS NOT NULL AND trim(title) = ''
  UNION ALL SELECT 'repeated', id FROM (SELECT id, unnest(range(count(*) - 1)) FROM ok GROUP BY id) UNION ALL SELECT 'root', id FROM g WHERE id NOT IN (SELECT id FROM w)) GROUP BY ALL""")
def toc_rejects(spark: SparkSession, d: str) -> DataFrame:
    """What a table of contents made of the customers can't use: missing ids and titles, repeated ids, nodes without a root."""
    i = F.col("c_custkey").cast("long")
    k = i + 10_000_000
    rows = table(spark, d, "customer").select(
        F.when(i % 11 == 0, F.lit(None)).when(i % 13 == 0, k - 1).otherwise(k).alias("id"), F.when(i % 17 == 0, "  ").otherwise(F.col("c_name")).alias("title"),
        F.when(i % 19 == 0, k).when(i % 23 == 0, F.lit(-5)).when(i % 100 == 1, F.lit(None)).otherwise(10_000_001 + F.expr("c_custkey div 100") * 100).cast("long").alias("parent"),
    )
    good, rejects = T.check_toc(rows)
    return rejects.select("why", "id").unionByName(T.flatten(good)[1].select(F.lit("root").alias("why"), "id")).groupBy("why", "id").agg(F.count("*").alias("n"))


@reg.add("SELECT source || '/2024-01-15_' || source || '/' || lang || '.json' AS key, 'https://files.example/' || source || '/2024-01-15_' || source || '/' || lang || '.json' AS url, count(*) AS n_documents FROM documents GROUP BY source, lang")
def publish_layout(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat("source", F.lit("/2024-01-15_"), "source", F.lit("/"), "lang", F.lit(".json"))
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n_documents")).select(key.alias("key"), F.concat(F.lit("https://files.example/"), key).alias("url"), "n_documents")
