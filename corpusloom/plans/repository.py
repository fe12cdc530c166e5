"""What a repository's files, pages, tasks and tool results tell. Paths: varied by document, as in plans.files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import anchors as A
from ..operators import chunks as K
from ..operators import files as S
from ..operators import generate as M
from ..operators import signatures as N
from .common import Registry, table
from .files import PATHS, _in, paths_of
from .functions import _URLS, NORMAL_URL, varied_urls
from .lines import CODE, LINES, code_of

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

_SKIPPED = _in(list(S.SEARCH_SKIP_DIRS))


@reg.add(f"WITH {PATHS} SELECT doc_id, path FROM pt WHERE len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.'))) = 0 AND NOT list_has_any(string_split(dir, '/'), ['node_modules', '__pycache__', 'venv', 'env'])")
def source_scan(spark: SparkSession, d: str) -> DataFrame:
    return paths_of(spark, d).where(S.scanned(F.col("path"))).select("doc_id", "path")


@reg.add(f"WITH {PATHS} SELECT path FROM pt WHERE ext IN ('py', 'md') AND NOT list_has_any(string_split(dir, '/'), {list(S.SEARCH_SKIP_DIRS)}) ORDER BY path")
def file_list(spark: SparkSession, d: str) -> DataFrame:
    return S.listing(paths_of(spark, d), ["py", "md"])


@reg.add(f"WITH {PATHS} SELECT path FROM pt WHERE regexp_matches(name, '^[0-9]*5\\.(py|png)$') ORDER BY path LIMIT 10")
def file_search(spark: SparkSession, d: str) -> DataFrame:
    return S.named_files(paths_of(spark, d), "[0-9]*5.p[yn]*")


@reg.add(f"WITH {PATHS} SELECT doc_id, path FROM pt WHERE ends_with(name, '.py') OR regexp_matches(name, '^README\\...$')")
def include_patterns(spark: SparkSession, d: str) -> DataFrame:
    return paths_of(spark, d).where(S.included(F.col("path"), ["*.py", "README.??"])).select("doc_id", "path")


_PROJECT = "['main.py', 'x', 'Dockerfile', 'urls.py', 'page.tsx', 'App.tsx', 'server.js', 'setup.py', 'package.json', 'notes.md']"


@reg.add(f"""WITH e AS (SELECT coalesce(source, 'none') || '/' || CASE doc_id % 7 WHEN 3 THEN 'node_modules/' WHEN 5 THEN 'a/build/' ELSE '' END || doc_id || '/' || {_PROJECT}[1 + doc_id % 10] AS path, doc_id FROM documents)
SELECT CASE WHEN string_split(path, '/')[-1] IN ('main.py', 'urls.py', 'page.tsx', 'server.js') THEN 'entry' ELSE 'config' END AS kind, path FROM e
WHERE string_split(path, '/')[-1] NOT IN ('x', 'App.tsx', 'notes.md') AND doc_id % 7 NOT IN (3, 5)""")
def project_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that start or set up a program, a path for each document."""
    i, names = F.col("doc_id"), F.array(*[F.lit(x) for x in ("main.py", "x", "Dockerfile", "urls.py", "page.tsx", "App.tsx", "server.js", "setup.py", "package.json", "notes.md")])
    folder = F.when(i % 7 == 3, "node_modules/").when(i % 7 == 5, "a/build/").otherwise("")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), folder, i.cast("string"), F.lit("/"), F.get(names, (i % 10).cast("int")))
    return S.project_files(table(spark, d, "documents").select(path.alias("path")))


def _routes(spark: SparkSession, d: str) -> DataFrame:
    return paths_of(spark, d).select("doc_id", "text", S.split_route(F.col("path")).alias("route"))


@reg.add(f"""WITH {PATHS}, r AS (SELECT doc_id, text, CASE WHEN ext IN ('md', 'mdx', 'markdown', 'rst') THEN 'markdown' ELSE 'plain_text' END AS route FROM pt)
SELECT route, count(*) AS n_files, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM r GROUP BY route""")
def split_routes(spark: SparkSession, d: str) -> DataFrame:
    return _routes(spark, d).groupBy("route").agg(F.count("*").alias("n_files"), F.sum(F.length("text")).alias("n_chars"))


@reg.add()
def plain_text_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the files that are no markdown, by paragraphs."""
    plain = _routes(spark, d).where("route = 'plain_text'").select("doc_id", F.posexplode(K.paragraphs(F.col("text"))).alias("chunk", "content"))
    return plain.select("doc_id", "chunk", F.lit("plain_text").alias("chunk_type"), F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


@reg.add(rf"""WITH {LINES}, {CODE}, x AS (SELECT source AS repo, doc_id, CASE doc_id % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'tsx' ELSE 'js' END AS ext FROM documents),
  s AS (SELECT repo, x.doc_id || '.' || ext AS file, ext, line, CASE WHEN ext = 'py' THEN CASE WHEN contains(t, ':') AND (starts_with(t, 'class ') OR (starts_with(t, 'def ') AND NOT starts_with(t, 'def _') AND length(string_split(t, ':')[1]) < 80)) THEN string_split(t, ':')[1] END
    WHEN regexp_matches(t, '^export class \w') THEN 'export class ' || regexp_extract(t, '^export class (\w+)', 1) END AS signature FROM (SELECT *, trim(text, E' \t\r') AS t FROM code) c JOIN x ON x.doc_id = c.path),
  n AS (SELECT *, row_number() OVER (PARTITION BY repo, ext = 'py' ORDER BY file, line) AS place FROM s WHERE signature IS NOT NULL)
SELECT repo, CASE ext WHEN 'py' THEN 'py' WHEN 'tsx' THEN 'ts' ELSE 'js' END AS language, place, file, line, signature FROM n WHERE place <= 20""")
def public_signatures(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    ext = F.when(i % 3 == 0, "py").when(i % 3 == 1, "tsx").otherwise("js")
    files = table(spark, d, "documents").select(F.col("source").alias("repo"), i.alias("path"), ext.alias("ext"))
    lines = code_of(spark, d).join(files, "path").withColumn("file", F.concat(F.col("path").cast("string"), F.lit("."), "ext"))
    return N.public_signatures(lines)


@reg.add("""WITH b AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '"' || event_type || '"' WHEN 1 THEN '[' || props || ']' WHEN 2 THEN props || '}' WHEN 3 THEN NULL ELSE props END AS raw FROM events)
SELECT event_id, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw ELSE '{}' END AS result FROM b""")
def task_results(spark: SparkSession, d: str) -> DataFrame:
    k, props = F.col("event_id") % 5, F.col("props")
    raw = F.when(k == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(k == 1, F.concat(F.lit("["), props, F.lit("]"))).when(k == 2, F.concat(props, F.lit("}"))).when(k == 4, props)
    return table(spark, d, "events").select("event_id", V.json_object(raw).alias("result"))


@reg.add("""WITH r AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' ' || c_custkey || ' ' WHEN 1 THEN '-' || c_custkey WHEN 2 THEN c_custkey || '.5' WHEN 3 THEN c_name ELSE NULL END AS stars, CASE c_custkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE ' ' || c_name END AS given, CASE c_custkey % 2 WHEN 0 THEN c_mktsegment ELSE '' END AS generated FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(trim(stars), '^[+-]?[0-9]+$') THEN CAST(trim(stars) AS BIGINT) END AS stars, coalesce(nullif(trim(given), ''), nullif(trim(generated), '')) AS description FROM r""")
def repository_display(spark: SparkSession, d: str) -> DataFrame:
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    raw = F.when(k % 5 == 0, F.concat(F.lit(" "), key, F.lit(" "))).when(k % 5 == 1, F.concat(F.lit("-"), key)).when(k % 5 == 2, F.concat(key, F.lit(".5"))).when(k % 5 == 3, F.col("c_name"))
    given, generated = F.when(k % 3 == 0, "  ").when(k % 3 == 2, F.concat(F.lit(" "), "c_name")), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("")
    return table(spark, d, "customer").select("c_custkey", V.star_count(raw).alias("stars"), V.display_description(given, generated).alias("description"))


@reg.add("""WITH s AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Unknown' WHEN 1 THEN lang || ':unknown' WHEN 2 THEN '' WHEN 3 THEN lang || ':' || source || '/unknown.py' ELSE source END AS src FROM documents)
SELECT doc_id, src FROM s WHERE src <> '' AND lower(src) <> 'unknown' AND NOT ends_with(lower(src), ':unknown')""")
def valid_sources(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 5
    src = F.when(k == 0, "Unknown").when(k == 1, F.concat("lang", F.lit(":unknown"))).when(k == 2, "").when(k == 3, F.concat("lang", F.lit(":"), "source", F.lit("/unknown.py"))).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", src.alias("src")).where(V.valid_source(F.col("src")))


@reg.add("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE url END AS structure, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN [CAST(NULL AS VARCHAR), ''] ELSE [url || '/a', url || '/b'] END AS contents FROM pages)
SELECT page_id, coalesce(structure <> '', false) AND coalesce(len(list_filter(contents, lambda x: x <> '')) > 0, false) AS complete FROM p""")
def complete_artifacts(spark: SparkSession, d: str) -> DataFrame:
    i, none = F.col("page_id"), F.lit(None).cast("string")
    structure = F.when(i % 4 == 1, "").when(i % 4 > 1, F.col("url"))
    contents = F.when(i % 3 == 1, F.array(none, F.lit(""))).when(i % 3 == 2, F.array(F.concat("url", F.lit("/a")), F.concat("url", F.lit("/b"))))
    return table(spark, d, "pages").select("page_id", V.complete_artifacts(structure, contents).alias("complete"))


@reg.add(f"""WITH {_URLS}, n AS (SELECT page_id, url, {NORMAL_URL.replace('(r,', '(trim(url),')} AS normal FROM u),
  c AS (SELECT conv_id, max(turn) AS updated FROM conversations GROUP BY conv_id), h AS (SELECT c.*, normal FROM c JOIN n ON page_id = conv_id % 50)
SELECT conv_id, updated, row_number() OVER (ORDER BY updated DESC, conv_id) AS place FROM h WHERE normal = 'https://github.com/own2/repo2'""")
def repository_chats(spark: SparkSession, d: str) -> DataFrame:
    """Chats about one repository, however its address was spelled, newest first."""
    pages = varied_urls(spark, d).select("page_id", X.normalize_repo_url(F.col("url")).alias("normal"))
    chats = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated"))
    asked = X.normalize_repo_url(F.lit("git@github.com:Own2/Repo2.git"))
    mine = chats.withColumn("page_id", F.col("conv_id") % 50).join(pages.where(F.col("normal") == asked), "page_id")
    return mine.select("conv_id", "updated", F.row_number().over(Window.orderBy(F.desc("updated"), "conv_id")).alias("place"))


@reg.add("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM conversations")
def message_order(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", place.alias("place"))


@reg.add("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(CASE WHEN event_type <> 'signup' THEN ts END, ts - INTERVAL 1 DAY) DESC, event_id) AS place FROM events")
def task_order(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of a user by their last update, or by their creation where there was none."""
    updated, created = F.when(F.col("event_type") != "signup", F.col("ts")), F.col("ts") - F.expr("INTERVAL 1 DAY")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.coalesce(updated, created)), "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", place.alias("place"))


def _symbol_line_sql(text: str, symbol: str) -> str:
    return f"list_position(list_transform(string_split({text}, chr(10)), lambda x: regexp_matches(x, '(?i)(?:def|class|function|const|let|var|export)\\s+{symbol}|{symbol}\\s*[=:(]')), true)"


@reg.add(f"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || chr(10) || 'Def The' ELSE text END AS t FROM documents)
SELECT doc_id, 'the' AS symbol, nullif({_symbol_line_sql('t', 'the')}, 0) AS line FROM t UNION ALL SELECT doc_id, 'de', nullif({_symbol_line_sql('t', 'de')}, 0) FROM t UNION ALL SELECT doc_id, '', NULL FROM t""")
def symbol_line(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nDef The"))).otherwise(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", text.alias("text"), F.explode(F.array(F.lit("the"), F.lit("de"), F.lit(""))).alias("symbol"))
    return rows.select("doc_id", "symbol", V.first_line_of(F.col("text"), F.col("symbol")).alias("line"))


@reg.add("""WITH w AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CAST(json_object('intro', text, 'sections', json_array(json_object('title', lang, 'content', source))) AS VARCHAR)
    WHEN 1 THEN CAST(json_object('intro', CAST(json_object('intro', text, 'mermaid', 'graph') AS VARCHAR), 'sections', json_array(), 'mermaid', 'old') AS VARCHAR)
    WHEN 2 THEN '{"intro": "no sections"}' WHEN 3 THEN text END AS raw, text, lang, source FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN md5(coalesce(text, '')) ELSE md5('') END AS intro, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n_sections, CASE WHEN doc_id % 5 = 1 THEN 'graph' ELSE '' END AS mermaid FROM w""")
def wiki_pages(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("doc_id") % 5, F.array().cast(f"array<{V.SECTION}>")
    section = F.struct(F.col("lang").alias("title"), F.col("source").alias("content"))
    plain = F.to_json(F.struct(F.col("text").alias("intro"), F.array(section).alias("sections")))
    inner = F.to_json(F.struct(F.col("text").alias("intro"), F.lit("graph").alias("mermaid")))
    nested = F.to_json(F.struct(inner.alias("intro"), none.alias("sections"), F.lit("old").alias("mermaid")))
    raw = F.when(k == 0, plain).when(k == 1, nested).when(k == 2, '{"intro": "no sections"}').when(k == 3, F.col("text"))
    page = table(spark, d, "documents").select("doc_id", V.wiki_page(raw).alias("p"))
    return page.select("doc_id", F.md5("p.intro").alias("intro"), F.size("p.sections").alias("n_sections"), "p.mermaid")


TOOLS = ("code_graph", "code_graph", "code_graph", "code_graph", "file_read", "repo_map", "rag_search", "grep_search", "grep_search", "web_search")
OPERATIONS = ("find_definition", "find_callers", "get_all_symbols", "find_callees", "", "", "", "", "", "")
_ANCHORS = rf"""b AS (SELECT doc_id % 50 AS session, doc_id AS seq, CAST(doc_id % 10 AS INTEGER) AS k, coalesce(source, 'none') || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.py' END AS file, text, (n_chars % 101) / 100.0 AS rel FROM documents),
  an AS (SELECT session, seq, 0 AS place, 'definition' AS kind, 'The' AS symbol, file, CAST(coalesce(nullif(regexp_extract(text, '(?i)line[ \t\r\n]*([0-9]+)', 1), ''), nullif(regexp_extract(text, ':([0-9]+)', 1), ''), nullif(regexp_extract(text, '(?i)l([0-9]+)', 1), '')) AS BIGINT) AS line, least(rel + 0.1, 1.0) AS confidence FROM b WHERE k = 0 AND (rel > 0.5 OR regexp_matches(lower(text), 'definition|defined in|class |def |function |const |export '))
    UNION ALL SELECT session, seq, 0, 'reference', 'The', file, NULL, rel * 0.85 FROM b WHERE k = 1
    UNION ALL SELECT session, seq, 0, 'reference', 'the', 'src/x.py', NULL, 0.6 FROM b WHERE k = 2 UNION ALL SELECT session, seq, 0, 'definition', 'Made', 'src/y.py', 7, rel FROM b WHERE k = 3 UNION ALL SELECT session, seq, 1, 'reference', 'The', file, NULL, 0.5 FROM b WHERE k = 3
    UNION ALL SELECT session, seq, 0, 'definition', string_split(file, '/')[-1], file, 3, 0.9 FROM b WHERE k = 4
    UNION ALL SELECT session, seq, 1, 'definition', 'the', file, {_symbol_line_sql('text', 'the')}, 0.85 FROM b WHERE k = 4 AND {_symbol_line_sql('text', 'the')} > 0
    UNION ALL SELECT session, seq, 0, 'entrypoint', 'the', 'src/x.py', NULL, 0.7 FROM b WHERE k = 5
    UNION ALL SELECT session, seq, 0, CASE WHEN ends_with(file, '.py') THEN 'definition' ELSE 'reference' END, CAST(seq AS VARCHAR), file, NULL, least(CASE WHEN ends_with(file, '.py') THEN greatest(rel * 0.82 + 0.05, 0.72) ELSE rel * 0.7 END, 0.92) FROM b WHERE k = 6
    UNION ALL SELECT session, seq, unnest(range(5)), 'reference', 'asked', 'src/z.py', unnest(range(1, 6)), least(rel, 0.88) FROM b WHERE k = 7
    UNION ALL SELECT session, seq, 0, 'reference', 'asked', file, NULL, least(rel * 0.75, 0.8) FROM b WHERE k = 8 AND ends_with(file, '.py'))"""


def results_of(spark: SparkSession, d: str) -> DataFrame:
    """A tool result per document, of each kind of tool in turn."""
    i = F.col("doc_id")
    k = (i % 10).cast("int")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), k)
    file = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), i.cast("string"), F.when(i % 3 == 0, ".md").otherwise(".py"))
    place = "array<struct<kind:string,symbol:string,file:string,line:bigint,confidence:double>>"
    made = F.array(F.struct(F.lit("Definition"), F.lit("Made"), F.lit("src/y.py"), F.lit(7), F.lit(None)), F.struct(F.lit("use"), F.lit(""), F.lit(None), F.lit(None), F.lit(0.5))).cast(place)
    hits = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda n: F.struct(F.lit("src/z.py").alias("file"), n.cast("long").alias("line")))
    listing = F.when(k.isin(2, 5), "src/x.py: the entry").otherwise(F.col("text"))
    return table(spark, d, "documents").select(
        (i % 50).alias("session"), i.alias("seq"), pick(TOOLS).alias("tool"), pick(OPERATIONS).alias("operation"), F.lit("The").alias("symbol"), F.lit("asked").alias("pattern"),
        F.when(k != 2, file).alias("file_path"), F.when(k < 2, file).alias("primary_file"), F.lit(3).cast("long").alias("start_line"), listing.alias("content"), ((F.col("n_chars") % 101) / 100.0).alias("relevance"),
        F.array(F.lit("the"), F.lit("zz-none")).alias("entities"), F.array(F.concat(F.lit("code:"), file), F.lit("unknown")).alias("sources"), F.when(k == 3, made).alias("candidates"), F.when(k == 7, hits).alias("matches"),
    )


@reg.add(f"WITH {_ANCHORS} SELECT session, seq, CAST(place AS INTEGER) AS place, kind, symbol, file, line, round(confidence, 6) AS confidence FROM an")
def tool_anchors(spark: SparkSession, d: str) -> DataFrame:
    return A.anchors(results_of(spark, d)).withColumn("confidence", F.round("confidence", 6))


@reg.add(f"WITH {_ANCHORS} SELECT session, split_part(file, '/', 1) AS module, 'Contains ' || arg_min(symbol, seq * 10 + place) AS note FROM an WHERE kind = 'definition' AND confidence > 0.8 GROUP BY ALL")
def exploration_note(spark: SparkSession, d: str) -> DataFrame:
    return A.exploration_note(A.anchors(results_of(spark, d)))


@reg.add("SELECT doc_id, 'Answer: ' || reverse(text) AS answer FROM documents")
def generated_answers(spark: SparkSession, d: str) -> DataFrame:
    """The hook for a model, here one that says the whole text backwards."""
    def repeat(texts: list[str]) -> list[str]:
        return ["Answer: " + t[::-1] for t in texts]

    return M.generate(table(spark, d, "documents").select("doc_id", F.col("text").alias("prompt")), repeat).select("doc_id", "answer")
