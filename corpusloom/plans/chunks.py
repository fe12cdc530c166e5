"""Chunking. Markdown stand-in: a document per conversation, a heading per turn, a fenced false heading after system turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as K
from ..operators import lines as L
from .common import Registry, table
from .lines import CODE, LINES, code_of

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

MARKDOWN = """md AS (SELECT conv_id AS path, string_agg(repeat('#', CAST(turn % 3 + 1 AS INTEGER)) || ' Turn ' || turn || chr(10) || text || CASE role WHEN 'system' THEN chr(10) || '```' || chr(10) || '# not one' || chr(10) || '```' ELSE '' END, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""


def markdown_of(spark: SparkSession, d: str) -> DataFrame:
    fence = F.when(F.col("role") == "system", "\n```\n# not one\n```").otherwise("")
    body = F.concat(F.repeat(F.lit("#"), (F.col("turn") % 3 + 1).cast("int")), F.lit(" Turn "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"), fence)
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("path")).agg(F.array_sort(F.collect_list(F.struct("turn", body.alias("b")))).alias("r"))
    return rows.select("path", F.array_join(F.transform("r", lambda x: x["b"]), "\n").alias("text"))


@reg.add(rf"""
WITH {MARKDOWN}, l AS (SELECT path, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS text FROM (SELECT path, string_split(text, chr(10)) AS x FROM md)),
  f AS (SELECT *, coalesce(sum(CASE WHEN contains(text, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM l),
  h AS (SELECT *, CASE WHEN f % 2 = 0 AND regexp_matches(text, '^#{{1,6}}[ \t]+\S') THEN length(regexp_extract(text, '^#+')) END AS level FROM f),
  s AS (SELECT *, sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY line) AS section FROM h),
  g AS (SELECT path, section, max(level) AS level, max(CASE WHEN level IS NOT NULL THEN trim(regexp_replace(text, '^#+[ \t]+', '')) END) AS heading, string_agg(text, chr(10) ORDER BY line) AS content FROM s GROUP BY path, section),
  a AS (SELECT g.path, g.section, string_agg(p.heading, ' > ' ORDER BY p.section) AS breadcrumb FROM g JOIN g p ON p.path = g.path AND p.section <= g.section AND p.level <= g.level
    AND NOT EXISTS (SELECT 1 FROM g q WHERE q.path = g.path AND q.section > p.section AND q.section <= g.section AND q.level <= p.level) GROUP BY ALL)
SELECT path, CAST(section AS BIGINT) AS section, heading, level, breadcrumb, md5(content) AS digest FROM g JOIN a USING (path, section)
""")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    s = K.markdown_sections(L.line_table(markdown_of(spark, d)))
    return s.select("path", "section", "heading", "level", "breadcrumb", F.md5("content").alias("digest"))


def pack_sql(parts: str, most: int, gap: str, begun: str = "p") -> str:
    """A recursive CTE that packs rows (id, i, p) greedily; a chunk after a full one starts as `begun`."""
    return f"""
  n AS (SELECT *, count(*) OVER (PARTITION BY id) AS last FROM {parts}),
  r AS (SELECT id, i, last, p AS cur, 0 AS c, CAST(NULL AS VARCHAR) AS done FROM n WHERE i = 1 UNION ALL
    SELECT n.id, n.i, n.last, CASE WHEN length(cur) + length(p) + length({gap}) > {most} THEN {begun} ELSE trim(cur || {gap} || p, E' \\t\\n') END,
      CASE WHEN length(cur) + length(p) + length({gap}) > {most} THEN c + 1 ELSE c END, CASE WHEN length(cur) + length(p) + length({gap}) > {most} THEN trim(cur, E' \\t\\n') END
    FROM r JOIN n ON n.id = r.id AND n.i = r.i + 1),
  o AS (SELECT id, c - 1 AS chunk, done AS content FROM r WHERE done IS NOT NULL UNION ALL SELECT id, c, trim(cur, E' \\t\\n') FROM r WHERE i = last)"""


@reg.add(f"""
WITH RECURSIVE s AS (SELECT doc_id AS id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?。！？])[ \\t\\r\\n]+', E'\\\\1\\x01', 'g'), E'\\x01'), lambda x: trim(x, E' \\t\\n')), lambda x: x <> '') AS s FROM documents),
  u AS (SELECT id, unnest(s) AS p, unnest(range(1, len(s) + 1)) AS i FROM s), {pack_sql('u', 2000, "' '")}
SELECT id AS doc_id, chunk, length(content) AS n_chars, md5(content) AS digest FROM o
""")
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", F.posexplode(K.sentences(F.col("text"))).alias("chunk", "content"))
    return c.select("doc_id", "chunk", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


# turns joined by blank lines and cut at blank lines; a run of paragraphs up to a long one is packed, a long one's sentences are packed for themselves
@reg.add(f"""
WITH RECURSIVE b AS (SELECT conv_id, list_filter(list_transform(regexp_split_to_array(string_agg(text, E'\\n\\n' ORDER BY turn, text), '\\n[ \\t\\r]*\\n[ \\t\\n\\x0B\\f\\r]*'), lambda x: trim(x, E' \\t\\n')), lambda x: x <> '') AS b FROM conversations GROUP BY conv_id),
  pa AS (SELECT conv_id, k, p, length(p) > 2000 AND NOT starts_with(p, '```') AS long FROM (SELECT conv_id, unnest(b) AS p, unnest(range(1, len(b) + 1)) AS k FROM b)),
  gr AS (SELECT *, sum(CASE WHEN long OR before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS g FROM (SELECT *, lag(long, 1, false) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM pa)),
  se AS (SELECT conv_id, g, list_filter(list_transform(regexp_split_to_array(regexp_replace(p, '([.!?。！？])[ \\t\\r\\n]+', E'\\\\1\\x01', 'g'), E'\\x01'), lambda x: trim(x, E' \\t\\n')), lambda x: x <> '') AS s FROM gr WHERE long),
  t AS (SELECT row(conv_id, g) AS id, row_number() OVER (PARTITION BY conv_id, g ORDER BY k) AS i, p, E'\\n\\n' AS gap FROM gr WHERE NOT long
    UNION ALL SELECT row(conv_id, g), unnest(range(1, len(s) + 1)), unnest(s), ' ' FROM se),
  {pack_sql('t', 2000, "gap", "CASE WHEN gap = ' ' THEN p ELSE right(cur, 150) || gap || p END")}
SELECT id[1] AS conv_id, CAST(row_number() OVER (PARTITION BY id[1] ORDER BY id[2], chunk) - 1 AS INTEGER) AS chunk, length(content) AS n_chars, md5(content) AS digest FROM o
""")
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: x["t"]), "\n\n")
    c = turns.select("conv_id", F.posexplode(K.paragraphs(text)).alias("chunk", "content"))
    return c.select("conv_id", "chunk", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


@reg.add(f"""
WITH RECURSIVE l AS (SELECT doc_id AS id, list_filter(string_split(replace(text, chr(10), chr(10) || chr(1)), chr(1)), lambda x: x <> '') AS l FROM documents),
  u AS (SELECT id, unnest(l) AS p, unnest(range(1, len(l) + 1)) AS i FROM l), n AS (SELECT *, count(*) OVER (PARTITION BY id) AS last FROM u),
  r AS (SELECT id, i, last, p AS cur, 0 AS c, CAST(NULL AS VARCHAR) AS done FROM n WHERE i = 1 UNION ALL
    SELECT n.id, n.i, n.last, CASE WHEN length(cur) + length(p) > 2000 THEN p ELSE cur || p END, CASE WHEN length(cur) + length(p) > 2000 THEN c + 1 ELSE c END,
      CASE WHEN length(cur) + length(p) > 2000 THEN cur END FROM r JOIN n ON n.id = r.id AND n.i = r.i + 1),
  o AS (SELECT id, c - 1 AS part, done AS content FROM r WHERE done IS NOT NULL UNION ALL SELECT id, c, cur FROM r WHERE i = last)
SELECT id AS doc_id, part, md5(trim(content, E' \\t\\r\\n')) AS digest FROM o
""")
def line_parts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", F.posexplode(K.by_lines(F.col("text"))).alias("part", "content"))
    return c.select("doc_id", "part", F.md5("content").alias("digest"))


SYMBOLS = r"""sy AS (SELECT path AS file, regexp_extract(text, '^def (\w+)', 1) AS name, line AS start_line, line + 2 + path % 3 AS end_line FROM code WHERE regexp_matches(text, '^def \w'))"""


def symbols_of(spark: SparkSession, d: str) -> DataFrame:
    name = F.regexp_extract("text", r"^def (\w+)", 1)
    s = code_of(spark, d).select(F.col("path").alias("file"), name.alias("name"), F.col("line").alias("start_line"), (F.col("line") + 2 + F.col("path") % 3).alias("end_line"))
    return s.where("name <> ''").withColumn("kind", F.lit("function"))


CODE_CHUNKS = f"""{LINES}, {CODE}, {SYMBOLS},
  om AS (SELECT * FROM (SELECT *, max(end_line) OVER (PARTITION BY file ORDER BY start_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sy) WHERE reach IS NULL OR start_line > reach),
  cc AS (SELECT path AS file, start_line, end_line, name, string_agg(text, chr(10) ORDER BY line) AS content FROM code JOIN om ON file = path AND line BETWEEN start_line AND end_line GROUP BY ALL
    UNION ALL SELECT path, 1, max(line), NULL, string_agg(text, chr(10) ORDER BY line) FROM code WHERE path NOT IN (SELECT file FROM om) GROUP BY path)"""


@reg.add(f"WITH {CODE_CHUNKS} SELECT file, start_line, end_line, name, md5(content) AS digest FROM cc")
def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    return K.code_chunks(code_of(spark, d), symbols_of(spark, d)).select("file", "start_line", "end_line", "name", F.md5("content").alias("digest"))


@reg.add()
def normalized_code_chunks(spark: SparkSession, d: str) -> DataFrame:
    n = K.normalize_code_chunks(K.code_chunks(code_of(spark, d), symbols_of(spark, d)))
    return n.select("file", "chunk", "part", "start_line", "end_line", "name", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


@reg.add("SELECT doc_id AS chunk_id, length(text) AS char_count, lang || '/' || source AS title, text[1:200] || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS preview FROM documents")
def chunk_report(spark: SparkSession, d: str) -> DataFrame:
    preview = F.concat(F.left("text", F.lit(200)), F.when(F.length("text") > 200, "...").otherwise(""))
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.length("text").alias("char_count"), F.concat("lang", F.lit("/"), "source").alias("title"), preview.alias("preview"))
