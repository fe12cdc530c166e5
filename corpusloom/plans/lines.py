"""Line search over the documents, one file each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines as L
from .common import Registry, table

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

LINES = "l AS (SELECT doc_id AS path, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"


def files_of(spark: SparkSession, d: str) -> DataFrame:
    return L.file_lines(table(spark, d, "documents"), "doc_id")


def lines_of(spark: SparkSession, d: str) -> DataFrame:
    return L.line_table(table(spark, d, "documents"), "doc_id")


@reg.add(f"""
WITH {LINES}, c AS (SELECT *, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(text, chr(10)) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM l)
SELECT path, line, text, before, after FROM c WHERE contains(lower(text), 'license')
""")
def grep_literal(spark: SparkSession, d: str) -> DataFrame:
    return L.grep(files_of(spark, d), lambda t: L.line_test(t, "License"))


@reg.add(rf"WITH {LINES} SELECT path, line, text FROM l WHERE regexp_matches(text, '(?i)tion[a-z]* the (he|of)')")
def grep_regex(spark: SparkSession, d: str) -> DataFrame:
    return lines_of(spark, d).where(L.line_test(F.col("text"), "tion[a-z]* the (he|of)", regex=True))


@reg.add(f"""
WITH {LINES} SELECT n AS n_matches, f AS n_files, n > 50 AS truncated, round(least(0.72 + 0.005 * n, 0.94), 6) AS relevance
FROM (SELECT count(*) AS n, count(DISTINCT path) AS f FROM l WHERE contains(lower(text), 'license'))
""")
def grep_summary(spark: SparkSession, d: str) -> DataFrame:
    hit = lines_of(spark, d).where(L.line_test(F.col("text"), "license"))
    s = hit.agg(F.count("*").alias("n_matches"), F.count_distinct("path").alias("n_files"))
    return s.withColumns({"truncated": F.col("n_matches") > 50, "relevance": F.round(F.least(0.72 + 0.005 * F.col("n_matches"), F.lit(0.94)), 6)})


@reg.add(rf"""
WITH {LINES} SELECT path, line, last_value(CASE WHEN length(text) > 200 THEN regexp_extract(text, '^\w+') END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM l
""")
def enclosing_scope(spark: SparkSession, d: str) -> DataFrame:
    return L.enclosing(files_of(spark, d), lambda t: F.when(F.length(t) > 200, F.regexp_extract(t, r"^\w+", 0))).select("path", "line", "scope")


CODE = r"""code AS (SELECT path, line, CASE (path + line) % 6 WHEN 0 THEN 'def ' || w || '(self):' WHEN 1 THEN 'export class ' || w || ' {' WHEN 2 THEN 'const ' || w || ' = 1' WHEN 3 THEN 'type ' || w || ' = x' WHEN 4 THEN '  return ' || w || '(1)' ELSE text END AS text
  FROM (SELECT *, regexp_extract(text, '[A-Za-z]+') AS w FROM l))"""


def code_of(spark: SparkSession, d: str) -> DataFrame:
    """The documents' lines dressed as code."""
    return lines_of(spark, d).select("path", "line", dressed(F.col("text"), F.col("path"), F.col("line")).alias("text"))


def code_files_of(spark: SparkSession, d: str) -> DataFrame:
    return files_of(spark, d).select("path", F.transform("lines", lambda t, i: dressed(t, F.col("path"), i + 1)).alias("lines"))


def dressed(text: Column, path: Column, line: Column) -> Column:
    w, k = F.regexp_extract(text, "[A-Za-z]+", 0), (path + line) % 6
    dress = lambda a, z: F.concat(F.lit(a), w, F.lit(z))
    return F.when(k == 0, dress("def ", "(self):")).when(k == 1, dress("export class ", " {")).when(k == 2, dress("const ", " = 1")).when(k == 3, dress("type ", " = x")).when(k == 4, dress("  return ", "(1)")).otherwise(text)


@reg.add(rf"""
WITH {LINES}, {CODE}, t AS (SELECT path, line, trim(text) AS t FROM code)
SELECT path, line, symbol FROM (SELECT path, line, CASE
  WHEN regexp_matches(t, '^def\s+\w') THEN 'function:' || regexp_extract(t, '^def\s+(\w+)', 1)
  WHEN regexp_matches(t, '^(?:export\s+)?class\s+\w') THEN 'class:' || regexp_extract(t, '^(?:export\s+)?class\s+(\w+)', 1)
  WHEN regexp_matches(t, '^(?:export\s+)?(?:const|function|let|var)\s+\w') THEN 'function:' || regexp_extract(t, '^(?:export\s+)?(?:const|function|let|var)\s+(\w+)', 1)
  WHEN regexp_matches(t, '^(?:export\s+)?(?:interface|type)\s+\w') THEN 'type:' || regexp_extract(t, '^(?:export\s+)?(?:interface|type)\s+(\w+)', 1) END AS symbol FROM t) WHERE symbol IS NOT NULL
""")
def symbols_in_lines(spark: SparkSession, d: str) -> DataFrame:
    return code_of(spark, d).select("path", "line", L.line_symbols(F.col("text")).alias("symbol")).where("symbol is not null")


ASKED = "asked AS (SELECT DISTINCT regexp_extract(text, '[A-Za-z]+') AS symbol FROM benchmark WHERE regexp_matches(text, '[A-Za-z]'))"


def asked_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "benchmark").select(F.regexp_extract("text", "[A-Za-z]+", 0).alias("symbol")).where("symbol <> ''").distinct()
    return s.withColumn("hint", F.lit(None).cast("long"))


@reg.add(rf"""
WITH {LINES}, {CODE}, {ASKED}, w AS (SELECT path, line, text, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS symbol FROM code),
  h AS (SELECT * FROM w JOIN asked USING (symbol) WHERE contains(text, 'def ' || symbol || '(') OR contains(text, 'class ' || symbol || ' ') OR contains(text, 'const ' || symbol || ' ='))
SELECT symbol, path, line FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY path, line) AS n FROM h) WHERE n = 1
""")
def symbol_definitions(spark: SparkSession, d: str) -> DataFrame:
    return L.definitions(code_of(spark, d), asked_symbols(spark, d))


@reg.add(rf"WITH {LINES}, {CODE}, {ASKED} SELECT symbol, path, line FROM (SELECT path, line, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS symbol FROM code) JOIN asked USING (symbol)")
def symbol_references(spark: SparkSession, d: str) -> DataFrame:
    return L.references(code_of(spark, d), asked_symbols(spark, d))


@reg.add(rf"""
WITH {LINES}, {CODE}, h AS (SELECT path, line, regexp_extract(text, '^def (\w+)', 1) AS symbol, array_to_string(list(text) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), chr(10)) AS shown FROM code)
SELECT path, line, symbol, shown FROM h WHERE symbol <> ''
""")
def hover_text(spark: SparkSession, d: str) -> DataFrame:
    return L.shown_from(code_files_of(spark, d), lambda t: F.regexp_extract(t, r"^def (\w+)", 1))


@reg.add(f"WITH {LINES} SELECT least(n, 51) AS n_shown, n > 50 AS truncated FROM (SELECT count(*) AS n FROM l WHERE contains(lower(text), 'license'))")
def grep_early(spark: SparkSession, d: str) -> DataFrame:
    """Whether a word stands in more than 50 lines, without counting them all."""
    more, hits = L.match_summary(files_of(spark, d), lambda t: L.line_test(t, "license"), 50)
    return hits.agg(F.count("*").alias("n_shown"), more.alias("truncated"))


@reg.add(f"WITH {LINES} SELECT path, string_agg(lpad(CAST(line AS VARCHAR), 4, ' ') || ' | ' || text, chr(10) ORDER BY line) AS numbered FROM l WHERE line BETWEEN 2 AND 4 GROUP BY path")
def read_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.read_window(lines_of(spark, d), F.lit(2), F.lit(4))
