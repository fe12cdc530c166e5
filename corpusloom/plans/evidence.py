"""Evidence queries. Pieces: the documents, in sessions of their id modulo 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evidence as E
from .common import Registry, table

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

SOURCES = ("rag_search", "find_definition", "find_callers", "grep_search", "file_read", "code_graph", "web_search")
PIECES = """pc AS (SELECT doc_id % 50 AS session, doc_id AS seq, ['rag_search', 'find_definition', 'find_callers', 'grep_search', 'file_read', 'code_graph', 'web_search'][doc_id % 7 + 1] AS source,
  CASE WHEN doc_id % 5 > 0 THEN source || '/' || (doc_id % 9) || '.py' END AS file_path, text AS content, (n_chars % 101) / 100.0 AS relevance,
  [lang || ':' || source || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.md' END] AS files FROM documents)"""
TYPED = f"""{PIECES}, ad AS (SELECT *, CASE WHEN source = 'find_definition' OR source = 'file_read' THEN 'definition' WHEN source = 'find_callers' OR source = 'code_graph' THEN 'direct_call' WHEN source = 'grep_search' THEN 'lexical_match'
    WHEN source = 'rag_search' AND ends_with(files[1], '.py') THEN 'lexical_match' ELSE 'semantic_match' END AS evidence_type,
  CASE WHEN relevance > 0.8 THEN 'confirmed' WHEN relevance > 0.5 THEN 'likely' ELSE 'unknown' END AS confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY session, source, coalesce(file_path, ''), content[1:200] ORDER BY seq) AS n FROM pc WHERE relevance > 0.3) WHERE n = 1)"""


def pieces_of(spark: SparkSession, d: str) -> DataFrame:
    i, s = F.col("doc_id"), lambda c: c.cast("string")
    return table(spark, d, "documents").select(
        (i % 50).alias("session"), i.alias("seq"), F.get(F.array(*[F.lit(x) for x in SOURCES]), (i % 7).cast("int")).alias("source"),
        F.when(i % 5 > 0, F.concat("source", F.lit("/"), s(i % 9), F.lit(".py"))).alias("file_path"), F.col("text").alias("content"), ((F.col("n_chars") % 101) / 100.0).alias("relevance"),
        F.array(F.concat("lang", F.lit(":"), "source", F.lit("/"), s(i), F.when(i % 2 == 0, ".py").otherwise(".md"))).alias("files"),
    )


@reg.add(f"WITH {TYPED} SELECT session, seq, source, file_path, evidence_type, confidence FROM ad")
def evidence_cards(spark: SparkSession, d: str) -> DataFrame:
    return E.admit(pieces_of(spark, d)).select("session", "seq", "source", "file_path", "evidence_type", "confidence")


@reg.add(f"""WITH {TYPED}, w AS (SELECT *, round(CASE evidence_type WHEN 'definition' THEN 1.0 WHEN 'direct_call' THEN 0.9 WHEN 'lexical_match' THEN 0.72 ELSE 0.6 END * CASE confidence WHEN 'confirmed' THEN 1.0 WHEN 'likely' THEN 0.7 ELSE 0.4 END, 6) AS score FROM ad)
SELECT session, seq, CAST(score AS DOUBLE) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, seq) AS place FROM w) WHERE place <= 30""")
def evidence_rerank(spark: SparkSession, d: str) -> DataFrame:
    return E.rerank(E.admit(pieces_of(spark, d))).select("session", "seq", "score", "place")


@reg.add(f"""WITH {PIECES}, e AS (SELECT session, seq, relevance, '[source: ' || source || ']' || coalesce(' [file: ' || file_path || ']', '') || chr(10) || content AS entry FROM pc),
  u AS (SELECT *, sum(length(entry)) OVER (PARTITION BY session ORDER BY relevance DESC, seq ROWS UNBOUNDED PRECEDING) AS used FROM e)
SELECT session, md5(string_agg(entry, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY relevance DESC, seq)) AS digest FROM u WHERE used <= 8000 GROUP BY session""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return E.summary(pieces_of(spark, d)).select("session", F.md5("summary").alias("digest"))


INTENTS = ("location", "mechanism", "concept", "usage", "call_chain", "architecture", "topic_coverage", "debugging", "repo_overview", "implementation")
_LIST = "[" + ", ".join(f"'{x}'" for x in INTENTS) + "]"
FACTS = f"""{TYPED}, fc AS (SELECT session, {_LIST}[session % 10 + 1] AS intent, session % 7 AS rounds, count(*) FILTER (evidence_type = 'definition' AND confidence = 'confirmed' AND session % 3 > 0) AS n_definitions,
  count(*) FILTER (confidence = 'confirmed' AND session % 3 > 0) AS n_anchors, count(*) AS n_evidence, count(*) + session % 2 AS n_context, count(*) FILTER (evidence_type = 'semantic_match') AS n_semantic,
  count(*) FILTER (evidence_type IN ('definition', 'direct_call') AND session % 4 > 0) AS n_structural, bool_or(evidence_type = 'definition' AND session % 4 > 0) AS has_definition, bool_or(evidence_type = 'direct_call' AND session % 4 > 0) AS has_call,
  bool_or(evidence_type = 'lexical_match') AS has_lexical, bool_or(evidence_type = 'semantic_match') AS has_semantic, avg(relevance) AS confidence, session % 5 = 0 AS closed_path, session % 11 = 0 AS conflicts, session % 6 > 0 AS verified FROM ad GROUP BY session)"""


def facts_of(spark: SparkSession, d: str) -> DataFrame:
    e, c, s = E.admit(pieces_of(spark, d)), F.col, F.col("session")
    kind = lambda *k: c("evidence_type").isin(*k)
    sure = (c("confidence") == "confirmed") & (s % 3 > 0)
    return e.groupBy("session").agg(
        F.count_if(kind("definition") & sure).alias("n_definitions"), F.count_if(sure).alias("n_anchors"), F.count("*").alias("n_evidence"), F.count_if(kind("semantic_match")).alias("n_semantic"),
        F.count_if(kind("definition", "direct_call") & (s % 4 > 0)).alias("n_structural"), F.bool_or(kind("definition") & (s % 4 > 0)).alias("has_definition"), F.bool_or(kind("direct_call") & (s % 4 > 0)).alias("has_call"),
        F.bool_or(kind("lexical_match")).alias("has_lexical"), F.bool_or(kind("semantic_match")).alias("has_semantic"), F.avg("relevance").alias("confidence"),
    ).withColumns({
        "intent": F.get(F.array(*[F.lit(x) for x in INTENTS]), (s % 10).cast("int")), "rounds": s % 7, "n_context": c("n_evidence") + s % 2, "closed_path": s % 5 == 0, "conflicts": s % 11 == 0, "verified": s % 6 > 0,
    })


@reg.add(f"""WITH {FACTS}, g AS (SELECT *, intent IN ('concept', 'architecture', 'usage', 'topic_coverage', 'repo_overview') AS soft, intent IN ('topic_coverage', 'repo_overview') AS doc, n_definitions > 0 AS an,
    has_definition OR has_call OR (has_lexical AND n_definitions > 0) AS st FROM fc),
  h AS (SELECT *, NOT an AND NOT doc AND NOT soft AND rounds < 2 AS noan, intent IN ('call_chain', 'mechanism') AND n_anchors < 2 AND rounds < 2 AS chain,
    least(CASE WHEN an THEN 1.0 WHEN doc THEN 0.85 WHEN soft THEN 0.8 ELSE 0.7 END, CASE WHEN st THEN 1.0 WHEN (soft OR doc) AND has_semantic THEN 0.78 ELSE 0.6 END) AS lim FROM g)
SELECT session, NOT noan AND NOT chain AS passed, CAST(CASE WHEN n_context >= 3 THEN greatest(lim, 0.6) ELSE lim END AS DOUBLE) AS max_confidence,
  array_to_string(list_filter([CASE WHEN noan THEN 'No definition anchor found' END, CASE WHEN NOT st AND NOT ((soft OR doc) AND has_semantic) THEN 'Missing structural evidence' END, CASE WHEN chain THEN 'Call chain requires multiple anchors' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM h""")
def hard_gate(spark: SparkSession, d: str) -> DataFrame:
    return E.hard_gate(facts_of(spark, d)).select("session", "passed", "max_confidence", "reasons")


@reg.add(f"""WITH {FACTS}, g AS (SELECT *, intent IN ('concept', 'architecture', 'usage', 'topic_coverage', 'repo_overview') AS soft, intent IN ('topic_coverage', 'repo_overview') AS doc, intent IN ('concept', 'usage', 'topic_coverage', 'repo_overview') AS light,
  intent IN ('mechanism', 'call_chain', 'debugging') AS deep, n_definitions > 0 AS pri FROM fc)
SELECT session, CASE WHEN rounds >= 3 AND n_evidence >= 3 AND (pri OR soft) AND (NOT deep OR verified) THEN true WHEN light AND rounds >= 1 AND n_evidence >= 1 THEN true
  WHEN doc AND (n_semantic >= 2 OR (rounds >= 1 AND n_context >= 2)) THEN true WHEN intent = 'location' AND pri AND n_evidence >= 1 THEN true WHEN intent IN ('concept', 'usage') AND n_evidence >= 2 THEN true
  WHEN intent IN ('call_chain', 'architecture') AND NOT closed_path AND rounds < 3 THEN false WHEN intent IN ('call_chain', 'architecture') AND n_anchors < 2 AND rounds < 2 THEN false
  WHEN NOT pri AND NOT soft AND n_context < 3 AND rounds < 2 THEN false WHEN conflicts AND rounds < 3 THEN false WHEN NOT soft AND n_structural = 0 AND rounds < 2 THEN false
  WHEN confidence < CASE WHEN doc OR soft THEN CASE WHEN rounds >= 1 THEN 0.4 ELSE 0.5 END ELSE CASE WHEN rounds >= 2 THEN 0.5 ELSE 0.6 END END AND rounds < 3 THEN false
  WHEN rounds >= 2 AND n_evidence >= 2 THEN CASE WHEN deep THEN verified OR rounds >= 6 ELSE true END WHEN light AND rounds >= 1 THEN true ELSE false END AS stop FROM g""")
def stop_condition(spark: SparkSession, d: str) -> DataFrame:
    f = facts_of(spark, d)
    return f.select("session", E.should_stop(f).alias("stop"))


@reg.add("""SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 0.0 WHEN value > 20 THEN CASE event_id % 6 WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 WHEN 2 THEN 0.9 WHEN 3 THEN 0.85 WHEN 4 THEN 0.8 ELSE 0.75 END ELSE 0.12 END AS DOUBLE) AS relevance FROM events""")
def graph_relevance(spark: SparkSession, d: str) -> DataFrame:
    ops = ("find_definition", "find_callers", "find_callees", "get_class_hierarchy", "find_imports", "other")
    op = F.get(F.array(*[F.lit(x) for x in ops]), (F.col("event_id") % 6).cast("int"))
    hits = F.when(F.col("value") > 20, 3).otherwise(0)
    return table(spark, d, "events").select("event_id", F.round(E.graph_relevance(op, hits, F.col("event_type") == "error"), 6).alias("relevance"))


@reg.add("""SELECT session, entity, n FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY last DESC, entity) AS n FROM (
  SELECT session, entity, max(seen) AS last FROM (SELECT conv_id % 10 AS session, conv_id * 1000 + turn AS seen, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS entity FROM conversations) GROUP BY ALL)) WHERE n <= 20""")
def carried_entities(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "conversations").select((F.col("conv_id") % 10).alias("session"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("entity"))
    last = words.groupBy("session", "entity").agg(F.max("at").alias("last"))
    return last.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("last"), "entity"))).where("n <= 20").select("session", "entity", "n")


@reg.add(f"""WITH {PIECES}, k AS (SELECT session, source || '::' || coalesce(file_path, '') AS plan, max(seq) AS seq FROM pc GROUP BY ALL)
SELECT session, plan, seq FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS n FROM k) WHERE n <= 3""")
def tool_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = F.concat_ws("::", "source", F.coalesce("file_path", F.lit("")))
    k = pieces_of(spark, d).groupBy("session", plan.alias("plan")).agg(F.max("seq").alias("seq"))
    return k.withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy("seq"))).where("n <= 3").select("session", "plan", "seq")


@reg.add(f"""WITH {PIECES} SELECT session, category, min(seq) AS first_seen FROM (SELECT session, files[1] AS category, seq FROM pc WHERE source <> 'web_search') GROUP BY ALL""")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    p = pieces_of(spark, d).where("source <> 'web_search'").select("session", F.get("files", F.lit(0)).alias("category"), "seq")
    return p.groupBy("session", "category").agg(F.min("seq").alias("first_seen"))
