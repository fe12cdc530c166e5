"""Scalar functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .common import Registry, table

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles


@reg.add(r"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_\x{4e00}-\x{9fff}]+') AS t FROM documents)
""")
def fn_tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


@reg.add(r"""
SELECT doc_id, coalesce(nullif(source, ''), nullif(lang, ''), 'unknown') || '|' || coalesce(CAST(nullif(doc_id % 3, 0) AS VARCHAR), CAST(nullif(n_chars, 0) AS VARCHAR), '') || '|' || substring(md5(text), 1, 12) AS doc_key FROM documents
""")
def fn_doc_key(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    anchor = lambda c: F.when(c != 0, c.cast("string"))
    return docs.select("doc_id", X.doc_key(F.col("source"), F.col("lang"), [anchor(F.col("doc_id") % 3), anchor(F.col("n_chars"))], F.col("text")).alias("doc_key"))


@reg.add("SELECT item_id, greatest(6, least(30, (item_id % 9) * 6)) AS k_dense, greatest(6, least(30, (item_id % 9) * 4)) AS k_sparse FROM benchmark")
def fn_plan_k(spark: SparkSession, d: str) -> DataFrame:
    base = F.col("item_id") % 9
    return table(spark, d, "benchmark").select("item_id", X.plan_k(base, 6).alias("k_dense"), X.plan_k(base, 4).alias("k_sparse"))


_URLS = """u AS (
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN upper(url) || '.git/' WHEN 2 THEN 'git@GitHub.com:Own' || (page_id % 7) || '/Repo' || (page_id % 5) || '.git'
    WHEN 3 THEN ' https://GitHub.com/Own' || (page_id % 7) || '/Repo' || (page_id % 5) || '/tree/main ' WHEN 4 THEN 'Plain' || page_id || '.git' ELSE 'http://Host' || page_id || '/' END AS url
  FROM pages)"""


def varied_urls(spark: SparkSession, d: str) -> DataFrame:
    """page_id and url in several spellings."""
    p, s = F.col("page_id"), lambda c: c.cast("string")
    own = lambda a, b: F.concat(F.lit(a), s(p % 7), F.lit("/Repo"), s(p % 5), F.lit(b))
    url = (
        F.when(p % 6 == 0, F.col("url")).when(p % 6 == 1, F.concat(F.upper("url"), F.lit(".git/"))).when(p % 6 == 2, own("git@GitHub.com:Own", ".git"))
        .when(p % 6 == 3, own(" https://GitHub.com/Own", "/tree/main ")).when(p % 6 == 4, F.concat(F.lit("Plain"), s(p), F.lit(".git"))).otherwise(F.concat(F.lit("http://Host"), s(p), F.lit("/")))
    )
    return table(spark, d, "pages").select("page_id", url.alias("url"))


NORMAL_URL = r"""CASE
    WHEN starts_with(r, 'git@') AND regexp_matches(r, '^git@[^:]+:[^/]+/[^/]+') THEN 'https://' || lower(regexp_extract(r, '^git@([^:]*):', 1)) || '/' || lower(regexp_replace(regexp_extract(r, '^git@[^:]*:([^/]+/[^/]+)', 1), '\.git$', ''))
    WHEN regexp_matches(r, '^[A-Za-z]+://[^/]+/+[^/]+/+[^/]+') THEN lower(regexp_extract(r, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(r, '^[A-Za-z]+://([^/]+)', 1)) || '/' || lower(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_extract(r, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', ''), '\.git$', ''), '/'), lambda x: x <> '')[1:2], '/'))
    WHEN regexp_matches(r, '^[A-Za-z]+://[^/]') THEN regexp_replace(lower(regexp_extract(r, '^([A-Za-z]+://[^/?#]+)', 1)) || regexp_replace(regexp_replace(regexp_extract(r, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', ''), '\.git$', ''), '/+$', '')
    ELSE lower(regexp_replace(regexp_replace(r, '/+$', ''), '\.git$', '')) END"""


@reg.add(rf"""
WITH {_URLS}, n AS (SELECT page_id, url, {NORMAL_URL.replace('(r,', '(trim(url),')} AS normal FROM u)
SELECT page_id, normal, regexp_extract(normal, '^[a-z]+://[^/]*/([^/]+/[^/?#]+)', 1) AS repo_key,
  list_extract(string_split(replace(regexp_replace(url, '/+$', ''), '.git', ''), '/'), -1) AS repo_name,
  list_extract(string_split(lower(replace(regexp_replace(url, '/+$', ''), '.git', '')), '/'), -1) || '_' || substring(md5(lower(replace(regexp_replace(url, '/+$', ''), '.git', ''))), 1, 8) AS repo_hash
FROM n
""")
def fn_repo_urls(spark: SparkSession, d: str) -> DataFrame:
    u = varied_urls(spark, d).withColumn("normal", X.normalize_repo_url(F.col("url")))
    return u.select("page_id", "normal", X.repo_key(F.col("normal")).alias("repo_key"), X.repo_name(F.col("url")).alias("repo_name"), X.repo_hash(F.col("url")).alias("repo_hash"))


@reg.add(r"""
WITH b AS (SELECT doc_id, trim(substring(text, 1, 24)) AS name FROM documents), s AS (
  SELECT doc_id, regexp_replace(regexp_replace(lower(name), '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS f,
    regexp_replace(regexp_replace(translate(lower(name), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS c FROM b
), t AS (SELECT doc_id, CASE f WHEN '' THEN 'section' ELSE f END AS base, CASE c WHEN '' THEN 'section' ELSE c END AS form FROM s)
SELECT doc_id, form, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS file_name FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY doc_id) AS n FROM t)
""")
def fn_collision_free_names(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sections import collision_free_names

    docs = table(spark, d, "documents").select("doc_id", F.trim(F.substring("text", 1, 24)).alias("name"))
    return collision_free_names(docs, "name", "doc_id").select("doc_id", "form", "file_name")


@reg.add(r"""
WITH q AS (
  SELECT conv_id, turn, trim(CASE turn % 3 WHEN 0 THEN 'Question: ' || text WHEN 1 THEN '  User question: ' || text || '?' ELSE text END, E' \t\r\n') AS q FROM conversations
), p AS (SELECT conv_id, turn, trim(regexp_replace(q, '^(\[Current page context:|User question:|Question:)', ''), E' \t\r\n') AS q FROM q
), c AS (SELECT conv_id, turn, trim(CASE WHEN contains(q, '？') THEN split_part(q, '？', 1) WHEN contains(q, '?') THEN split_part(q, '?', 1) WHEN contains(q, '。') THEN split_part(q, '。', 1)
    WHEN contains(q, chr(10)) THEN split_part(q, chr(10), 1) WHEN contains(q, '，') THEN split_part(q, '，', 1) WHEN contains(q, ',') THEN split_part(q, ',', 1) ELSE q END, E' \t\r\n') AS q FROM p)
SELECT conv_id, turn, CASE WHEN q = '' THEN 'New chat' WHEN length(q) <= 40 THEN q
  ELSE trim(CASE WHEN contains(q[1:40], ' ') AND 40 - instr(reverse(q[1:40]), ' ') > 20 THEN q[1:40 - instr(reverse(q[1:40]), ' ')] ELSE q[1:40] END) || '...' END AS title FROM c
""")
def fn_chat_title(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    q = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Question: "), t)).when(F.col("turn") % 3 == 1, F.concat(F.lit("  User question: "), t, F.lit("?"))).otherwise(t)
    return table(spark, d, "conversations").select("conv_id", "turn", X.chat_title(q).alias("title"))


@reg.add(r"""
WITH c AS (SELECT doc_id, lang || ':' || source || '/' || doc_id || '.py' || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ':' || (doc_id % 90 + 1) WHEN 2 THEN ':' || (doc_id % 90 + 1) || '-' || (doc_id % 90 + 9) ELSE ':Thing' || doc_id END AS cited FROM documents)
SELECT doc_id, split_part(cited, ':', 1) AS category, split_part(cited, ':', 2) AS path, CASE WHEN doc_id % 4 = 3 THEN split_part(cited, ':', 3) END AS symbol,
  TRY_CAST(regexp_extract(split_part(cited, ':', 3), '^([0-9]+)', 1) AS INTEGER) AS line_start, TRY_CAST(regexp_extract(split_part(cited, ':', 3), '([0-9]+)$', 1) AS INTEGER) * CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 1 END AS line_end,
  split_part(cited, ':', 2) || CASE WHEN doc_id % 4 IN (1, 2) THEN ':' || split_part(cited, ':', 3) ELSE '' END AS citation FROM c
""")
def fn_citations(spark: SparkSession, d: str) -> DataFrame:
    i, s = F.col("doc_id"), lambda c: c.cast("string")
    tail = F.when(i % 4 == 0, "").when(i % 4 == 1, F.concat(F.lit(":"), s(i % 90 + 1))).when(i % 4 == 2, F.concat(F.lit(":"), s(i % 90 + 1), F.lit("-"), s(i % 90 + 9))).otherwise(F.concat(F.lit(":Thing"), s(i)))
    cited = F.concat("lang", F.lit(":"), "source", F.lit("/"), s(i), F.lit(".py"), tail)
    c = table(spark, d, "documents").select("doc_id", X.parse_citation(cited).alias("c"))
    return c.select("doc_id", "c.category", "c.path", "c.symbol", F.col("c.start").alias("line_start"), F.col("c.end").alias("line_end"), X.citation(F.col("c.path"), F.col("c.start"), F.col("c.end")).alias("citation"))


_ASK = """q AS (SELECT conv_id, turn, CASE conv_id % 10 WHEN 0 THEN 'Hello!' WHEN 1 THEN 'Where is ' || text WHEN 2 THEN 'What is the architecture? ' || text WHEN 3 THEN 'What is ' || text[1:40] WHEN 4 THEN 'How to use ' || text
    WHEN 5 THEN 'Which sections name ' || text WHEN 6 THEN text || ' as you mentioned' WHEN 7 THEN 'Overview of ' || text WHEN 8 THEN 'show me ' || text ELSE text END AS q FROM conversations)"""
ASK_FORMS = ("Hello!", "Where is ", "What is the architecture? ", "What is ", "How to use ", "Which sections name ", "", "Overview of ", "show me ", "")


def varied_questions(spark: SparkSession, d: str) -> DataFrame:
    c, t = F.col("conv_id") % 10, F.col("text")
    q = t
    for k, head in enumerate(ASK_FORMS):
        body = {0: F.lit(""), 3: F.substring(t, 1, 40), 6: F.concat(t, F.lit(" as you mentioned"))}.get(k, t)
        q = F.when(c == k, F.concat(F.lit(head), body)).otherwise(q)
    return table(spark, d, "conversations").select("conv_id", "turn", q.alias("q"))


@reg.add(rf"""
WITH {_ASK}, i AS (SELECT *, CASE conv_id % 10 WHEN 0 THEN 'general' WHEN 1 THEN 'location' WHEN 2 THEN 'architecture' WHEN 3 THEN 'concept' WHEN 4 THEN 'usage' WHEN 5 THEN 'topic_coverage' WHEN 6 THEN 'followup_clarification' WHEN 7 THEN 'repo_overview' END AS intent FROM q)
SELECT conv_id, turn, intent, CASE WHEN turn % 5 = 4 THEN 'direct' WHEN intent IN ('concept', 'usage', 'topic_coverage', 'followup_clarification', 'repo_overview') THEN 'light' WHEN intent = 'location' THEN 'deep' ELSE 'light' END AS path,
  len(list_filter(regexp_split_to_array(lower(trim(q)), '[ \t\r\n]+'), lambda w: length(w) > 2)) >= 3 AND NOT regexp_matches(lower(trim(q)), '^(what is|where is|how to|list all|show me)') AS wants_expansion
FROM i
""")
def fn_intent_routing(spark: SparkSession, d: str) -> DataFrame:
    q = varied_questions(spark, d).withColumn("intent", X.lexical_intent(F.col("q")))
    return q.select("conv_id", "turn", "intent", X.answer_path(F.col("intent"), F.col("turn") % 5 == 4).alias("path"), X.wants_expansion(F.col("q")).alias("wants_expansion"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@reg.add(rf"""
WITH w AS (SELECT item_id, list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]{{2,}}'), lambda w: lower(w) NOT IN ({_STOP})) AS w FROM benchmark),
  f AS (SELECT item_id, list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i)[1:4] AS f FROM w)
SELECT item_id, CASE WHEN len(f) >= 2 THEN array_to_string(f, '|') ELSE '' END AS pattern FROM f
""")
def fn_keyword_pattern(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", X.keyword_pattern(F.col("text")).alias("pattern"))


@reg.add(r"""
WITH m AS (SELECT item_id, string_split(text, '. ') AS m, regexp_extract(text, '[A-Za-z]+') AS k, text AS q FROM benchmark),
  r AS (SELECT *, list_filter(m, lambda x: contains(lower(x), lower(k))) AS h FROM m)
SELECT item_id, CASE WHEN len(h) > 0 THEN list_filter(h, lambda x: length(x) = list_max(list_transform(h, lambda y: length(y))))[1] ELSE q END[1:250] AS query FROM r
""")
def fn_contextual_query(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", X.contextual_query(F.regexp_extract(t, "[A-Za-z]+", 0), F.split(t, r"\. "), t).alias("query"))


@reg.add(r"""
SELECT item_id, CASE item_id % 4 WHEN 0 THEN text || ' latest stable version' WHEN 1 THEN text || ' CVE security vulnerability' WHEN 2 THEN CASE WHEN contains(lower(text), 'docs') OR contains(lower(text), 'documentation') THEN text ELSE text || ' documentation API reference' END ELSE text END AS query FROM benchmark
""")
def fn_enhance_query(spark: SparkSession, d: str) -> DataFrame:
    kind = F.get(F.array(*[F.lit(x) for x in ("version", "cve", "code_docs", "general")]), (F.col("item_id") % 4).cast("int"))
    return table(spark, d, "benchmark").select("item_id", X.enhance_query(F.col("text"), kind).alias("query"))


@reg.add(r"""
SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'unknown' ELSE source || '/' || doc_id || '.py' END AS path, CASE doc_id % 5 WHEN 4 THEN NULL ELSE n_chars END AS line FROM documents
""")
def fn_path_and_line_in_text(spark: SparkSession, d: str) -> DataFrame:
    i, s = F.col("doc_id"), lambda c: c.cast("string")
    file = F.concat("source", F.lit("/"), s(i), F.lit(".py"))
    say = F.when(i % 5 == 0, F.concat(F.lit("seen in `"), file, F.lit("` at line "), s(F.col("n_chars")))).when(i % 5 == 4, F.lit("none of them"))
    say = say.when(i % 5 == 1, F.concat(F.lit("File: "), file, F.lit(" Line "), s(F.col("n_chars")))).otherwise(F.concat(F.lit("cf. "), file, F.lit(":"), s(F.col("n_chars"))))
    return table(spark, d, "documents").select("doc_id", X.path_in_text(say).alias("path"), X.line_in_text(say).cast("long").alias("line"))


@reg.add(r"""
SELECT doc_id, CASE WHEN length(text) > 300 THEN text[1:300] || '...' ELSE text END AS short, '[chunk ' || (doc_id % 7) || '] | type: ' || lang || ' | source: ' || source AS header,
  CASE WHEN n_chars % 100 > 80 THEN 'confirmed' WHEN n_chars % 100 > 50 THEN 'likely' ELSE 'unknown' END AS confidence FROM documents
""")
def fn_context_header(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", X.truncate(F.col("text"), 300).alias("short"), X.context_header(F.col("doc_id") % 7, F.col("lang"), F.col("source")).alias("header"),
        X.confidence((F.col("n_chars") % 100) / 100).alias("confidence"),
    )


@reg.add(r"""
SELECT doc_id, array_to_string(string_split(p, '/')[1:2], '/') AS prefix, CASE WHEN source <> 'src' || (doc_id % 20) THEN 1 WHEN doc_id % 2 = 1 THEN 2 ELSE 3 END AS shared
FROM (SELECT *, 'lib/' || source || '/' || lang || '/' || doc_id || '.py' AS p FROM documents)
""")
def fn_path_prefixes(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("doc_id").cast("string")
    path = F.concat(F.lit("lib/"), "source", F.lit("/"), "lang", F.lit("/"), s, F.lit(".py"))
    other = F.concat(F.lit("lib/src"), (F.col("doc_id") % 20).cast("string"), F.lit("/"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("zz"), F.lit("/none.py"))
    return table(spark, d, "documents").select("doc_id", X.prefix_key(path, 2).alias("prefix"), X.common_prefix(path, other).alias("shared"))


@reg.add(r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), s AS (SELECT *, greatest(1, len(l) // 4) AS step FROM l),
  m AS (SELECT *, array_to_string(list_filter(l, lambda x, i: (i - 1) % step = 0), chr(10)) AS m FROM s)
SELECT doc_id, round(CASE WHEN length(text) < 200 THEN CAST(len(regexp_extract_all(lower(text), '[A-Za-z0-9_\x{4e00}-\x{9fff}]+')) AS DOUBLE)
  ELSE CAST(len(regexp_extract_all(lower(m), '[A-Za-z0-9_\x{4e00}-\x{9fff}]+')) * length(text) AS DOUBLE) / greatest(1, length(m)) END, 6) AS tokens FROM m
""")
def fn_sampled_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(X.sampled_tokens(F.col("text"), lines=4), 6).alias("tokens"))


@reg.add(r"""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL ELSE props END AS body, CASE event_id % 4 WHEN 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events
""")
def fn_json_block(spark: SparkSession, d: str) -> DataFrame:
    p, i = F.col("props"), F.col("event_id") % 4
    raw = F.when(i == 0, F.concat(F.lit("{ "), p)).when(i == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i == 2, F.concat(F.lit("So: "), p, F.lit(" done"))).otherwise(p)
    return table(spark, d, "events").select("event_id", X.json_block(raw).alias("body"), F.get_json_object(X.json_block(raw), "$.k").alias("k"))


@reg.add("SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE date_trunc('second', ts) END AS ts, event_id % 3 = 2 OR date_trunc('second', ts) < TIMESTAMP '2024-01-15' - INTERVAL 2 DAY AS stale FROM events")
def fn_times_and_staleness(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.tables import is_stale

    i = F.col("event_id") % 3
    raw = F.when(i == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    t = table(spark, d, "events").select("event_id", X.parse_time(raw).alias("ts"))
    return t.withColumn("stale", is_stale(F.col("ts"), F.lit("2024-01-15").cast("timestamp"), days=2))
