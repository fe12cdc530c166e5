"""The tables around a service: tasks, repositories, chats. Stand-ins: events (tasks), pages (repositories), conversations (chats), customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import tables as T
from .common import Registry, table
from .functions import _URLS, NORMAL_URL, varied_urls

reg = Registry()
QUERIES, ORACLES = reg.queries, reg.oracles

TASKS = """tasks AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS task_id, event_id, user_id, ts, value AS progress,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'cached' ELSE 'failed' END AS status FROM events)"""


def tasks_of(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind == "view", "processing").when(kind == "purchase", "completed").when(kind == "click", "cached").otherwise("failed")
    key = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(key.alias("task_id"), "event_id", "user_id", "ts", F.col("value").alias("progress"), status.alias("status"))


@reg.add(f"WITH {TASKS} SELECT task_id, event_id, status, progress FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS n FROM tasks) WHERE n = 1")
def latest_task_state(spark: SparkSession, d: str) -> DataFrame:
    return T.latest(tasks_of(spark, d), ["task_id"], [F.desc("ts"), F.desc("event_id")]).select("task_id", "event_id", "status", "progress")


@reg.add(f"WITH {TASKS} SELECT event_id, user_id, status FROM tasks WHERE user_id = 7 AND status IN ('completed', 'cached')")
def tasks_of_user(spark: SparkSession, d: str) -> DataFrame:
    return tasks_of(spark, d).where((F.col("user_id") == 7) & F.col("status").isin("completed", "cached")).select("event_id", "user_id", "status")


@reg.add("""
WITH c AS (SELECT c_custkey + 1000 AS c_custkey, c_name, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE c_acctbal + 1 END AS c_acctbal, CASE c_custkey % 5 WHEN 0 THEN NULL ELSE 'NEW' END AS c_mktsegment FROM customer)
SELECT coalesce(n.c_custkey, b.c_custkey) AS c_custkey, coalesce(n.c_name, b.c_name) AS c_name, coalesce(n.c_acctbal, b.c_acctbal) AS c_acctbal, coalesce(n.c_mktsegment, b.c_mktsegment) AS c_mktsegment
FROM customer b FULL JOIN c n ON b.c_custkey = n.c_custkey
""")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    changes = base.select((k + 1000).alias("c_custkey"), "c_name", F.when(k % 3 != 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(k % 5 != 0, F.lit("NEW")).alias("c_mktsegment"))
    return T.upsert(base, changes, "c_custkey")


@reg.add("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'HELD' ELSE c_mktsegment END AS c_mktsegment, c_acctbal < 0 AS updated FROM customer")
def update_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return T.update_where(c, F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("HELD"), "c_acctbal": F.lit(0.0)})


@reg.add("""
WITH doomed AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) >= 6), p AS (SELECT DISTINCT conv_id FROM conversations)
SELECT 'chat' AS kind, count(*) AS n, CAST(sum(conv_id) AS BIGINT) AS ids FROM p WHERE conv_id NOT IN (SELECT conv_id FROM doomed)
UNION ALL SELECT 'message', count(*), CAST(sum(conv_id) AS BIGINT) FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM doomed)
""")
def delete_with_messages(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "conversations").select("conv_id", "turn")
    doomed = messages.groupBy("conv_id").agg(F.max("turn").alias("m")).where("m >= 6")
    chats, left = T.delete_cascade(messages.select("conv_id").distinct(), messages, doomed, "conv_id")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("conv_id").alias("ids"))
    return count(chats, "chat").unionByName(count(left, "message"))


@reg.add("""
WITH c AS (SELECT DISTINCT conv_id, conv_id % 3 AS user_id FROM conversations), a AS (SELECT conv_id, conv_id % 2 AS user_id FROM c WHERE conv_id % 5 = 0 UNION ALL SELECT -conv_id - 1, 0 FROM c WHERE conv_id % 50 = 0),
  own AS (SELECT conv_id FROM a JOIN c USING (conv_id, user_id))
SELECT 'asked' AS kind, count(*) AS n, count(*) FILTER (conv_id IN (SELECT conv_id FROM own)) AS n_deleted FROM a
UNION ALL SELECT 'chat', count(*), count(*) FILTER (conv_id IN (SELECT conv_id FROM own)) FROM c
UNION ALL SELECT 'message', count(*), count(*) FILTER (conv_id IN (SELECT conv_id FROM own)) FROM conversations
""")
def delete_own_chats(spark: SparkSession, d: str) -> DataFrame:
    """Chats deleted on request of their owner alone; requests for other people's chats and for chats that aren't there change nothing."""
    messages = table(spark, d, "conversations").select("conv_id", "turn")
    chats = messages.select("conv_id").distinct().withColumn("user_id", F.col("conv_id") % 3)
    asked = chats.where("conv_id % 5 = 0").select("conv_id", (F.col("conv_id") % 2).alias("user_id"))
    asked = asked.unionByName(chats.where("conv_id % 50 = 0").select((-F.col("conv_id") - 1).alias("conv_id"), F.lit(0).cast("long").alias("user_id")))
    left, kept, told = T.delete_owned(chats, messages, asked, "conv_id", "user_id")
    lost = lambda all_, rest, kind: all_.agg(F.count("*").alias("n")).join(rest.agg(F.count("*").alias("m"))).select(F.lit(kind).alias("kind"), "n", (F.col("n") - F.col("m")).alias("n_deleted"))
    said = told.agg(F.lit("asked").alias("kind"), F.count("*").alias("n"), F.count_if("deleted").alias("n_deleted"))
    return said.unionByName(lost(chats, left, "chat")).unionByName(lost(messages, kept, "message"))


@reg.add("""
SELECT CAST(event_id AS VARCHAR) AS task_id, user_id, 'pending' AS status, 0.0 AS progress, event_type AS current_step FROM events WHERE event_type = 'signup'
UNION ALL SELECT CAST(event_id AS VARCHAR), user_id, 'processing', value, event_type FROM events WHERE event_type = 'view'
""")
def insert_with_defaults(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    old = e.where("event_type = 'view'").select(F.col("event_id").cast("string").alias("task_id"), "user_id", F.lit("processing").alias("status"), F.col("value").alias("progress"), F.col("event_type").alias("current_step"))
    new = e.where("event_type = 'signup'").select(F.col("event_id").cast("string").alias("task_id"), "user_id", F.col("event_type").alias("current_step"))
    return old.unionByName(new, allowMissingColumns=True).withColumns({"status": F.coalesce("status", F.lit("pending")), "progress": F.coalesce("progress", F.lit(0.0))})


NORMAL = NORMAL_URL.replace("(r,", "(trim(url),")
REPOS = f"""{_URLS}, n AS (SELECT page_id, {NORMAL} AS repo_url FROM u), repos AS (
  SELECT repo_url, min(page_id) AS first_page, count(*) AS n_pages, max(page_id) % 3 <> 0 AS complete FROM n GROUP BY repo_url)"""


def repositories_of(spark: SparkSession, d: str) -> DataFrame:
    n = varied_urls(spark, d).select("page_id", X.normalize_repo_url(F.col("url")).alias("repo_url"))
    return n.groupBy("repo_url").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n_pages"), (F.max("page_id") % 3 != 0).alias("complete"))


@reg.add(f"WITH {REPOS} SELECT repo_url, first_page, n_pages FROM repos")
def distinct_repositories(spark: SparkSession, d: str) -> DataFrame:
    return repositories_of(spark, d).select("repo_url", "first_page", "n_pages")


@reg.add(f"""
WITH {TASKS}, {REPOS}, t AS (SELECT user_id, event_id, ts, 'https://github.com/own' || (event_id % 7) || '/repo' || (event_id % 5) AS repo_url FROM tasks WHERE status IN ('completed', 'cached')),
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, repo_url ORDER BY ts DESC, event_id DESC) AS n FROM t) WHERE n = 1)
SELECT user_id, event_id, repo_url, n_pages FROM l JOIN repos USING (repo_url) WHERE complete
""")
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    done = tasks_of(spark, d).where(F.col("status").isin("completed", "cached"))
    i = F.col("event_id")
    url = F.concat(F.lit("https://github.com/own"), (i % 7).cast("string"), F.lit("/repo"), (i % 5).cast("string"))
    last = T.latest(done.withColumn("repo_url", url), ["user_id", "repo_url"], [F.desc("ts"), F.desc("event_id")])
    return last.join(repositories_of(spark, d).where("complete"), "repo_url").select("user_id", "event_id", "repo_url", "n_pages")


@reg.add(f"""
WITH {REPOS}, a AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'https://github.com/own' || (item_id % 7) || '/repo' || (item_id % 5) WHEN 1 THEN 'http://old.example/own' || (item_id % 7) || '/repo' || (item_id % 5) ELSE 'http://no/where' END AS asked FROM benchmark),
  k AS (SELECT repo_url, regexp_extract(repo_url, '^[a-z]+://[^/]*/([^/]+/[^/?#]+)', 1) AS key FROM repos),
  byk AS (SELECT key, min(repo_url) AS repo_url FROM k WHERE key <> '' GROUP BY key)
SELECT item_id, coalesce(k.repo_url, byk.repo_url) AS repo_url FROM a LEFT JOIN k ON k.repo_url = a.asked LEFT JOIN byk ON k.repo_url IS NULL AND byk.key = regexp_extract(a.asked, '^[a-z]+://[^/]*/([^/]+/[^/?#]+)', 1)
""")
def batch_repository_lookup(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    name = F.concat(F.lit("/own"), (i % 7).cast("string"), F.lit("/repo"), (i % 5).cast("string"))
    asked = F.when(i % 3 == 0, F.concat(F.lit("https://github.com"), name)).when(i % 3 == 1, F.concat(F.lit("http://old.example"), name)).otherwise("http://no/where")
    rows = table(spark, d, "benchmark").select("item_id", asked.alias("asked"), X.repo_key(asked).alias("key"))
    repos = repositories_of(spark, d).select("repo_url", X.repo_key(F.col("repo_url")).alias("key"))
    exact = rows.join(repos.select(F.col("repo_url").alias("asked"), "repo_url"), "asked", "left")
    by_key = repos.where("key <> ''").groupBy("key").agg(F.min("repo_url").alias("by_key"))
    return exact.join(by_key, "key", "left").select("item_id", F.coalesce("repo_url", "by_key").alias("repo_url"))


@reg.add(f"""
WITH {TASKS}, m AS (SELECT user_id, max(CASE WHEN status = 'completed' THEN ts END) AS seen, max(CASE WHEN status = 'cached' THEN value END) AS stars, max(CASE WHEN status = 'failed' THEN status END) AS note FROM (SELECT *, progress AS value FROM tasks) GROUP BY user_id)
SELECT user_id, seen IS NULL OR epoch(TIMESTAMP '2024-01-20') - floor(epoch(seen)) >= 86400 OR (stars IS NULL AND note IS NULL) AS refresh FROM m
""")
def metadata_refresh(spark: SparkSession, d: str) -> DataFrame:
    s, pick = F.col("status"), lambda k, c: F.max(F.when(F.col("status") == k, F.col(c)))
    m = tasks_of(spark, d).groupBy("user_id").agg(pick("completed", "ts").alias("at"), pick("cached", "progress").alias("stars"), F.max(F.when(s == "failed", s)).alias("note"))
    return m.select("user_id", T.needs_refresh(F.col("at"), F.lit("2024-01-20").cast("timestamp"), [F.col("stars"), F.col("note")]).alias("refresh"))


@reg.add("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || CASE WHEN length(text) > 300 THEN text[1:300] || '...' ELSE text END, chr(10) ORDER BY turn) AS recent FROM r WHERE n <= 4 GROUP BY conv_id
""")
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), X.truncate(F.col("text"), 300))
    return T.last_turns(table(spark, d, "conversations"), "conv_id", "turn", line, 4)


@reg.add("""
WITH c AS (SELECT conv_id, conv_id % 13 AS user_id, max(turn) AS updated, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id)
SELECT user_id, conv_id, row_number() OVER (PARTITION BY user_id ORDER BY updated DESC, conv_id) AS place, first[1:40] AS preview FROM c
""")
def chat_history_order(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated"), F.min_by("text", "turn").alias("first"))
    c = c.withColumn("user_id", F.col("conv_id") % 13)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated"), "conv_id"))
    return c.select("user_id", "conv_id", place.alias("place"), F.left("first", F.lit(40)).alias("preview"))


@reg.add("""
WITH h AS (SELECT page_id, lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1), '^www\\.', '')) AS host FROM pages)
SELECT page_id, host, host = 'example.com' OR ends_with(host, '.example.com') OR host = 'site3.example.org' OR ends_with(host, '.site3.example.org') AS allowed FROM h
""")
def domain_allow_list(spark: SparkSession, d: str) -> DataFrame:
    host = F.lower(F.regexp_replace(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]+)", 1), r"^www\.", ""))
    domains = ("example.com", "site3.example.org")
    p = table(spark, d, "pages").select("page_id", host.alias("host"))
    return p.withColumn("allowed", X.any_of([(F.col("host") == x) | F.col("host").endswith("." + x) for x in domains]))


@reg.add(f"""
WITH {TASKS} SELECT user_id, count(*) AS n_tasks, count(*) FILTER (status IN ('completed', 'cached')) AS n_done, count(*) FILTER (status = 'failed') AS n_failed,
  round(50 + 35.0 * count(*) FILTER (status IN ('completed', 'cached')) / count(*), 6) AS progress FROM tasks GROUP BY user_id
""")
def progress_totals(spark: SparkSession, d: str) -> DataFrame:
    done, s = F.col("status").isin("completed", "cached"), F.col("status")
    return tasks_of(spark, d).groupBy("user_id").agg(
        F.count("*").alias("n_tasks"), F.count_if(done).alias("n_done"), F.count_if(s == "failed").alias("n_failed"), F.round(50 + 35.0 * F.count_if(done) / F.count("*"), 6).alias("progress")
    )


@reg.add("""
SELECT user_id, event_type AS tool, count(*) AS calls, count(*) FILTER (value > 50) AS successes, round(avg(value / 100), 6) AS relevance, max(value) AS longest, count(*) FILTER (event_id % 4 = 0) AS fallbacks FROM events GROUP BY ALL
""")
def tool_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("tool")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("value") > 50).alias("successes"), F.round(F.avg(F.col("value") / 100), 6).alias("relevance"),
        F.max("value").alias("longest"), F.count_if(F.col("event_id") % 4 == 0).alias("fallbacks"),
    )
