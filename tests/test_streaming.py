"""Streaming jobs that are started again on the progress they left, find nothing, or get events late."""

from corpusloom.streaming import jobs
from pyspark.sql import functions as F

EVENTS = "task_id long, ts timestamp, event_id long, status string, progress double"
COUNTED = "ts timestamp, event_type string, props string"


def stream_of(spark, src, rows, schema="task_id long, t long, event_id long, status string, progress double"):
    df = spark.createDataFrame(rows, schema)
    if "t" in df.columns:
        df = df.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.write.mode("append").parquet(src)


def test_task_states_after_a_restart(spark, tmp_path):
    src, at = str(tmp_path / "in"), str(tmp_path / "at")

    def now(**k):
        return {r.task_id: (r.event_id, r.status) for r in jobs.task_states(spark.readStream.schema(EVENTS).parquet(src), at, **k).collect()}

    stream_of(spark, src, [])
    assert now() == {}
    stream_of(spark, src, [(1, 10, 1, "running", 0.1), (2, 10, 2, "failed", 0.2), (None, 10, 9, "running", None)])
    assert now() == now() == {1: (1, "running"), 2: (2, "failed"), None: (9, "running")}
    stream_of(spark, src, [(1, 5, 3, "late", 0.0), (1, 20, 4, "done", 1.0), (2, 30, 5, "running", 0.9)])  # an event that comes late, and one after the end
    assert now() == now() == {1: (4, "done"), 2: (2, "failed"), None: (9, "running")}
    stream_of(spark, src, [(2, 3, 6, "failed", 0.0)])  # an earlier end
    assert now()[2] == (6, "failed")


def test_task_states_expire(spark, tmp_path):
    src, at, day = str(tmp_path / "in"), str(tmp_path / "at"), 86_400

    def now():
        return {r.task_id: (r.event_id, r.status) for r in jobs.task_states(spark.readStream.schema(EVENTS).parquet(src), at, late="1 day", idle="2 days").collect()}

    stream_of(spark, src, [(1, 10, 1, "running", 0.1), (2, 10, 2, "failed", 0.2)])
    now()
    stream_of(spark, src, [(3, 10 * day, 3, "running", 0.1)])  # the others' time is up
    now()
    stream_of(spark, src, [(1, 5 * day, 4, "old", 0.1), (3, 10 * day + 5, 7, "done", 1.0)])  # too late
    assert now() == {1: (1, "running"), 2: (2, "failed"), 3: (7, "done")}
    stream_of(spark, src, [(1, 10 * day + 9, 5, "again", 0.5), (2, 10 * day + 9, 6, "running", 0.5)])  # one goes on, a settled one stays
    assert now() == now() == {1: (5, "again"), 2: (2, "failed"), 3: (7, "done")}


def test_counts_after_a_restart(spark, tmp_path):
    src, at = str(tmp_path / "in"), str(tmp_path / "at")
    rounds = (([], {}), ([("a", '{"k": 2}'), ("b", None)], {"a": (1, 2), "b": (1, 0)}), ([("a", '{"k": 3}')], {"a": (2, 5), "b": (1, 0)}))
    for rows, want in rounds:
        stream_of(spark, src, rows, "event_type string, props string")
        for _ in range(2):
            got = jobs.event_counts(spark.readStream.schema("event_type string, props string").parquet(src), at)
            assert {r.event_type: (r.n, r.k_total) for r in got.collect()} == want
    changed = spark.read.parquet(f"{at}/changes").where("event_type = 'b'")
    assert changed.count() == 1  # the last batch wrote what it changed


def test_daily_counts_drop_what_is_too_late(spark, tmp_path):
    src, at, day = str(tmp_path / "in"), str(tmp_path / "at"), 86_400
    schema = "t long, event_type string, props string"

    def now():
        got = jobs.event_counts(spark.readStream.schema(COUNTED).parquet(src), at, every="1 day", late="2 days")
        return {(r.start.day, r.event_type): r.n for r in got.collect()}

    stream_of(spark, src, [(5, "a", None), (day, "a", None)], schema)
    assert now() == {(1, "a"): 1, (2, "a"): 1}
    stream_of(spark, src, [(5, "a", None), (9 * day, "b", None)], schema)
    assert now() == {(1, "a"): 2, (2, "a"): 1, (10, "b"): 1}
    stream_of(spark, src, [(5, "a", None), (8 * day, "b", None)], schema)  # the first is behind by more than two days
    assert now() == {(1, "a"): 2, (2, "a"): 1, (10, "b"): 1, (9, "b"): 1}


def test_changes_merge(spark, tmp_path):
    table = jobs.Changes(spark, str(tmp_path), spark.createDataFrame([], "k long, v long").schema, ["k"], merge_after=2)
    for number, rows in enumerate([[(1, 1)], [(2, 1)], [(1, 2)], [(3, 1), (None, 4)], [(2, 5)], [(None, 6)]]):
        table.put(spark.createDataFrame(rows, "k long, v long"), number)
    assert {r.k: r.v for r in table.read().collect()} == {1: 2, 2: 5, 3: 1, None: 6}
    table.put(spark.createDataFrame([(2, 5)], "k long, v long"), 4)  # a batch that runs again
    assert {r.k: r.v for r in table.read().collect()} == {1: 2, 2: 5, 3: 1, None: 6}


def test_index_and_files_after_a_restart(spark, tmp_path):
    docs, index = str(tmp_path / "docs"), str(tmp_path / "index")
    schema = spark.createDataFrame([], "doc_id long, text string").schema
    now = lambda: sorted((r.doc_key, r.term, r.tf) for r in jobs.incremental_postings(spark, docs, schema, index).collect())
    spark.createDataFrame([], schema).write.parquet(docs)
    assert now() == []
    spark.createDataFrame([(1, "a b a"), (1, "a b a"), (2, None)], schema).write.mode("append").parquet(docs)
    assert now() == now() == [(1, "a", 2), (1, "b", 1)]
    spark.createDataFrame([(1, "z"), (3, "c")], schema).write.mode("append").parquet(docs)
    assert now() == now() == [(1, "a", 2), (1, "b", 1), (3, "c", 1)]

    files, log = str(tmp_path / "files"), str(tmp_path / "log")
    schema = spark.createDataFrame([], "path string, mtime long").schema
    now = lambda: sorted((r.path, r.mtime) for r in jobs.changed_files(spark, files, schema, log).collect())
    spark.createDataFrame([], schema).write.parquet(files)
    assert now() == []
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], schema).write.mode("append").parquet(files)
    spark.createDataFrame([("a", 2), ("b", 1)], schema).write.mode("append").parquet(files)
    assert now() == now() == [("a", 1), ("a", 2), ("b", 1)]


def test_index_forgets_keys_behind_the_watermark(spark, tmp_path):
    docs, index, day = str(tmp_path / "docs"), str(tmp_path / "index"), 86_400
    schema = spark.createDataFrame([], "doc_id long, text string, ts timestamp").schema

    def add(*rows):
        spark.createDataFrame(rows, "doc_id long, text string, t long").select("doc_id", "text", F.timestamp_seconds("t").alias("ts")).write.mode("append").parquet(docs)
        return sorted((r.doc_key, r.term) for r in jobs.incremental_postings(spark, docs, schema, index, time="ts", late="2 days").collect())

    assert add((1, "a", 5), (1, "b", day)) in ([(1, "a")], [(1, "b")])
    assert len(add((1, "c", 9), (2, "d", 9 * day))) == 2  # the key is known
    assert len(add((2, "e", 9 * day))) == 2
