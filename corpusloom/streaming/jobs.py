"""Incremental jobs on Structured Streaming. Each runs over what is new and ends; its result equals the batch result.

What was seen lies in Spark's state store, so a batch reads nothing of the batches before it. What a batch changes goes to a
folder of its own, which a batch that runs again overwrites.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.shared import place  # noqa: F401
from ..sources.stores import chunk_terms


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], at: str, mode: str = "append") -> None:
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that earlier batches wrote, if there is one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class Changes:
    """A table by key, kept as what each batch changed. Reading takes each key's newest row; now and then all are written as one base."""

    def __init__(self, spark: SparkSession, at: str, schema: StructType, keys: list[str], merge_after: int = 50):
        self.spark, self.at, self.schema, self.keys, self.merge_after = spark, at, schema, keys, merge_after

    def put(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.at}/changes/batch={number}")
        if number and number % self.merge_after == 0:
            self.read(number).write.mode("overwrite").parquet(f"{self.at}/base/until={number}")

    def read(self, until: int | None = None) -> DataFrame:
        """The newest row of each key, of the batches up to until."""
        changes, base, first = _written(self.spark, f"{self.at}/changes"), _written(self.spark, f"{self.at}/base"), -1
        if changes is None:
            return self.spark.createDataFrame([], self.schema)
        if until is not None:
            base = base.where(F.col("until") < until) if base is not None else None
            changes = changes.where(F.col("batch") <= until)
        if base is not None:
            first = base.agg(F.coalesce(F.max("until"), F.lit(-1))).first()[0]
            changes = changes.where(F.col("batch") > first).unionByName(base.where(F.col("until") == first).withColumnRenamed("until", "batch"))
        newest = changes.groupBy(*self.keys).agg(F.max_by(F.struct(*self.schema.names), "batch").alias("row"))
        return newest.select("row.*")


def _once(stream: DataFrame, keys: list[str], time: str | None, late: str | None) -> DataFrame:
    """The first row of each key (null is one). With late, keys are forgotten once time has passed them by that much, and rows older than that are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if late else stream.dropDuplicates(keys)


def incremental_postings(spark: SparkSession, path: str, schema: StructType, at: str, key: str = "doc_id", time: str | None = None, late: str | None = None) -> DataFrame:
    """Postings (doc_key, term, tf) of the documents under path, added batch by batch; a key that came before is passed over.

    Keys lie in the state store: all of them, or with late those that the column time has not passed by that much. Each batch
    overwrites its own folder, so that a batch that is run again leaves no doubles. With nothing new since the last run the
    index comes back as it is; without any document it is empty.
    """
    index = f"{at}/index"

    def add(batch: DataFrame, number: int) -> None:
        chunk_terms(batch, F.col(key), "text").write.mode("overwrite").parquet(f"{index}/batch={number}")

    new = _once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path), [key], time, late)
    _run(new, add, at)
    have = _written(spark, index)
    return spark.createDataFrame([], f"doc_key {schema[key].dataType.simpleString()}, term string, tf long") if have is None else have.select("doc_key", "term", "tf")


def changed_files(spark: SparkSession, path: str, schema: StructType, at: str, time: str | None = None, late: str | None = None) -> DataFrame:
    """path, mtime and batch of each version of a file that was taken up: a (path, mtime) is taken once. Without any file it is empty.

    time and late as for incremental_postings.
    """
    log = f"{at}/versions"

    def add(batch: DataFrame, number: int) -> None:
        batch.select("path", "mtime").write.mode("overwrite").parquet(f"{log}/batch={number}")

    _run(_once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), ["path", "mtime"], time, late), add, at)
    have = _written(spark, log)
    if have is None:
        return spark.createDataFrame([], StructType([schema["path"], schema["mtime"]]).add("batch", "int"))
    return have.select("path", "mtime", "batch")


_EVENT = ("at", "event_id", "status", "progress")
_STATE = "ended_at long, ended_event_id long, ended_status string, ended_progress double, last_at long, last_event_id long, last_status string, last_progress double"


def task_states(events: DataFrame, at: str, terminal: tuple[str, ...] = ("failed",), late: str = "7 days", idle: str | None = None) -> DataFrame:
    """task_id, event_id, status and progress of each task from a stream (task_id, ts, event_id, status, progress).

    The first terminal event settles a task; without one the last event counts (both by ts, then event_id). A task's state is two
    events. With idle, a task without events for that long, by event time, loses its state: its row stays as it is, and what comes
    later begins anew, unless it was settled: a settled row stays settled. With idle, events more than late behind the newest one
    are dropped. Only tasks that a batch changed are written. Rows without a task are one task.
    """
    schema = f"task_id {events.schema['task_id'].dataType.simpleString()}, settled boolean, event_id long, status string, progress double"
    wait = pd.Timedelta(idle) if idle else None

    def settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else (None,) * 8
        ended, last = (e if e[0] is not None else None for e in (tuple(old[:4]), tuple(old[4:])))
        for f in frames:
            for e in f[list(_EVENT)].itertuples(index=False):
                e = (int(e.at), int(e.event_id), None if pd.isna(e.status) else e.status, None if pd.isna(e.progress) else float(e.progress))
                if last is None or e[:2] > last[:2]:
                    last = e
                if e[2] in terminal and (ended is None or e[:2] < ended[:2]):
                    ended = e
        if last is None:
            return
        state.update((*(ended or (None,) * 4), *last))
        if wait is not None:
            state.setTimeoutTimestamp(max(last[0] // 1000 + int(wait.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        shown = ended or last
        if (ended or last) != (tuple(old[:4]) if old[0] is not None else tuple(old[4:])):
            yield pd.DataFrame([(key[0], ended is not None, *shown[1:])], columns=["task_id", "settled", "event_id", "status", "progress"])

    timed = events.where("ts is not null and event_id is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    typed = timed.select("task_id", "ts", F.unix_micros("ts").alias("at"), F.col("event_id").cast("long"), "status", F.col("progress").cast("double"))
    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    timed = typed.withWatermark("ts", late) if idle else typed
    states = timed.groupBy("task_id").applyInPandasWithState(settle, schema, _STATE, "update", timeout)
    table = Changes(events.sparkSession, at, states.schema, ["task_id"])

    def put(batch: DataFrame, number: int) -> None:
        if idle:  # a task whose state has gone may have been settled before
            done = table.read(number - 1).where("settled").select("task_id")
            batch = batch.join(done, batch["task_id"].eqNullSafe(done["task_id"]), "left_anti").unionByName(batch.join(done, batch["task_id"].eqNullSafe(done["task_id"]), "left_semi").where("settled"))
        table.put(batch, number)

    _run(states, put, at, "update")
    return table.read().drop("settled")


def event_counts(events: DataFrame, at: str, every: str | None = None, late: str = "7 days") -> DataFrame:
    """event_type, n and k_total of a stream (event_type, props as JSON); with every also for each stretch of time (start) of the stream's ts.

    Each batch writes the counts that it changed. With every, counts of stretches that ended more than late before the newest event
    leave the state store, and what comes for them is dropped.
    """
    typed = events.withColumn("k", F.from_json("props", "k long")["k"])
    typed = typed.withColumn("ts", F.col("ts").cast("timestamp")) if every else typed
    keys = [*([F.window("ts", every).alias("window")] if every else []), "event_type"]
    counts = (typed.withWatermark("ts", late) if every else typed).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.coalesce("k", F.lit(0))).alias("k_total"))
    if every:
        counts = counts.select(F.col("window.start").alias("start"), "event_type", "n", "k_total")
    table = Changes(events.sparkSession, at, counts.schema, ["start", "event_type"] if every else ["event_type"])
    _run(counts, table.put, at, "update")
    return table.read()
