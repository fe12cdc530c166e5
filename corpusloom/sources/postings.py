"""A stored inverted index: postings in Parquet, bucketed by term, that grows by batches and is searched in place.

A batch is there once its row of statistics is: that row is written last, and searches read the batches it names. So a
batch that broke off leaves nothing that counts, and adding it again is right.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators.search import K1, B

#: Terms of all questions up to which only their buckets are read; documents whose postings of one term lie in one slice.
FEW_TERMS, SLICE_DOCS = 2_000, 5_000_000


@dataclass(frozen=True)
class Index:
    """path; part: columns by which statistics are kept apart; buckets; slices: keys that a term's postings are dealt to."""

    spark: SparkSession
    path: str
    part: tuple[str, ...]
    buckets: int
    slices: int

    def table(self, kind: str) -> DataFrame:
        """postings (key, term, part, id, tf, dl, batch) or terms (key, term, part, df, batch), of the batches that are there."""
        return self.spark.table(_name(self.path, kind)).where(F.col("batch").isin(self.done()))

    def done(self) -> list[str]:
        """The batches that are there; their number is that of the calls that added documents."""
        return [r.batch for r in self.batches().select("batch").distinct().collect()]

    def batches(self) -> DataFrame:
        """batch, part, documents and length (tokens) of each batch."""
        return self.spark.read.parquet(f"{self.path}/batches")

    def sizes(self) -> DataFrame:
        """part, n (documents) and avgdl."""
        per = self.batches().groupBy(*self.part).agg(F.sum("documents").alias("n"), F.sum("length").alias("length")).where("n > 0")
        return per.withColumn("avgdl", F.col("length") / F.col("n")).drop("length")


def _name(path: str, kind: str) -> str:
    return f"{kind}_{hashlib.md5(path.encode()).hexdigest()}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _key(slice_: Column, term: Column) -> Column:
    return F.concat(slice_.cast("string"), F.lit(" "), term)


def create_index(spark: SparkSession, path: str, id_type: str = "bigint", part: dict[str, str] | None = None, documents: int = 0, buckets: int = 64) -> Index:
    """An empty index at path. part: names and types of the columns by which statistics are kept apart.

    documents: how many are expected; a term's postings are dealt to a slice for each SLICE_DOCS of them, so that no bucket
    has to hold all postings of a word that every document has. buckets: tasks that a search over all terms takes.
    """
    part = part or {}
    own = ", ".join(f"`{c}` {t}" for c, t in part.items())
    about = {"id": id_type, "part": part, "buckets": buckets, "slices": documents // SLICE_DOCS + 1}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.parquet(f"{path}/about")
    schema = f"batch string{', ' + own if own else ''}, documents long, length long"
    spark.createDataFrame([], schema).write.parquet(f"{path}/batches")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """The index at path, whatever session wrote it. Its tables are named in this session's catalog."""
    about = json.loads(spark.read.parquet(f"{path}/about").first().about)
    own = [f"`{c}` {t}" for c, t in about["part"].items()]
    columns = {"postings": ["key string", "term string", *own, f"id {about['id']}", "tf int", "dl int", "batch string"], "terms": ["key string", "term string", *own, "df bigint", "batch string"]}
    for kind, cols in columns.items():
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {_name(path, kind)} ({', '.join(cols)}) USING parquet "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {about['buckets']} BUCKETS LOCATION '{path}/{kind}'"
        )
    return Index(spark, path, tuple(about["part"]), about["buckets"], about["slices"])


def _counted(tokens: Column) -> Column:
    """dl (all tokens) and terms (term and tf of each distinct one), inside of a row: equal tokens stand together when sorted, so none is shuffled to be counted."""
    def runs(t: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: (i == 0) | (i == F.size(t)) | (F.get(t, i) != F.get(t, i - 1)))  # and the end
        terms = let(first, lambda at: F.transform(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda i, k: F.struct(F.get(t, i).alias("term"), (F.get(at, k + 1) - i).alias("tf"))))
        return F.struct(F.size(t).alias("dl"), terms.alias("terms"))

    return let(F.sort_array(tokens), runs)


def add_documents(index: Index, docs: DataFrame, tokens: Callable[[Column], Column] = tokenize) -> None:
    """Add docs (id, text, part columns). What the index has (by id and part), or what comes twice, counts once: the first by text stays.

    A null or blank text adds to the number of documents, without postings. Rows without an id are passed over. A part column may
    be null: those documents are a part of their own that no search by part finds.
    """
    batch, part = uuid.uuid4().hex, list(index.part)
    new = docs.where("id is not null").select("id", F.coalesce("text", F.lit("")).alias("text"), *part)
    if not new.groupBy("id", *part).count().where("count > 1").isEmpty():
        new = new.groupBy("id", *part).agg(F.min("text").alias("text"))
    done = index.done()
    if done:
        have = index.spark.read.parquet(f"{index.path}/ids").where(F.col("batch").isin(done))
        new = new.join(have, [new[c].eqNullSafe(have[c]) for c in ("id", *part)], "left_anti")
    each = new.select("id", *part, _counted(tokens(F.col("text"))).alias("c")).select("id", *part, "c.dl", F.inline("c.terms"))
    slice_ = F.pmod(F.xxhash64("id"), F.lit(index.slices))
    _append(each.select(_key(slice_, F.col("term")).alias("key"), "term", *part, "id", "tf", "dl", F.lit(batch).alias("batch")), index, "postings")
    own = index.spark.table(_name(index.path, "postings")).where(F.col("batch") == batch)
    df = own.groupBy("key", "term", *part).agg(F.count("*").alias("df")).groupBy("term", *part).agg(F.sum("df").alias("df"))
    _append(df.select(_key(F.lit(0), F.col("term")).alias("key"), "term", *part, "df", F.lit(batch).alias("batch")), index, "terms")
    new.select("id", *part).write.parquet(f"{index.path}/ids/batch={batch}")
    ids = index.spark.read.schema(new.select("id", *part).schema).parquet(f"{index.path}/ids/batch={batch}")
    counts = ids.groupBy(*part).agg(F.count("*").alias("documents"))
    lengths = own.groupBy(*part).agg(F.sum("tf").alias("length"))
    same = [counts[c].eqNullSafe(lengths[c]) for c in part]
    sizes = counts.join(lengths, same, "left") if part else counts.crossJoin(lengths)  # one row each without parts
    sizes = sizes.select(F.lit(batch).alias("batch"), *[counts[c] for c in part], "documents", F.coalesce("length", F.lit(0)).alias("length"))
    sizes.coalesce(1).write.mode("append").parquet(f"{index.path}/batches")


def _append(rows: DataFrame, index: Index, kind: str) -> None:
    dealt = rows.repartition(index.buckets, "key")  # a file a bucket
    dealt.write.format("parquet").mode("append").bucketBy(index.buckets, "key").sortBy("key").option("path", f"{index.path}/{kind}").saveAsTable(_name(index.path, kind))


def search(index: Index, questions: DataFrame, tokens: Callable[[Column], Column] = tokenize) -> DataFrame:
    """qid, part, id and score (above 0) of every document for every question (qid, text, and the part columns if a question asks some parts only).

    The same as bm25 over the documents. Postings are read where they lie and are not shuffled; where the questions have few terms
    altogether, only the buckets of these are read. Questions without terms find nothing.
    """
    part = list(index.part)
    scoped = [c for c in part if c in questions.columns]
    asked = questions.select("qid", *scoped, F.explode(tokens(F.col("text"))).alias("term"))
    asked = asked.groupBy(*asked.columns).agg(F.count("*").alias("qtf"))
    some = [r.term for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    few = len(some) <= FEW_TERMS // index.slices
    near = lambda t, slices: t.where(F.col("key").isin([f"{k} {w}" for w in some for k in range(slices)]) if some else F.lit(False)) if few else t
    df = near(index.table("terms"), 1).join(asked.select(_key(F.lit(0), F.col("term")).alias("key")).distinct(), "key", "left_semi")
    df = df.groupBy("term", *part).agg(F.sum("df").alias("df"))
    sizes = index.sizes()
    stats = df.join(F.broadcast(sizes), part) if part and sizes.count() <= 100_000 else df.join(sizes, part) if part else df.crossJoin(F.broadcast(sizes))  # without parts one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(stats.select("term", *part, "avgdl", idf.alias("idf")), ["term", *scoped])
    weights = weights.select("qid", *part, "avgdl", (F.col("qtf") * F.col("idf")).alias("weight"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(index.slices - 1)), lambda k: _key(k, F.col("term")))).alias("key"))
    hits = near(index.table("postings"), index.slices).select("key", *part, "id", "tf", "dl").join(weights, ["key", *part])
    length = F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(0.0)
    gain = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
    return hits.groupBy("qid", *part, "id").agg(F.sum(gain).alias("score")).where("score > 0")


def term_totals(index: Index) -> DataFrame:
    """part columns, term and n, how often the term stands in the documents."""
    per = index.table("postings").groupBy("key", *index.part, "term").agg(F.sum("tf").alias("n"))  # where the postings lie
    return per.groupBy(*index.part, "term").agg(F.sum("n").alias("n"))


def drop_names(index: Index) -> None:
    """Take the index's tables out of this session's catalog; its files stay."""
    for kind in ("postings", "terms"):
        try:
            index.spark.sql(f"DROP TABLE IF EXISTS {_name(index.path, kind)}")
        except AnalysisException:
            pass
