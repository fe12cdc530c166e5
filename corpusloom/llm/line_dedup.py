"""Operator 9: line dedup by repeated passages, and by content-defined chunks.

dedup_passages finds every repeated passage whole: from each line on, the shortest run of lines that is worth
removing is hashed, and so is the shortest run up to each line. A longer passage is covered by such runs, so that
no boundary has to agree between documents. Runs whose hash repeats are compared by SHA-256.

dedup_lines is the coarser form that removes whole chunks: a chunk ends after each line at which a rolling hash over the last lines' hashes is divisible by a modulus, so
that boundaries follow the lines and not their numbers, and an insertion shifts none beyond the window. Chunks of
several lines that stand more than once in the corpus are compared byte by byte and all but the first are removed.
All steps are DataFrame expressions, joins and partial aggregates; hashes alone are shuffled for the first count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, let, n_words, stash


@dataclass(frozen=True)
class Chunks:
    """Lines under the rolling hash, the modulus (the mean lines of a chunk), and what makes a chunk worth removing."""

    window: int = 2
    modulus: int = 2
    least_lines: int = 2
    least_chars: int = 40


def chunk_texts(text: Column, rule: Chunks) -> Column:
    """The chunks of a text in order: array of (n_lines, text). Joined by newlines they are the text."""

    def ends(lines: Column, hashes: Column) -> Column:
        """Positions (from 1) of the lines that end a chunk; the last line does."""
        rolled = lambda i: sum((F.shiftleft(F.coalesce(F.get(hashes, i - k), F.lit(0).cast("long")), 7 * k) for k in range(1, rule.window)), F.get(hashes, i) * 1)
        return F.filter(
            F.sequence(F.lit(1), F.size(lines)), lambda i: (i == F.size(lines)) | (F.pmod(F.xxhash64(rolled(i - 1)), F.lit(rule.modulus)) == 0)
        )

    def cut(lines: Column, at: Column) -> Column:
        def piece(z: Column, k: Column) -> Column:
            a = F.when(k > 0, F.get(at, k - 1)).otherwise(F.lit(0))
            return F.struct((z - a).alias("n_lines"), F.array_join(F.slice(lines, a + 1, z - a), "\n").alias("text"))

        return F.transform(at, piece)

    # hashes keep 31 bits, so that shifted sums of a window stay within a long
    hashed = lambda lines: F.transform(lines, lambda x: F.shiftrightunsigned(F.xxhash64(x), 33))
    return let(F.split(text, "\n"), lambda lines: let(let(hashed(lines), lambda h: ends(lines, h)), lambda at: cut(lines, at)))


def _chunks(docs: DataFrame, rule: Chunks) -> DataFrame:
    """doc_id, place, hash and chunk of every chunk long enough to count."""
    rows = docs.where("text is not null").select("doc_id", F.posexplode(chunk_texts(F.col("text"), rule)).alias("place", "c"))
    rows = rows.where((F.col("c.n_lines") >= rule.least_lines) & (F.length("c.text") >= rule.least_chars))
    return rows.select("doc_id", "place", F.xxhash64("c.text").alias("hash"), F.col("c.text").alias("chunk"))


def repeated_chunks(docs: DataFrame, rule: Chunks = Chunks()) -> DataFrame:
    """doc_id, place and hash of the chunks to remove: those that equal an earlier one, by doc_id (null last), then place."""
    found = _chunks(docs, rule)
    twice = stash(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "chunk-hashes")
    again = stash(found.join(broadcast_if_small(twice, 16), "hash", "left_semi"), "chunk-repeats")
    where = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")
    first = again.groupBy("hash", "chunk").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "chunk", "first")
    return again.join(first, ["hash", "chunk"]).where(~where.eqNullSafe(F.col("first"))).select("doc_id", "place", "hash")


def dedup_lines(docs: DataFrame, rule: Chunks = Chunks()) -> DataFrame:
    """docs with text rid of repeated chunks, plus n_chunks_removed and n_chars_removed.

    Of equal chunks the first by doc_id, then place, stays; single lines and short chunks are left alone. A null
    text stays null, an empty one empty, and an empty table gives no rows; texts of any length are cut whole. Rows that repeat
    a doc_id count as one document: a chunk that both hold at the same place stays in both. Columns of docs with these names are replaced.
    """
    new = ("n_chunks_removed", "n_chars_removed")
    own = docs.drop(*[c for c in docs.columns if c.lower() in new])
    gone_at, id_at, kept_at = (fresh(own, c) for c in ("_gone", "_id", "_kept"))
    gone = repeated_chunks(own.select("doc_id", "text"), rule)
    gone = gone.groupBy(F.col("doc_id").alias(id_at)).agg(F.collect_set(F.struct("place", "hash")).alias(gone_at))
    joined = own.join(gone, F.col("doc_id").eqNullSafe(F.col(id_at)), "left")

    def strip(chunks: Column) -> Column:
        # an array of the removed places, so that a lookup is one step
        is_gone = lambda c, i: F.array_contains(gone_at, F.struct(i.alias("place"), F.xxhash64(c["text"]).alias("hash")))
        flags = F.transform(chunks, lambda c, i: F.struct(c["text"].alias("text"), is_gone(c, i).alias("gone")))
        return let(
            flags,
            lambda f: F.struct(
                F.array_join(F.transform(F.filter(f, lambda x: ~x["gone"]), lambda x: x["text"]), "\n").alias("text"),
                F.size(F.filter(f, lambda x: x["gone"])).cast("long").alias("n"),
            ),
        )

    kept = F.when(F.col(gone_at).isNull(), F.struct(F.col("text").alias("text"), F.lit(0).cast("long").alias("n"))).otherwise(strip(chunk_texts(F.col("text"), rule)))
    out = joined.withColumn(kept_at, kept)
    removed = F.coalesce(F.length("text") - F.length(F.col(kept_at)["text"]), F.lit(0)).cast("long")
    columns = [F.col(kept_at)["text"].alias("text") if c == "text" else F.col(c) for c in own.columns]
    return out.select(*columns, F.col(kept_at)["n"].alias("n_chunks_removed"), removed.alias("n_chars_removed"))


@dataclass(frozen=True)
class Passages:
    """A passage is worth removing with this many lines and characters (newlines included), or as one line of this many words."""

    least_lines: int = 2
    least_chars: int = 40
    least_words: int = 50


def passage_runs(lines: Column, rule: Passages) -> Column:
    """The shortest runs of lines that are worth removing, from each line on and up to each line: array of (start, n_lines), start from 0."""
    most = max(rule.least_lines, rule.least_chars + 1)  # so many lines have the characters, as newlines count

    def reach(sizes: Column, first: Column, back: bool) -> Column:
        """Lines of the shortest run from first (from 0) on, or back from it; 0 if the text ends before."""
        near = lambda n: F.slice(sizes, F.greatest(first - n + 2, F.lit(1)), F.least(F.lit(n), first + 1)) if back else F.slice(sizes, first + 1, n)
        add = lambda acc, x: F.when((acc["n"] >= rule.least_lines) & (acc["chars"] >= rule.least_chars), acc).otherwise(F.struct((acc["n"] + 1).alias("n"), (acc["chars"] + 1 + x).alias("chars")))
        walk = lambda a: F.aggregate(F.reverse(a) if back else a, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("chars")), add)
        far = let(walk(near(most)), lambda r: F.when((r["n"] >= rule.least_lines) & (r["chars"] >= rule.least_chars), r["n"]).otherwise(0))
        # most lines need no walk: the first few have the characters
        short = lambda a: (F.size(a) == rule.least_lines) & (F.aggregate(a, F.lit(rule.least_lines - 1), lambda acc, x: acc + x) >= rule.least_chars)
        return let(near(rule.least_lines), lambda a: F.when(short(a), F.lit(rule.least_lines)).otherwise(far))

    # a run is packed in a long, so that equal ones are found by a hash set
    pack = lambda start, n: start.cast("long") * (most + 1) + n

    def every(sizes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(sizes) - 1)
        on = F.transform(at, lambda i: let(reach(sizes, i, False), lambda n: F.when(n > 0, pack(i, n))))
        to = F.transform(at, lambda i: let(reach(sizes, i, True), lambda n: F.when(n > 0, pack(i - n + 1, n))))
        wordy = lambda i: (F.get(sizes, i) >= 2 * rule.least_words - 1) & (n_words(F.get(lines, i)) >= rule.least_words)
        alone = F.transform(F.filter(at, wordy), lambda i: pack(i, F.lit(1)))
        return F.array_compact(F.array_distinct(F.concat(on, to, alone)))

    runs = let(F.transform(lines, lambda x: F.length(x)), every)
    return F.transform(runs, lambda r: F.struct(F.floor(r / (most + 1)).cast("int").alias("start"), F.pmod(r, F.lit(most + 1)).cast("int").alias("n_lines")))


def _run_text(lines: Column, run: Column) -> Column:
    return F.array_join(F.slice(lines, run["start"] + 1, run["n_lines"]), "\n")


def repeated_passages(docs: DataFrame, rule: Passages = Passages()) -> DataFrame:
    """doc_id, start, n_lines and hash of the runs to remove: those that equal an earlier one, by doc_id (null last), then line."""

    def hashed(more: dict) -> DataFrame:
        found = lambda lines: F.transform(passage_runs(lines, rule), lambda r: let(_run_text(lines, r), lambda t: F.struct(r["start"].alias("start"), r["n_lines"].alias("n_lines"), F.xxhash64(t).alias("hash"), *[f(t).alias(c) for c, f in more.items()])))
        return docs.where("text is not null").select("doc_id", F.explode(let(F.split("text", "\n"), found)).alias("r")).select("doc_id", "r.*")

    twice = stash(hashed({}).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "passage-hashes")
    again = hashed({"print": lambda t: F.unhex(F.sha2(t, 256))}).join(broadcast_if_small(twice, 16), "hash", "left_semi")
    again = stash(again, "passage-repeats")
    where = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    first = again.groupBy("print").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1").select("print", "first")
    # a table of its own, so that a frequent passage is dealt out as a skewed join
    return again.join(stash(first, "passage-firsts"), "print").where(~where.eqNullSafe(F.col("first"))).select("doc_id", "start", "n_lines", "hash")


def dedup_passages(docs: DataFrame, rule: Passages = Passages()) -> DataFrame:
    """docs with text rid of the lines of repeated passages, plus n_chunks_removed (stretches of removed lines) and n_chars_removed.

    A line goes if it stands in a run of lines that is worth removing (Passages) and equals an earlier run, by doc_id
    (null last), then line; runs may overlap. So the first of equal lines stays always. A null text stays null, an empty
    one empty, and an empty table gives no rows; texts of any length are read whole. Rows that repeat a doc_id count as one document: a run that both hold at the same line stays in both. Columns of docs
    with these names are replaced.
    """
    new = ("n_chunks_removed", "n_chars_removed")
    own = docs.drop(*[c for c in docs.columns if c.lower() in new])
    gone_at, id_at, kept_at = (fresh(own, c) for c in ("_gone", "_id", "_kept"))
    gone = repeated_passages(own.select("doc_id", "text"), rule)
    gone = gone.groupBy(F.col("doc_id").alias(id_at)).agg(F.collect_set(F.struct("start", "n_lines", "hash")).alias(gone_at))
    joined = own.join(gone, F.col("doc_id").eqNullSafe(F.col(id_at)), "left")

    def strip(lines: Column) -> Column:
        # rows that share a doc_id can hold other lines there
        held = F.filter(gone_at, lambda r: F.xxhash64(_run_text(lines, r)) == r["hash"])
        numbers = F.array_distinct(F.flatten(F.transform(held, lambda r: F.sequence(r["start"], r["start"] + r["n_lines"] - 1))))
        return let(
            numbers,
            lambda out: F.struct(
                F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out), lambda i: F.get(lines, i)), "\n").alias("text"),
                F.size(F.array_except(out, F.transform(out, lambda i: i + 1))).cast("long").alias("n"),
            ),
        )

    whole = F.struct(F.col("text").alias("text"), F.lit(0).cast("long").alias("n"))
    kept = F.when(F.col(gone_at).isNull() | F.col("text").isNull(), whole).otherwise(let(F.split("text", "\n"), strip))
    out = joined.withColumn(kept_at, kept)
    removed = F.coalesce(F.length("text") - F.length(F.col(kept_at)["text"]), F.lit(0)).cast("long")
    columns = [F.col(kept_at)["text"].alias("text") if c == "text" else F.col(c) for c in own.columns]
    return out.select(*columns, F.col(kept_at)["n"].alias("n_chunks_removed"), removed.alias("n_chars_removed"))
