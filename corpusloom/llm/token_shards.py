"""Operator 5: token ids in wavelet-matrix shards.

Documents are dealt to shards by ranges of doc_id, encoded, and written by Spark as one file per shard, whose
rows are blocks of whole documents: doc_ids, lengths, and the block's wavelet matrix with compressed planes.
Spark's committer publishes the files, so lost executors leave no partial shard. Reading a token, counting or
finding one needs no other file.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, worker_state
from .wavelet import WaveletMatrix

#: Bytes of text in a shard (more where that would make over MOST_SHARDS), tokens after which a block is closed, distinct runs that a task remembers.
SHARD_BYTES, MOST_SHARDS, BLOCK_TOKENS, MEMO = 24_000_000, 50_000, 1 << 20, 700_000

#: White space, and the pattern by which the tokenizer cuts texts before its merges.
BLANKS = "\t-\r \x85\xa0  -     　"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The letters that stand for bytes. Bytes that print stand for themselves, the others for letters from 256 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b for b in _PRINTS} | {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_PRINTS)))}

SCHEMA = "shard int, block int, doc_ids array<long>, lengths array<int>, n_tokens long, zeros array<long>, planes array<binary>, marks array<binary>"
_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_tokens", pa.int64())]
    + [("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("marks", pa.list_(pa.binary()))]
)
SPACE = chr(BYTE_LETTERS[32])


class Rough(Exception):
    """The blanks of a text aren't single ones between words."""


class Memo(dict):
    """Ids of the runs met so far, without the blank (lead) that each begins with."""

    def __init__(self, code: Encoder, lead: str):
        self.code, self.lead = code, lead

    def __missing__(self, run: str) -> bytes:
        code = self.code
        if run.isascii() and run.isalpha():  # most runs
            got = self[run] = array(code.code, [t.id for t in code.merges.tokenize((SPACE if self.lead else "") + run)]).tobytes()
            return got
        if self.lead and not run.isalpha():
            if not run or run[0] in code.blank or run[-1] in code.blank:
                raise Rough
            if code.inner.search(run):  # such pairs of words hardly come again
                return code.by_runs(self.lead + run)
        got = self[run] = code.encode_run(self.lead + run)
        return got


class Encoder:
    """The ids of a byte-level BPE file of the tokenizers library.

    Runs between blanks are encoded once each: the library's cutting pattern never joins across the run's
    end, so a text's ids are those of its runs in a row. Texts with a control string, and runs outside the
    scripts whose character classes are settled, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model
        self.bits = max((self.whole.get_vocab_size(True) - 1).bit_length(), 1)
        self.dtype = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.code = "H" if self.bits <= 16 else "I"
        self.runs = re.compile(f" ?[^{BLANKS}]++|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]")
        self.inner = re.compile(f"[{BLANKS}]")
        self.blank = {c for c in map(chr, range(0x3001)) if self.inner.match(c)}
        self.cut = regex.compile(PATTERN)
        self.odd = re.compile(r"[԰-\U0010ffff\x00-\x08\x0e-\x1f]")
        self.spaced, self.bare = Memo(self, " "), Memo(self, "")

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, p: str) -> bytes:
        """The ids of a piece that the merges never leave."""
        mapped = p.replace(" ", SPACE) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(BYTE_LETTERS)
        return self._pack([t.id for t in self.merges.tokenize(mapped)])

    def encode_run(self, r: str) -> bytes:
        """The ids of one run."""
        word = r[1:] if r[0] == " " else r
        if word.isalpha() and (word.isascii() or not self.odd.search(word)):
            return self._piece(r)
        if self.odd.search(r):
            return self._pack(self.whole.encode(r, add_special_tokens=False).ids)
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return (self.spaced if r[0] == " " else self.bare)[word[:-1]] + self.bare[r[-1]]
        pieces = self.cut.findall(r)
        if len(pieces) == 1:
            return self._piece(r)
        return b"".join([self.spaced[p[1:]] if p[0] == " " and len(p) > 1 else self.bare[p] for p in pieces])

    def by_runs(self, text: str) -> bytes:
        spaced, bare = self.spaced, self.bare
        return b"".join([spaced[r[1:]] if r[0] == " " and len(r) > 1 and r[1] not in self.blank else bare[r] for r in self.runs.findall(text)])

    def encode(self, text: str) -> bytes:
        """The packed ids of a whole text."""
        if any(s in text for s in self.specials):
            return self._pack(self.whole.encode(text, add_special_tokens=False).ids)
        if len(self.spaced) + len(self.bare) > MEMO:
            self.spaced.clear()
            self.bare.clear()
        first, *rest = text.split(" ")
        try:
            return b"".join([self.by_runs(first) if first else self.spaced[""], *map(self.spaced.__getitem__, rest)]) if text else b""
        except Rough:
            return self.by_runs(text)


def write_shards(docs: DataFrame, tokenizer: str, path: str, end: int = 0, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the ids of docs (doc_id, text), each text followed by the id end, to a new folder.

    Order: doc_id ascending, null first, ties by text, null first. A null or empty text has the end id only.
    Other columns of docs are not read. Shards are numbered in order; a document is never cut, so the longest
    bounds a block. An empty table writes a folder without blocks.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = int(rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0)
    shards = min(size // shard_bytes + 1, MOST_SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard, block = worker_state(f"encoder of {tokenizer}", lambda: Encoder(tokenizer)), TaskContext.get().partitionId(), 0
        tail = np.array([end], code.dtype).tobytes()
        ids, sizes, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(parts), code.dtype), code.bits).pack()
            row = {"shard": shard, "block": block, "doc_ids": ids, "lengths": sizes, **matrix}
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                packed = code.encode(text.as_py()) + tail
                ids.append(doc)
                sizes.append(len(packed) // code.dtype.itemsize)
                parts.append(packed)
                held += sizes[-1]
                if held >= BLOCK_TOKENS:
                    yield close()
                    ids, sizes, parts, held, block = [], [], [], 0, block + 1
        if ids:
            yield close()

    dealt = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
    dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).mapInArrow(run, SCHEMA).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def block_starts(shards: DataFrame) -> DataFrame:
    """shard, block and start: tokens before the block. Reads the counts of blocks only."""
    sizes = shards.select("shard", "block", "n_tokens")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    per = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before(Window.orderBy("shard"))), F.lit(0)))
    inside = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("shard").orderBy("block"))), F.lit(0))
    return sizes.withColumn("inside", inside).join(per.select("shard", "base"), "shard").select("shard", "block", (F.col("base") + F.col("inside")).alias("start"))


def documents(shards: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids_crc32 of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: b[k][i].as_py() for k in ("shard", "block", "doc_ids", "lengths", "n_tokens", "zeros", "planes", "marks")}
                ids = WaveletMatrix.unpack(row).decode().astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(starts, ends, strict=True)]
                m = len(crc)
                yield pa.record_batch(
                    [pa.array([row["shard"]] * m, pa.int32()), pa.array([row["block"]] * m, pa.int32()), pa.array(row["doc_ids"], pa.int64())]
                    + [pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())],
                    ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = shards.mapInArrow(run, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    placed = rows.join(broadcast_if_small(block_starts(shards), 24), ["shard", "block"])
    return placed.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """occurrences: how often the token stands in the corpus, by rank on each block's planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [WaveletMatrix.unpack(r) for r in b.to_pylist()]
            yield pa.record_batch([pa.array([w.rank(token, w.n) for w in got], pa.int64())], ["n"])

    return shards.select("n_tokens", "zeros", "planes", "marks").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"))


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """doc_id and place (within the document) of every occurrence of the token, by select on each block's planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                at = WaveletMatrix.unpack(row).find(token)
                ends = np.cumsum(row["lengths"])
                doc = np.searchsorted(ends, at, "right")
                start = ends - row["lengths"]
                yield pa.record_batch([pa.array([row["doc_ids"][d] for d in doc], pa.int64()), pa.array(at - start[doc], pa.int64())], ["doc_id", "place"])

    return shards.mapInArrow(run, "doc_id long, place long")
