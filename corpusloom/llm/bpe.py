"""Operator 13: BPE encoding and decoding over a table of distinct words.

Texts are split into words, in blocks of many documents: a document becomes the places of its words in its block's list
of distinct words. The lists meet by hash buckets of words, where each distinct word is encoded once whatever the number
of blocks and documents that hold it. The ids come back to the block and are put where the words stood. No stage grows
with the occurrences of a word: a word comes once from each block.

Decoding is a join of ids with the table of id and piece, which the vocabulary file bounds. The texts' own decoding joins the ids
of the distinct words, not of all tokens; what a word decodes to is put where the word stood, as its ids are.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .blocks import loose, pack, spans, squeeze, unpack
from .common import fresh, stash_by, worker_state

#: Hash buckets of words, distinct words and words after which a block is closed, words that a row of a block's documents holds.
BUCKETS, BLOCK_WORDS, BLOCK_TOTAL, ROW_WORDS = 4096, 600_000, 1 << 24, 1 << 19
#: Distinct runs between blanks that a task remembers.
MEMO = 800_000

#: White space as the tokenizer sees it, and the pattern by which it splits words off.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

SPLIT = "kind int, block long, part int, doc_ids array<long>, sizes array<int>, places binary, words binary, decoded string"
_SPLIT = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("places", pa.binary()), ("words", pa.binary()), ("decoded", pa.string())]
)


class Words(dict):
    """The words of runs between blanks, as packed places in the list of distinct words so far.

    Words are written as the tokenizer's merges take them: normalised, lower case, a letter for each byte.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else re.compile("(?!)")
        self.cut = regex.compile(PATTERN)
        self.odd = re.compile(r"[^\x20-\x7e\xa1-\u052f]")  # not among the scripts whose letters are settled
        self.blank = re.compile(f"[^{BLANKS}]+")
        self.control = re.compile("[\x1c-\x1f]")  # blanks for str.split alone
        self.place: dict[str, int] = {}

    def reset(self) -> None:
        self.clear()
        self.place = {}

    def pieces(self, run: str) -> list[str]:
        if self.odd.search(run):
            return [p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(run))]
        low = run.lower() if run.isascii() else "".join([c.lower() for c in unicodedata.normalize("NFC", run)])
        found = self.cut.findall(low)
        return found if low.isascii() else [p if p.isascii() else self._letters(p) for p in found]

    def _letters(self, word: str) -> str:
        return self.whole.pre_tokenizer.pre_tokenize_str(word)[0][0]

    def __missing__(self, run: str) -> bytes:
        place = self.place
        if run.isascii() and run.isalpha():  # most runs
            found = [run.lower()]
        else:
            found = []
            for k, part in enumerate(self.special.split(run)):  # every other part is a control string
                found += [part] if k % 2 else self.pieces(part) if part else []
        got = self[run] = np.array([place.setdefault(w, len(place)) for w in found], "<u4").tobytes()
        return got

    def places(self, text: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        runs = self.blank.findall(text) if self.control.search(text) else text.split()
        return b"".join([self[r] for r in runs])


class Codes:
    """The ids of distinct words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.merges = whole.model
        self.special = {t.content: [i] for i, t in whole.get_added_tokens_decoder().items()}

    def __call__(self, word: str) -> list[int]:
        return self.special[word] if word in self.special else [t.id for t in self.merges.tokenize(word)]


def split_words(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Blocks of documents: rows of kind 0 have the distinct words of a block in one hash bucket (part) with their places
    in the block; rows of kind 1 have documents, with their numbers of words and the places of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_state(f"words of {tokenizer}", lambda: Words(tokenizer))
        words.reset()
        block, part, ids, sizes, held, n, total = TaskContext.get().partitionId() << 24, 0, [], [], [], 0, 0

        def row() -> dict:
            return {"kind": 1, "block": block, "part": part, "doc_ids": ids, "sizes": sizes, "places": pack(np.frombuffer(b"".join(held), "<u4")), "words": None}

        def close() -> Iterator[pa.RecordBatch]:
            own = list(words.place)
            bucket = np.array([zlib.crc32(w.encode()) % BUCKETS for w in own], np.int64)
            order = np.argsort(bucket, kind="stable")
            rows = []
            for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if own else []:
                rows.append({"kind": 0, "block": block, "part": int(bucket[at[0]]), "doc_ids": None, "sizes": None, "places": pack(at), "words": squeeze([own[k] for k in at])})
            yield pa.RecordBatch.from_pylist(rows, _SPLIT)
            words.reset()

        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                held.append(words.places(text.as_py() or ""))
                ids.append(doc)
                sizes.append(len(held[-1]) // 4)
                n += sizes[-1]
                if n >= ROW_WORDS or len(ids) >= 20_000:
                    yield pa.RecordBatch.from_pylist([row()], _SPLIT)
                    part, ids, sizes, held, n, total = part + 1, [], [], [], 0, total + n
                    if len(words.place) >= BLOCK_WORDS or total >= BLOCK_TOTAL:
                        yield from close()
                        block, part, total = block + 1, 0, 0
        if ids:
            yield pa.RecordBatch.from_pylist([row()], _SPLIT)
        if ids or part:
            yield from close()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SPLIT)


def encode_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """block, part, places, sizes (how many ids each word has) and ids (of all words in a row, and packed as words) of the rows of kind 0."""
    schema = "block long, part int, places binary, sizes array<int>, words binary, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, bucket, known = worker_state(f"codes of {tokenizer}", lambda: Codes(tokenizer)), None, {}
        for b in batches:
            sizes, flat = [], []
            for part, own in zip(b["part"].to_pylist(), b["words"].to_pylist(), strict=True):
                if part != bucket:
                    bucket, known = part, {}
                got = []
                for w in loose(own):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = code(w)
                    got.append(ids)
                sizes.append([len(x) for x in got])
                flat.append([i for ids in got for i in ids])
            cols = [b["block"], b["part"], b["places"], pa.array(sizes, pa.list_(pa.int32())), pa.array([pack(np.array(x, "<u4")) for x in flat], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(flat, pa.list_(pa.int32()))], ["block", "part", "places", "sizes", "words", "ids"])

    return words.repartition("part").sortWithinPartitions("part", "block").mapInArrow(run, schema)


def encode(docs: DataFrame, tokenizer: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids, the token ids of each text of docs (doc_id, text), as the tokenizers library gives them without special tokens.

    decoded: also what the ids decode to, with special tokens, for a file without a decoder: their pieces with a blank between.
    tokenizer is the path, on every executor, of a byte-level BPE file of that library that splits words off as PATTERN does.
    A null, empty or blank text has no ids. Each row is encoded by itself, so rows with a null or repeated doc_id come back
    one by one; an empty table gives no rows; other columns are not read. A text is not cut: the longest bounds a block.
    """
    blocks, buckets = stash_by(split_words(docs, tokenizer), "words", "block")
    lists = encode_words(blocks.where("kind = 0").select("block", "part", "places", "words"), tokenizer)
    lists = decode(lists, tokenizer) if decoded else lists.withColumn("decoded", F.lit(None).cast("string"))
    lists = lists.select(F.lit(0).alias("kind"), "block", "part", F.lit(None).cast("array<bigint>").alias("doc_ids"), "sizes", "places", "words", "decoded")
    # no column may change on the side in buckets, or Spark loses sight of them
    met = blocks.where("kind = 1").unionByName(lists.select(blocks.columns).repartition(buckets, "block"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's documents, with the ids of its words where these stood. Documents wait, packed, until the whole list is there."""
        lists, pieces, docs = [], [], []
        for b in batches:
            for r in b.to_pylist():
                if r["kind"]:
                    docs.append((r["doc_ids"], r["sizes"], r["places"]))
                    continue
                lists.append((unpack(r["places"]), np.array(r["sizes"], np.int64), unpack(r["words"])))
                if r["decoded"]:
                    pieces += r["decoded"].split(" ")
        at, many, flat = map(np.concatenate, zip(*lists, strict=True)) if lists else (np.zeros(0, np.int64),) * 3
        first, size, said, lists, flat = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), [""] * len(at), [], flat.astype(np.int32)
        first[at], size[at] = np.cumsum(many) - many, many
        if decoded:
            for place, a, n in zip(at.tolist(), first[at].tolist(), many.tolist(), strict=True):
                said[place] = pieces[a] if n == 1 else " ".join(pieces[a : a + n])
            del pieces
        for doc_ids, sizes, places in docs:
            word, ends = unpack(places), np.concatenate([[0], np.cumsum(sizes)])
            many = size[word]
            offsets = np.concatenate([[0], np.cumsum(many)])[ends]
            cols = [pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[spans(first[word], many)]))]
            if decoded:
                words = [said[w] for w in word.tolist()]
                cols.append(pa.array([" ".join(words[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()))
            yield pa.record_batch(cols, ["doc_id", "ids", "decoded"][: len(cols)])

    schema = "doc_id long, ids array<int>" + ", decoded string" * decoded
    return met.groupBy("block").applyInArrow(fill, schema)


def id_to_piece(spark: SparkSession, tokenizer: str) -> DataFrame:
    """id and piece of every token of a file without a decoder."""
    with open(tokenizer, encoding="utf-8") as f:
        file = json.load(f)
    if file.get("decoder"):
        raise ValueError(f"{tokenizer} has a decoder; only files that decode to pieces in a row are read")
    pieces = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
    return spark.createDataFrame(pa.table({"id": pa.array(list(pieces), pa.int32()), "piece": pa.array(list(pieces.values()), pa.string())}))


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """rows with decoded, the text of each row's ids, in place of the ids: their pieces in order, with a blank between, as the
    library decodes a file without a decoder, special tokens included.

    Ids that the vocabulary lacks, and nulls among the ids, are left out, as the library does; null or empty ids give an empty
    text. Every row comes back, repeated ones too; a column named decoded is replaced. The table of pieces is as large as the
    vocabulary file, so it is broadcast: the join keeps the order of the ids, which the grouping checks.
    """
    own = [c for c in rows.columns if c != ids and c.lower() != "decoded"]
    pos, token, head = fresh(rows, "pos"), fresh(rows, "token"), fresh(rows, "head")
    each = rows.select(F.struct(*own).alias(head), F.posexplode_outer(ids).alias(pos, token))
    each = each.select(F.when(F.coalesce(pos, F.lit(0)) == 0, F.col(head)).alias(head), F.coalesce(pos, F.lit(0)).alias(pos), F.col(token).cast("int").alias("id"))
    pieces = F.broadcast(id_to_piece(rows.sparkSession, tokenizer))
    joined = each.join(pieces, "id", "left").select(head, pos, "piece")
    schema = StructType([*rows.select(*own).schema.fields, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, held, last = None, [], -1  # the row whose pieces are still coming, and these

        def close(heads: pa.Array, pieces: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pieces)
            decoded = pc.binary_join(_without_nulls(lists), " ")
            return pa.RecordBatch.from_arrays([*heads.flatten(), decoded], [*own, "decoded"])

        for b in batches:
            if not b.num_rows:
                continue
            place = b[pos].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(place == 0)
            before = np.concatenate([[last], place[:-1]])
            if ((place != 0) & (place != before + 1)).any():
                raise RuntimeError("the join with the pieces has changed the order of the ids")
            last = int(place[-1])
            if not len(starts):
                held.append(b["piece"])
                continue
            if heads is not None:
                held.append(b["piece"].slice(0, int(starts[0])))
                pieces = pa.concat_arrays(held)
                yield close(heads, pieces, np.array([len(pieces)]))
            at, to = int(starts[0]), int(starts[-1])
            if to > at:
                yield close(b[head].take(pa.array(starts[:-1])), b["piece"].slice(at, to - at), np.diff(starts))
            heads, held = b[head].slice(to, 1), [b["piece"].slice(to)]
        if heads is not None:
            pieces = pa.concat_arrays(held)
            yield close(heads, pieces, np.array([len(pieces)]))

    return joined.mapInArrow(run, schema)


def _without_nulls(lists: pa.ListArray) -> pa.ListArray:
    if not lists.values.null_count:
        return lists
    here = pc.is_valid(lists.values)
    kept = np.concatenate([[0], np.cumsum(here.to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(kept[lists.offsets.to_numpy()], pa.int32()), lists.values.filter(here))
