"""Operator 11: vector code compression (product quantization) with LAESA pivots.

Vectors of integers are cut into parts; each part position has a codebook, refined in rounds of assignment and averaging.
The distances of every part to a few fixed pivots are computed once and kept. Each round needs the distances of its entries
to the pivots only: by the triangle inequality their differences are lower bounds, by which the entries are tried in order
until no bound is below the best distance found. Distances that decide are exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, stash

#: Parts that one round of array work takes in.
SLICE = 1 << 14


@dataclass(frozen=True)
class Codes:
    """Parts of a vector, entries of a codebook, rounds, steps of a component in 1, and fixed pivots."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    steps: int = 256
    pivots: int = 4


def finite(vectors: DataFrame) -> DataFrame:
    """The rows whose embedding is there and has finite components only."""
    return vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _integers(embeddings: pa.Array, codes: Codes) -> np.ndarray:
    """Parts as integers, of shape (vectors, parts, components of a part)."""
    size = embeddings.value_lengths().to_numpy(zero_copy_only=False)
    wide = int(size[0])
    if (size != wide).any() or wide % codes.parts:
        raise ValueError(f"vectors must have one length, a multiple of {codes.parts}")
    x = np.floor(embeddings.flatten().to_numpy().astype(np.float64) * codes.steps).reshape(len(size), codes.parts, wide // codes.parts)
    if x.size and np.abs(x).max() >= 2**28 / max(1, wide) ** 0.5:
        raise ValueError("components so large that squared distances pass 64 bits")
    return x.astype(np.int64)


def _far(entries: np.ndarray, pivots: int) -> np.ndarray:
    """The pivots of one part position: the first entry, then each time the one farthest from those before."""
    taken = [0]
    near = ((entries - entries[0]) ** 2).sum(axis=1)
    for _ in range(min(pivots, len(entries)) - 1):
        taken.append(int(np.argmax(near)))
        near = np.minimum(near, ((entries - entries[taken[-1]]) ** 2).sum(axis=1))
    return entries[taken]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties to the lower index) and its squared distance.

    parts: (n, components); to_pivots: their squared distances (n, pivots); entries and pivots of this part position.
    """
    between = np.sqrt(((entries[:, None, :] - pivots[None]) ** 2).sum(axis=2))  # entry by pivot
    bound = np.zeros((len(parts), len(entries)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(np.sqrt(to_pivots[:, p])[:, None] - between[:, p]), out=bound)
    bound = (bound * (1 - 1e-12) - 1e-9).clip(0) ** 2  # below the true bound in spite of rounding
    order = np.argsort(bound, axis=1, kind="stable")
    best, at, open_ = np.full(len(parts), np.iinfo(np.int64).max), np.zeros(len(parts), np.int64), np.arange(len(parts))
    for k in range(len(entries)):
        e = order[open_, k]
        still = bound[open_, e] <= best[open_]  # ties may still win by their index
        open_, e = open_[still], e[still]
        if not len(open_):
            break
        d = ((parts[open_] - entries[e]) ** 2).sum(axis=1)
        better = (d < best[open_]) | (d == best[open_]) & (e < at[open_])
        best[open_[better]], at[open_[better]] = d[better], e[better]
    return at, best


def _assigned(b: pa.RecordBatch, codebooks: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Part position, its parts, their entries and squared distances, for the kept vectors of a batch."""
    parts = b["parts"].flatten().to_numpy().reshape(b.num_rows, len(codebooks), -1) if codebooks.shape[2] else np.zeros((b.num_rows, *codebooks.shape[::2]), np.int64)
    away = b["away"].flatten().to_numpy().reshape(b.num_rows, len(codebooks), -1)
    for p in range(len(codebooks)):
        yield p, parts[:, p], *nearest(parts[:, p], away[:, p], codebooks[p], pivots[p])


def compress(vectors: DataFrame, codes: Codes = Codes()) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, entries (of the codebooks, by part) and error (squared distance) of the vectors (vec_id, embedding, label), and the codebooks
    (part, entry, component).

    Rows without an embedding, or with a component that is null or not finite, are left out; the others come back one by one, rows with a null or
    repeated vec_id too. Codebooks begin with the parts of the smallest vec_ids (null last, ties by embedding); with fewer rows than entries they have as
    many as there are rows. A tie between entries goes to the lower one; an unused entry stays. An empty table gives no rows and empty codebooks. Vectors
    must have one length, a multiple of codes.parts, and components below about 2**20, or there is an error. Other columns are not read.
    """
    kept = finite(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), "label"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(codes.entries).select("embedding").toArrow()["embedding"].combine_chunks()
    label = kept.schema["label"].dataType.simpleString()
    if not len(first):
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {label}, entries array<int>, error long"), np.zeros((codes.parts, 0, 0), np.int64)
    codebooks = _integers(first, codes).swapaxes(0, 1).copy()
    pivots = np.stack([_far(c, codes.pivots) for c in codebooks])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                x = _integers(part["embedding"], codes)
                if x.shape[2] != codebooks.shape[2]:
                    raise ValueError("vectors must have one length")
                away = ((x[:, :, None, :] - pivots[None]) ** 2).sum(axis=3)
                flat = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), v[0].size).cast(pa.list_(pa.int64()))
                yield pa.record_batch([part["vec_id"], part["label"], flat(x), flat(away)], ["vec_id", "label", "parts", "away"])

    measured = stash(kept.mapInArrow(measure, f"vec_id long, label {label}, parts array<long>, away array<long>"), "vectors")

    def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
        many, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                for p, x, e, _ in _assigned(b.slice(at, SLICE), books, pivots):
                    many[p] += np.bincount(e, minlength=books.shape[1])
                    np.add.at(total[p], e, x)
        p, e = np.nonzero(many)
        out = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * books.shape[2], pa.int32()), pa.array(total[p, e].reshape(-1)))
        yield pa.record_batch([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(many[p, e]), out], ["part", "entry", "many", "total"])

    for _ in range(codes.rounds):
        used = measured.mapInArrow(partial(sums, books=codebooks), "part int, entry int, many long, total array<long>").groupBy("part", "entry")
        each = [F.sum(F.col("total")[k]).alias(f"c{k}") for k in range(codebooks.shape[2])]
        codebooks = codebooks.copy()
        for r in used.agg(F.sum("many").alias("many"), *each).collect():  # as many rows as there are entries
            codebooks[r.part, r.entry] = [r[f"c{k}"] // r.many for k in range(codebooks.shape[2])]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part, found = b.slice(at, SLICE), []
                error = np.zeros(part.num_rows, np.int64)
                for _, _, e, d in _assigned(part, codebooks, pivots):
                    found.append(e)
                    error += d
                entries = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(found, axis=1).reshape(-1), pa.int32()), codes.parts).cast(pa.list_(pa.int32()))
                yield pa.record_batch([part["vec_id"], part["label"], entries, pa.array(error)], ["vec_id", "label", "entries", "error"])

    return measured.mapInArrow(assign, f"vec_id long, label {label}, entries array<int>, error long"), codebooks


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of the errors of its label (null is one)."""
    coded = stash(coded, "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    near = broadcast_if_small(sums, 32) if coded.schema["label"].dataType.simpleString() in ("int", "bigint") else sums
    return coded.join(near, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def codebook_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of the components by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()
