"""Operator 8: language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary, learned from labelled texts. The
likelihood of a word is the sum over all its segmentations into pieces, found by the forward algorithm; a text's
is the product over its words. Words are scored in blocks of distinct ones, and each once per task and memo.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import worker_state

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
SPACE = "▁"
#: Distinct words whose scores a task remembers.
MEMO = 400_000
#: Log probability, in any language, of a character that the vocabulary lacks.
UNKNOWN = -18.0


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    hashes: np.ndarray  # of the pieces, ascending
    probs: np.ndarray  # (pieces, languages)
    longest: int
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
    return h


def piece_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """lang, piece (its id) and n: how often the vocabulary's own segmentation uses the piece in each language's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp, got = sentencepiece.SentencePieceProcessor(model_file=vocabulary), {}
        for b in batches:
            for a in range(0, b.num_rows, 100):
                part = b.slice(a, 100)
                encoded = sp.encode([t.lower() for t in part["text"].to_pylist()], num_threads=1)
                for lang, ids in zip(part["lang"].to_pylist(), encoded, strict=True):
                    got.setdefault(lang, Counter()).update(ids)
        rows = [(lang, i, n) for lang, c in got.items() for i, n in c.items()]
        if rows:
            lang, i, n = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(lang), pa.array(i, pa.int32()), pa.array(n, pa.int64())], ["lang", "piece", "n"])

    counts = docs.select("lang", "text").mapInArrow(run, "lang string, piece int, n long")
    return counts.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, vocabulary: str, most_docs: int = 20_000, smooth: float = 0.1) -> Model:
    """Learn from rows (doc_id, text, lang) with a text and a lang, from about most_docs of them if there are more.

    The sample is drawn by a hash of doc_id. What is collected is one count per piece and language.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    share = min(1.0, most_docs / max(1, rows.select("doc_id").count()))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = piece_counts(sample, vocabulary).collect()
    languages = tuple(sorted({r.lang for r in counts}))
    ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    place = {i: k for k, i in enumerate(ids)}
    n = np.full((len(ids), len(languages)), smooth)
    for r in counts:
        if r.piece in place:
            n[place[r.piece], languages.index(r.lang)] += r.n
    pieces = [sp.id_to_piece(i) for i in ids]
    hashes = np.array([_hash(p) for p in pieces], _U)
    order = np.argsort(hashes)
    probs = n / n.sum(axis=0) if languages else n
    return Model(languages, hashes[order], probs[order], max(map(len, pieces)))


class WordScores:
    """Log likelihoods of words in each language of a model."""

    def __init__(self, model: Model):
        self.model, self.known, self.rows = model, {}, np.zeros((0, len(model.languages)))
        self.letter = regex.compile(r"\p{L}")

    def _forward(self, words: list[str]) -> np.ndarray:
        """Words of one length: the forward algorithm over all of them at once, rescaled as it goes."""
        m, size, k = self.model, len(words[0]) + 1, len(self.model.languages)
        text = np.frombuffer("".join(SPACE + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size).astype(_U) + _U(1)
        alpha, scale = np.zeros((size + 1, len(words), k)), np.zeros((len(words), k))
        alpha[0] = 1.0
        rolled = np.zeros((size, len(words)), _U)  # rolled[a]: hash of the characters from a up to the current one
        for i in range(1, size + 1):
            first = max(0, i - m.longest)
            rolled[first:i] = rolled[first:i] * _BASE + text[:, i - 1]
            at = np.minimum(np.searchsorted(m.hashes, rolled[first:i]), len(m.hashes) - 1)
            hit = m.hashes[at] == rolled[first:i]
            for a in range(first, i):
                got = hit[a - first]
                if got.any():
                    alpha[i][got] += alpha[a][got] * m.probs[at[a - first][got]]
            lacks = ~hit[i - 1 - first]
            alpha[i][lacks] += alpha[i - 1][lacks] * np.exp(UNKNOWN)
            if i % 8 == 0 and i < size:
                top = alpha[i].copy()
                alpha[max(0, i - m.longest) : i + 1] /= top
                scale += np.log(top)
        return np.log(alpha[size]) + scale

    def score(self, texts: list[str]) -> np.ndarray:
        """Log likelihoods (texts, languages)."""
        if len(self.known) > MEMO:
            self.known, self.rows = {}, self.rows[:0]
        split = [t.lower().split() for t in texts]
        by_size: dict[int, list[str]] = {}
        for w in {w for s in split for w in s if w not in self.known}:
            by_size.setdefault(len(w), []).append(w)
        new = []
        for size, found in by_size.items():
            step = max(1, 2_000_000 // ((size + 2) * max(4, len(self.model.languages))))
            for a in range(0, len(found), step):
                part = found[a : a + step]
                new.append(self._forward(part))
                base = len(self.known)
                self.known.update((w, base + j) for j, w in enumerate(part))
        self.rows = np.concatenate([self.rows, *new])
        return np.array([self.rows[[self.known[w] for w in s]].sum(axis=0) for s in split])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs plus lang_pred and score (the posterior of lang_pred under equal priors, 0 to 1).

    A null text, an empty one, one without a letter, and any text if the model learned no language is "und" with
    score 0. Ties go to the first language by name. Every row is judged by itself, so that repeated rows get the same,
    and an empty table gives no rows. Texts of any length are scored whole. Columns of docs named lang_pred or score
    are replaced; all others stay as they are.
    """
    own = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    schema = StructType([*own.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, names = worker_state(f"word scores of {sent.value.name}", lambda: WordScores(sent.value)), sent.value.languages
        for b in batches:
            for a in range(0, b.num_rows, 250):
                part = b.slice(a, 250)
                texts = [t or "" for t in part[text].to_pylist()]
                pred, score = ["und"] * len(texts), [0.0] * len(texts)
                good = [i for i, t in enumerate(texts) if names and scorer.letter.search(t)]
                if good:
                    logs = scorer.score([texts[i] for i in good])
                    best = logs.argmax(axis=1)
                    sure = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    for i, k, s in zip(good, best, sure, strict=True):
                        pred[i], score[i] = names[k], float(s)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    return own.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: a quarter, by a checksum of doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, vocabulary: str, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text has a language: not "und", and of a score of at least least.

    The model learns from docs (doc_id, text, lang); with no labelled text in docs no row stays, nor does a null or
    empty text. Rows stay or go one by one, whatever their doc_id; repeated rows fare alike. All columns come back as
    they are, those named lang_pred or score included.
    """
    model = learn(docs.where(~held_out(F.col("doc_id"))), vocabulary)
    own = [f"own_{i}" for i in range(len(docs.columns))]  # so that no column bears a name of identify's
    judged = identify(docs.toDF(*own), model, own[docs.columns.index("text")])
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(own).toDF(*docs.columns)
