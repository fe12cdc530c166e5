"""Operator 3: benchmark decontamination by the q-gram lemma.

A region within e edits of an item of m characters shares at least m + 1 - q (e + 1) of its q-grams, and their
hits lie on diagonals (place in the text less place in the item) at most e apart. Hits are counted in diagonal
bands 2 w wide that overlap by w > e; a band that reaches the bound is a region, and banded alignment decides.
q is 10, or less where an item is so short that the bound would be none.

A q-gram that stands many times in a row, as in blanks or dashes, is counted by its runs: two runs share a trapezoid of hits
over their diagonals, of which each band gets its part. Bands whose stretch of text lacks more letters of the item than it
may have edits are dropped before the alignment. What repeats every few letters for longer than any item is looked at as far
as items reach into it from both ends: a region inside is the same as one at its beginning.

Texts are compared letter by letter with A-Z lower-cased and white space as blanks, which keeps offsets. Long texts
are looked at in overlapping windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import spans
from .common import worker_state

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
#: Characters of benchmark text that one pass over the documents looks for; a larger benchmark takes more passes.
BLOCK_CHARS = 2_000_000
#: Characters of text that one round of array work takes in; longer texts are looked at in windows of so many.
SLICE = 400_000
#: Classes of letters by which a band's text is compared with its item before the alignment.
CLASSES = 32
#: Hits for each letter of a text beyond which what repeats in it is cut short first, and the longest repeat that is cut.
LOAD, PERIOD = 4, 16


class Heavy(Exception):
    """A text shares more q-grams with the items than texts that don't repeat themselves."""


@dataclass(frozen=True)
class Lemma:
    """q-gram length, edits allowed per hundred characters of an item, and the characters below which an item must stand as whole words."""

    q: int = 10
    percent: int = 8
    words_below: int = 20

    def edits(self, m: int) -> int:
        """Edits allowed for an item of m characters."""
        return 0 if m < self.words_below else m * self.percent // 100

    def gram(self, m: int) -> int:
        """The longest q-gram, up to q, of which a region within the edits must share one."""
        return min(self.q, m // (self.edits(m) + 1))

    def bound(self, m: int) -> int:
        return m + 1 - self.gram(m) * (self.edits(m) + 1)


def letters(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    a[(a >= 65) & (a <= 90)] += 32
    a[(a >= 9) & (a <= 13)] = 32
    return a


def grams(a: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of the q-grams at each place."""
    n = len(a) - q + 1
    if n <= 0:
        return np.zeros(0, _U)
    power = lambda k: _U(pow(int(_BASE), k, 2**64))
    have, size = {1: (a.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93)}, 1
    while size * 2 <= q:
        h = have[size]
        have[size * 2] = h[: len(h) - size] + power(size) * h[size:]
        size *= 2
    out, at = np.zeros(n, _U), 0
    for s in sorted(have, reverse=True):
        if q & s:
            out += power(at) * have[s][at : at + n]
            at += s
    return out ^ (out >> _U(29))


class Index:
    """The q-grams of one block of items, for one q."""

    def __init__(self, items: list[tuple[int, np.ndarray]], q: int, lemma: Lemma):
        self.q, self.items = q, items
        runs = [runs_of(g) for g in (grams(a, q) for _, a in items)]
        self.key, self.place, self.length = (np.concatenate(x) for x in zip(*runs, strict=True))
        self.item = np.repeat(np.arange(len(items)), [len(k) for k, *_ in runs])
        order = np.argsort(self.key, kind="stable")
        self.key, self.item, self.place, self.length = (x[order] for x in (self.key, self.item, self.place, self.length))
        self.only, self.first, self.many = np.unique(self.key, return_index=True, return_counts=True)
        self.bits = min(26, max(16, int(len(self.only) * 64).bit_length()))
        self.sieve = np.zeros(1 << self.bits, bool)
        self.sieve[self.only >> _U(64 - self.bits)] = True
        self.bound = np.array([lemma.bound(len(a)) for _, a in items])
        self.width = np.array([lemma.edits(len(a)) + 1 for _, a in items])
        self.size = np.array([len(a) for _, a in items])
        self.letters = np.stack([np.bincount(classes(a), minlength=CLASSES) for _, a in items])

    def hits(self, a: np.ndarray, most: int | None = None) -> tuple[np.ndarray, ...]:
        """Where runs of a shared q-gram begin in a and in an item, their lengths, and the item: place, length, item, place, length."""
        g = grams(a, self.q)
        at = np.flatnonzero(self.sieve[g >> _U(64 - self.bits)])
        k = np.minimum(np.searchsorted(self.only, g[at]), len(self.only) - 1)
        real = self.only[k] == g[at]
        at, k = at[real], k[real]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(k) != 0)])) if len(at) else at
        length, at, k = np.diff(np.append(new, len(at))), at[new], k[new]
        many = self.many[k]
        if most is not None and (many * length).sum() > most:
            raise Heavy
        to = spans(self.first[k], many)
        return np.repeat(at, many), np.repeat(length, many), self.item[to], self.place[to], self.length[to]

    def regions(self, a: np.ndarray, row: np.ndarray, most: int | None = None) -> tuple[np.ndarray, ...]:
        """Row, item, lowest diagonal and least number of edits of each band of a that reaches the item's bound; row: of each place of a.

        Raises Heavy where there are more hits to count than most.
        """
        at, n, item, place, m = self.hits(a, most)
        w = self.width[item]
        low = at - place - m + 1 + len(a)  # above 0
        first = low // w
        many = (low + n + m - 2) // w - first + 1
        k = np.repeat(np.arange(len(at)), many)
        cell = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + first[k]  # w diagonals wide
        upto = lambda d: shared(d - low[k], n[k], m[k])
        weight = upto((cell + 1) * w[k] - 1) - upto(cell * w[k] - 1)
        key = np.stack([row[at[k]], item[k], cell])
        order = np.lexsort(key[::-1])
        key, weight = key[:, order], weight[order]
        if not len(weight):
            return (np.zeros(0, int),) * 4
        new = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        total, (r, i, c) = np.add.reduceat(weight, new), key[:, new]
        # a band is two cells: each with the next, and each that has none before it with that
        after = np.append((r[1:] == r[:-1]) & (i[1:] == i[:-1]) & (c[1:] == c[:-1] + 1), False)
        band = total + np.where(after, np.append(total[1:], 0), 0)
        alone = np.concatenate([[True], ~after[:-1]])
        r, i, c = (np.concatenate([x, x[alone]]) for x in (r, i, c))
        c[len(total) :] -= 1
        keep = np.concatenate([band, total[alone]]) >= self.bound[i]
        order = np.lexsort((c[keep], i[keep], r[keep]))
        r, i, c = (x[keep][order] for x in (r, i, c))
        low = c * self.width[i] - len(a)
        lacks = self._lacking(a, row, r, i, low)
        keep = lacks < self.width[i]
        return r[keep], i[keep], low[keep], lacks[keep]

    def _lacking(self, a: np.ndarray, row: np.ndarray, r: np.ndarray, i: np.ndarray, low: np.ndarray) -> np.ndarray:
        """How many letters of the item the text beside each band lacks: no region there has fewer edits."""
        e = self.width[i] - 1
        start = np.maximum(np.searchsorted(row, r), low - e - 1)
        stop = np.minimum(np.searchsorted(row, r, "right"), low + self.size[i] + 4 * e + 3)
        kind, lacks = classes(a), np.zeros(len(r), np.int64)
        for c in np.flatnonzero(self.letters.any(axis=0)).tolist() if len(r) else ():
            before = np.concatenate([[0], np.cumsum(kind == c)])
            lacks += np.maximum(0, self.letters[i, c] - (before[np.maximum(stop, start)] - before[start]))
        return lacks


def classes(a: np.ndarray) -> np.ndarray:
    """Letters in a few classes."""
    return (a * np.uint32(2654435761) >> np.uint32(27)).astype(np.int64)


def runs_of(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, place and length of each run of equal neighbours."""
    new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return g[new], new, np.diff(np.append(new, len(g)))


def shared(d: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Pairs of a place of n and one of m on the first d + 1 of their n + m - 1 diagonals."""
    corner = lambda z: np.where(z >= 0, (z + 1) * (z + 2) // 2, 0)
    d = np.minimum(d, n + m - 2)
    return corner(d) - corner(d - n) - corner(d - m)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits between the item and a stretch of text on diagonals low to high: (edits, start, end), or None above most.

    Banded: cell d of a row is the text place item place + low + d.
    """
    m, width = len(item), high - low + 1
    big = m + 1
    places = np.arange(width)
    inside = lambda i: (places + low + i >= 0) & (places + low + i <= len(text))
    cost = np.where(inside(0), 0, big)
    start = places + low
    for i in range(1, m + 1):
        t = places + low + i - 1  # the letter that a step along the diagonal takes
        same = np.zeros(width, bool)
        ok = (t >= 0) & (t < len(text))
        same[ok] = text[t[ok]] == item[i - 1]
        along = cost + np.where(ok & same, 0, np.where(ok, 1, big))
        up = np.append(cost[1:] + 1, big)  # the item's letter is missing from the text
        began = np.where(along <= up, start, np.append(start[1:], 0))
        new = np.where(inside(i), np.minimum(along, up), big)
        run = np.minimum.accumulate(new - places)  # text letters that the item lacks
        src = np.maximum.accumulate(np.where(new - places == run, places, 0))
        cost, start = np.minimum(run + places, big), began[src]
        if cost.min() > most:
            return None
    d = int(np.argmin(cost))
    return (int(cost[d]), max(0, int(start[d])), d + low + m) if cost[d] <= most else None


def exact(item: np.ndarray, text: np.ndarray, low: int, high: int, words: bool) -> tuple[int, int, int] | None:
    """The first whole occurrence of the item that starts on places low to high; words: with no letter or digit beside it."""
    low, m = max(low, 0), len(item)
    part = text[low : high + m]
    if len(part) < m:
        return None
    beside = lambda k: 0 <= k < len(text) and chr(text[k]).isalnum()
    for at in (low + np.flatnonzero((np.lib.stride_tricks.sliding_window_view(part, m) == item).all(axis=1))).tolist():
        if not words or not beside(at - 1) and not beside(at + m):
            return 0, at, at + m
    return None


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items (item_id, text) in blocks of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("length(trim(text)) > 0").distinct()
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r.text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


class Scan:
    """Looks for a block of items in batches of texts."""

    def __init__(self, items: list[tuple[int | None, str]], lemma: Lemma):
        self.lemma, by_q = lemma, {}
        for i, t in items:
            a = letters(t.strip())
            if len(a):
                by_q.setdefault(lemma.gram(len(a)), []).append((i, a))
        self.indexes = [Index(own, q, lemma) for q, own in by_q.items()]
        # a region lies whole in one window, with what the alignment looks at beside it
        self.overlap = 2 * max((len(a) + 8 * lemma.edits(len(a)) + 8 for own in by_q.values() for _, a in own), default=0)

    def windows(self, texts: pa.Array) -> Iterator[list[tuple[int, int, bool, np.ndarray]]]:
        """Row, offset, whether the text ends here, and letters of windows of about SLICE characters together."""
        step, held, chars = SLICE + self.overlap, [], 0
        for row, x in enumerate(texts):
            text, at = x.as_py() or "", 0
            while at < len(text):
                last = at + step >= len(text)
                held.append((row, at, last, letters(text[at : at + step])))
                chars += len(held[-1][3]) + 1
                at = len(text) if last else at + SLICE
                if chars >= SLICE:
                    yield held
                    held, chars = [], 0
        if held:
            yield held

    def find(self, texts: pa.Array) -> list[tuple[int, int | None, int, int, int]]:
        """Row, item, edits, start and end of the best region of each item in each text."""
        best: dict[tuple, tuple[int, int, int]] = {}
        for held in self.windows(texts):
            self._look(held, best)
        return [(r, i, *got) for (r, i, _), got in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is not None, x[0][1] or 0, x[1]))]

    def _short(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """The text with stretches that repeat every few letters cut to what items reach into from both ends, and the place that each letter had."""
        places, whole = np.arange(len(text)), len(text)
        for p in range(1, PERIOD + 1):
            same, first, length = runs_of(text[p:] == text[:-p])
            keep = np.ones(len(text), bool)
            for k in np.flatnonzero(same & (length > 2 * self.overlap + p)).tolist():
                spare = (int(length[k]) - 2 * self.overlap) // p * p
                keep[first[k] + self.overlap : first[k] + self.overlap + spare] = False
            text, places = text[keep], places[keep]
        return text, places if len(text) < whole else None

    def _look(self, held: list[tuple[int, int, bool, np.ndarray]], best: dict[tuple, tuple[int, int, int]], short: bool = False) -> None:
        held, had = list(held), [None] * len(held)
        if short:
            for k, (*x, t) in enumerate(held):
                t, had[k] = self._short(t)
                held[k] = (*x, t)
        gap = np.array([0xFFFFFFFF], np.uint32)
        joined = np.concatenate([x for *_, t in held for x in (t, gap)])
        window = np.repeat(np.arange(len(held)), [len(t) + 1 for *_, t in held])
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for *_, t in held])])
        try:
            found = [index.regions(joined, window, None if short else LOAD * len(joined)) for index in self.indexes]
        except Heavy:
            return self._look(held, best, True)
        for index, regions in zip(self.indexes, found, strict=True):
            for w, i, low, least in zip(*(x.tolist() for x in regions), strict=True):
                (item_id, item), (row, offset, last, text) = index.items[i], held[w]
                e = int(index.width[i]) - 1
                low -= int(begin[w])
                if (low + 2 * e + 2 < -e) or low > len(text):
                    continue
                # items without an id are told apart by what they say
                key = (row, item_id, item.tobytes() if item_id is None else b"")
                if key in best and best[key][0] <= least:
                    continue
                words = len(item) < self.lemma.words_below
                got = exact(item, text, low, low + 2 * e + 1, words)
                if words and got and (got[1] == 0 and offset or got[2] == len(text) and not last):
                    got = None  # at a window's edge; the window beside it sees what follows
                if got is None and not words:
                    got = align(item, text, low - e, low + 3 * e + 1, e)
                if got:
                    if had[w] is not None:
                        got = (got[0], int(had[w][got[1]]), int(had[w][got[2] - 1]) + 1)
                    got = (got[0], got[1] + offset, got[2] + offset)
                    if key not in best or got[:2] < best[key][:2]:
                        best[key] = got


def contaminated(docs: DataFrame, benchmark: DataFrame, lemma: Lemma = Lemma()) -> DataFrame:
    """doc_id, item_id, edits, start and end of the best region of each item in each text of docs (doc_id, text).

    Offsets are code points, end exclusive; ties go to the first region. An item below lemma.words_below characters
    counts where it stands without edits and with no letter or digit beside it. Items that share an item_id are one
    item; those without are one each. Null, empty and blank texts and items have no regions, and an empty table gives no
    rows. Rows that repeat are looked at each; other columns are not read. Benchmarks of any size are taken in blocks,
    one pass over docs each.
    """
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, edits long, start long, end long"

    def run(batches: Iterator[pa.RecordBatch], sent, name: str) -> Iterator[pa.RecordBatch]:
        scan = worker_state(name, lambda: Scan(sent.value, lemma))
        for b in batches:
            found = scan.find(b["text"])
            rows, *rest = zip(*found, strict=True) if found else [()] * 5
            cols = [b["doc_id"].take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in rest)]
            yield pa.record_batch(cols, ["doc_id", "item_id", "edits", "start", "end"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    for block in _blocks(benchmark):
        found = rows.mapInArrow(partial(run, sent=spark.sparkContext.broadcast(block), name=f"scan {uuid.uuid4().hex}"), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, lemma: Lemma = Lemma()) -> DataFrame:
    """The rows of docs that hold no benchmark item, as contaminated finds them.

    Each row is judged by its own text: rows with a null or repeated doc_id stay or go one by one. A null or empty text
    stays. All columns come back as they are.
    """
    own = [f"own_{i}" for i in range(len(docs.columns))]
    text = own[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch], sent, name: str) -> Iterator[pa.RecordBatch]:
        scan = worker_state(name, lambda: Scan(sent.value, lemma))
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            clean[[r for r, *_ in scan.find(b[text])]] = False
            yield b.filter(pa.array(clean))

    rows = docs.toDF(*own)
    for block in _blocks(benchmark):
        rows = rows.mapInArrow(partial(run, sent=docs.sparkSession.sparkContext.broadcast(block), name=f"scan {uuid.uuid4().hex}"), rows.schema)
    return rows.toDF(*docs.columns)
