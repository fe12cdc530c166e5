"""Vectorised hashes of words and shingles, for use inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=_U) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}

#: Bytes of text that one round of array work takes in, unless a single word is longer.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + 1024)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _piece_hashes(b: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of lower-cased bytes b; edge marks bytes that begin a row."""
    blank = _BLANK[b]
    before, after = np.empty_like(blank), np.empty_like(blank)
    before[0], before[1:] = True, blank[:-1]
    before |= edge
    after[-1], after[:-1] = True, blank[1:] | edge[1:]
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    up, down = _power(len(b))
    total = np.zeros(len(b) + 1, _U)
    np.cumsum(_BYTE[b] * up, out=total[1:])
    return starts, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _PLACE[63])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and 64-bit hash of each word (runs of other than ASCII blanks, A-Z lower-cased); null as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    rows, hashes, at, last = [], [], int(offsets[0]), int(offsets[-1])
    while at < last:
        to = min(at + SLICE, last)
        if to < last:  # cut at a blank or where a row begins
            row = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            gap = np.flatnonzero(_BLANK[data[at:to]])
            cut = max(row if row > at else 0, at + int(gap[-1]) if len(gap) else 0)
            if cut > at:
                to = cut
            else:
                gap = np.flatnonzero(_BLANK[data[to:last]])
                nxt = int(offsets[np.searchsorted(offsets, to, "right")])
                to = min(nxt, to + int(gap[0]) if len(gap) else last)
        b = _LOWER[data[at:to]]
        edge = np.zeros(len(b), bool)
        inside = offsets[(offsets >= at) & (offsets < to)] - at
        edge[inside] = True
        starts, h = _piece_hashes(b, edge)
        rows.append(np.searchsorted(offsets, starts + at, "right") - 1)
        hashes.append(h)
        at = to
    return (np.concatenate(rows), np.concatenate(hashes)) if rows else (np.zeros(0, np.int64), np.zeros(0, _U))


def stretches(texts: pa.Array, most: int = 8 << 20) -> Iterator[pa.Array]:
    """The array in slices of at most so many bytes of text, one row at least."""
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its word shingles; fewer words than width make one shingle."""
    row, h = word_hashes(texts)
    count = np.bincount(row, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])
    n = max(len(h) - width + 1, 0)
    g = np.zeros(n, _U)
    for k in range(width):
        g += h[k : k + n] * _PLACE[k]
    g = mix(g)
    for i in range(len(texts)):
        a, c = first[i], count[i]
        if c >= width:
            yield np.unique(g[a : a + c - width + 1])
        elif c:
            yield mix((h[a : a + c] * _PLACE[:c]).sum(keepdims=True) + _PLACE[32 + c % 16])
        else:
            yield h[:0]
