"""A wavelet matrix over token ids: succinct bit planes with rank and select."""

from __future__ import annotations

import numpy as np
import zstandard

#: Bits between two entries of a plane's rank directory.
STRIDE = 512


class WaveletMatrix:
    """Bit planes from the highest bit down; each plane orders the sequence by the bits above it, zeros first.

    planes: packed bits; marks: ones before each stride; zeros: zeros of each plane.
    """

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], marks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.marks = n, zeros, planes, marks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        a, zeros, planes, marks = ids, [], [], []
        for b in range(bits - 1, -1, -1):
            one = (a & a.dtype.type(1 << b)) != 0
            plane = np.packbits(one, bitorder="little")
            plane = np.concatenate([plane, np.zeros(-len(plane) % (STRIDE // 8), np.uint8)])
            ones = np.bitwise_count(plane.view(np.uint64)).reshape(-1, STRIDE // 64).sum(axis=1, dtype=np.uint32)
            planes.append(plane)
            marks.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)]))
            low = a.compress(~one)  # several times as fast as a mask in brackets
            zeros.append(len(low))
            a = np.concatenate([low, a.compress(one)])
        return cls(len(ids), zeros, planes, marks)

    def pack(self) -> dict:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return {
            "n_tokens": self.n,
            "zeros": self.zeros,
            "planes": [squeeze(p.tobytes()) for p in self.planes],
            "marks": [squeeze(m.astype("<u4").tobytes()) for m in self.marks],
        }

    @classmethod
    def unpack(cls, row: dict) -> WaveletMatrix:
        loose = zstandard.ZstdDecompressor().decompress
        return cls(
            row["n_tokens"], list(row["zeros"]), [np.frombuffer(loose(p), np.uint8) for p in row["planes"]], [np.frombuffer(loose(m), "<u4") for m in row["marks"]]
        )

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        whole = self.marks[level][at // STRIDE].astype(np.int64)
        words = np.concatenate([self.planes[level].view(np.uint64), np.zeros(STRIDE // 64, np.uint64)])
        first = at // STRIDE * (STRIDE // 64)
        for k in range(STRIDE // 64):
            part = np.clip(at - (first + k) * 64, 0, 64)
            keep = np.where(part == 64, ~np.uint64(0), (np.uint64(1) << (part % 64).astype(np.uint64)) - np.uint64(1))
            whole += np.bitwise_count(words[first + k] & keep)
        return whole

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level, z in enumerate(self.zeros):
            one, before = self._bit(level, at).astype(bool), self._ones(level, at)
            out = out << 1 | one
            at = np.where(one, z + before, at - before)
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences among places start to end lie in the order below the last plane."""
        span = np.array([start, end], np.int64)
        if token < 0 or token >> len(self.zeros):
            return 0, 0
        for level, z in enumerate(self.zeros):
            before = self._ones(level, span)
            span = z + before if token >> (len(self.zeros) - 1 - level) & 1 else span - before
        return int(span[0]), int(span[1])

    def rank(self, token: int, end: int) -> int:
        """Occurrences of the token before place end."""
        a, b = self._range(token, 0, end)
        return b - a

    def _select_bit(self, level: int, bit: bool, k: np.ndarray) -> np.ndarray:
        """The place of the k-th (from 0) bit of a plane that is set, or not set."""
        marks = self.marks[level].astype(np.int64)
        if not bit:
            marks = np.arange(len(marks), dtype=np.int64) * STRIDE - marks
        block = np.searchsorted(marks, k, "right") - 1
        rows = np.unpackbits(self.planes[level].reshape(-1, STRIDE // 8)[block], axis=1, bitorder="little").astype(bool)
        rows = rows if bit else ~rows
        nth = np.cumsum(rows, axis=1) == (k - marks[block] + 1)[:, None]
        return block * STRIDE + np.argmax(nth & rows, axis=1)

    def find(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Places of the token's occurrences number first to last (from 0, last exclusive)."""
        a, b = self._range(token, 0, self.n)
        at = np.arange(a, b, dtype=np.int64)[first:last]
        if not len(at):
            return at
        for level in range(len(self.zeros) - 1, -1, -1):
            one = bool(token >> (len(self.zeros) - 1 - level) & 1)
            at = self._select_bit(level, one, at - self.zeros[level] if one else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order."""
        out = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(out)
            up[np.flatnonzero(~one)] = out[: self.zeros[level]]
            up[np.flatnonzero(one)] = out[self.zeros[level] :] | out.dtype.type(1 << (len(self.zeros) - 1 - level))
            out = up
        return out
