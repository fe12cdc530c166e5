"""Numbers in few bytes, and rows of unequal length in flat arrays.

Operators that look something up for every word or link of a corpus do it by blocks: the documents of a block name
what they hold by its place in the block's list, the list is looked up once, and the answers meet the documents again.
"""

from __future__ import annotations

import numpy as np
import zstandard


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 to 2**32 - 1, by planes of bytes, compressed."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def squeeze(words: list[str]) -> bytes:
    """Words without line ends, compressed."""
    return zstandard.ZstdCompressor(level=1).compress("\n".join(words).encode())


def loose(data: bytes) -> list[str]:
    return zstandard.ZstdDecompressor().decompress(data).decode().split("\n")


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of spans (first, size) in a flat array, one span after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
