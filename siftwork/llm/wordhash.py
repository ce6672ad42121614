"""Vectorised hashing of the words of many texts at once (numpy; 64-bit arithmetic wraps on purpose).

A word is a run of bytes other than ASCII white space in the UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that one step of work takes; a longer text is cut between words. Numpy needs some 40 times as much.
STEP = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_COEFFICIENTS = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def coefficients(n: int) -> np.ndarray:
    if n <= len(_COEFFICIENTS):
        return _COEFFICIENTS
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _hash_bytes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, byte at which it starts) for a buffer that no word crosses."""
    solid = ~SPACE[buf]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = ends - starts
    at = np.cumsum(sizes) - sizes
    body = buf[solid].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(body)) - np.repeat(at, sizes)
    body *= coefficients(int(sizes.max()))[place]
    return mix(np.add.reduceat(body, at) + sizes.astype(np.uint64)), starts


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, byte at which it starts), in steps of about STEP bytes."""
    buf = np.frombuffer(data, dtype=np.uint8)
    if len(buf) <= STEP:
        return _hash_bytes(buf)
    hashes, starts, at = [], [], 0
    while at < len(buf):
        end = min(len(buf), at + STEP)
        while end < len(buf) and not SPACE[buf[end]]:
            end += 1
        h, s = _hash_bytes(buf[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def groups(texts: list[str | None], lower: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts of about STEP bytes: (indices of the texts, hashes of all their words, where each text's words begin, and the end)."""
    indices: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        data = (text.lower() if lower else text).encode("utf-8", "surrogatepass") if text else b""
        indices.append(i)
        parts.append(data)
        size += len(data) + 1
        if size >= STEP or i == len(texts) - 1:
            hashes, starts = hash_words(b"\n".join(parts))
            begins = np.cumsum([0] + [len(p) + 1 for p in parts])
            yield np.array(indices), hashes, np.searchsorted(starts, begins)
            indices, parts, size = [], [], 0
