"""Sets of hashed word shingles of whole texts, many texts at once in array operations.

Words are stretches without ASCII white space, with A-Z in lower case. A word's hash is a polynomial in its bytes modulo
2^64, read off running sums; a shingle's hash combines the hashes of its words in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype="uint64")
CHUNK_BYTES = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * STEPS[2]
    x ^= x >> np.uint64(29)
    x = x * STEPS[3]
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype="uint64")
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype="uint64")


_UP, _DOWN = np.ones(1, "uint64"), np.ones(1, "uint64")


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        size = 1 << n.bit_length()
        _UP, _DOWN = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
    return _UP, _DOWN


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` in order, and where each begins."""
    raw = np.frombuffer(data, "uint8")
    space = np.concatenate([[True], _SPACE[raw], [True]])
    change = np.diff(space.view("int8"))
    begin, end = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    up, down = _power_tables(len(raw) + 1)
    # A byte counts from 1, so words that differ only by leading zero bytes differ.
    sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum((raw.astype("uint64") + np.uint64(1)) * up[: len(raw)], dtype="uint64")])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype("uint64")), begin


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), dtype="uint64")
    for k in range(width):
        out = mix(out * STEPS[0] + words[k : k + n] + np.uint64(k + 1))
    return out


def shingle_sets(texts: Iterable[str | None], width: int = 4) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``width`` are one shingle, none an empty set."""
    some: list[bytes] = []
    size = 0
    for text in texts:
        data = text.encode().lower() if text else b""
        if size and size + len(data) > CHUNK_BYTES:
            yield from _sets(some, width)
            some, size = [], 0
        some.append(data)
        size += len(data) + 1
    yield from _sets(some, width)


def _sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    words, begin = word_hashes(b"\n".join(texts))
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    cuts = np.searchsorted(begin, firsts)
    runs = shingle_hashes(words, width)
    for i in range(len(texts)):
        a, b = int(cuts[i]), int(cuts[i + 1])
        if b - a >= width:
            s = np.sort(runs[a : b - width + 1])
            keep = np.ones(len(s), dtype=bool)
            keep[1:] = s[1:] != s[:-1]
            yield s[keep]
        elif b > a:
            yield mix(shingle_hashes(words[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, "uint64")


def set_digest(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()
