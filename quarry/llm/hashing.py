"""64-bit hashes of words and shingles, many texts at a time, on numpy arrays.

A word's hash is a polynomial over random values of its bytes, taken from prefix sums modulo 2**64, and then mixed.
No dictionary of words is kept, so memory depends on PIECE alone, not on the vocabulary; texts longer than
PIECE are cut at white space.
"""

from __future__ import annotations

import ctypes
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE, ROWS = 1 << 18, 512
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANK = re.compile(rb"[\x09-\x0d\x20]")
_BASE = 0x9E3779B97F4A7C15
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * ODD[1])
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, pow(_BASE, -1, 2**64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _pieces(text: bytes):
    lo = 0
    while len(text) - lo > PIECE:
        m = _BLANK.search(text, lo + PIECE)
        hi = m.start() if m else len(text)
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of one buffer."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    edge = np.ones(n + 2, dtype=bool)
    edge[1:-1] = _SPACE[b]
    start = np.flatnonzero(edge[:-2] & ~edge[1:-1])
    end = np.flatnonzero(~edge[1:-1] & edge[2:]) + 1
    up, down = _powers(PIECE * 2 if n <= PIECE * 2 else n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[b] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, words per text); A-Z are lower-cased, a null text has no words."""
    out, counts = [np.empty(0, dtype=np.uint64)], np.zeros(len(texts), dtype=np.int64)
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush():
        nonlocal size
        data = b"\n".join(p for _, p in held).translate(_LOWER)
        h, start = _hashes(data)
        out.append(h)
        begin = np.cumsum([0, *(len(p) + 1 for _, p in held)])
        np.add.at(counts, [i for i, _ in held], np.diff(np.searchsorted(start, begin)))
        held.clear()
        size = 0

    for i, t in enumerate(texts):
        for p in _pieces(t or b""):
            held.append((i, p))
            size += len(p) + 1
            if size >= PIECE:
                flush()
    if held:
        flush()
    return np.concatenate(out), counts


def shingles(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a text of fewer words has its whole sequence as one."""
    h, counts = word_hashes(texts)
    n = max(len(h) - words + 1, 0)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        total = mix(total * ODD[k % 5] + h[k : k + n])
    out, at = [], 0
    for c in counts.tolist():
        if c >= words:
            out.append(np.unique(total[at : at + c - words + 1]))
        elif c:
            one = np.array([c], dtype=np.uint64)
            for x in h[at : at + c]:
                one = mix(one * ODD[0] + x)
            out.append(one)
        else:
            out.append(h[:0])
        at += c
    return out


def trim() -> None:
    """Give freed memory and the powers back to the system.  Python workers outlive their tasks, and idle ones count beside an executor's heap."""
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library that has no such call
        pass


def slices(batch: pa.RecordBatch, rows: int = ROWS):
    """A batch in parts of at most ``rows`` rows; what was freed meanwhile goes back once they are done with."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)
    trim()


def binaries(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without a detour over Python strings."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
