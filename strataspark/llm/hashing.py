"""Hashes of words and byte strings over whole blocks of text, in numpy."""
from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK), base, np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[base] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each 64-bit value, in place."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each span; the spans are in order and don't overlap.

    Works through the bytes in chunks, so that memory beyond the input is bounded by the longest span."""
    out = np.empty(len(start), np.uint64)
    inverse = pow(BASE, -1, 1 << 64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            origin = int(start[at])
            upto = max(at + 1, int(np.searchsorted(end, origin + CHUNK, side="right")))
            part = data[origin:int(end[upto - 1])]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(TABLE[part] * powers(len(part), BASE), out=sums[1:])
            a, b = start[at:upto] - origin, end[at:upto] - origin
            out[at:upto] = (sums[b] - sums[a]) * powers(len(part) + 1, inverse)[a] + (b - a).astype(np.uint64)
            at = upto
    return mix(out)


def words_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words between ASCII white space, with A-Z in lower case, and the number of words of each text."""
    parts = [b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()) for t in texts]
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    gap = np.flatnonzero(data == 32)
    start, end = gap[:-1] + 1, gap[1:]
    full = end > start
    counts = np.array([p.count(b" ") + 1 if p else 0 for p in parts], np.int64)
    return span_hashes(data, start[full], end[full]), counts


def shingles_of(texts: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of word shingles, sorted within each text, and their number for each text.

    A text with fewer words than ``width`` has its whole sequence as one shingle; without words it has none."""
    words, counts = words_of(texts)
    starts = np.cumsum(counts) - counts
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    first = starts[owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    length = np.minimum(counts, width)[owner]
    value = np.zeros(len(owner), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            has = length > k
            value[has] = value[has] * np.uint64(BASE) + words[first[has] + k] + np.uint64(k + 1)
    mix(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, bool)
    return value[new], np.bincount(owner[new], minlength=len(texts))
