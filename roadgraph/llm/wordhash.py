"""Words of a text as 64-bit hashes, and hashes of consecutive words, in arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a worker remembers, and the longest of them in bytes: at most about 50 MB.
CACHE = 400_000
LONGEST = 64
_seen: dict[bytes, int] = {}
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def split(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ in UTF-8: bytes.split cuts at just these six characters."""
    return text.encode("utf-8", "surrogatepass").split()


def _hash(word: bytes) -> int:
    found = xxhash.xxh3_64_intdigest(word) or 1
    if len(word) <= LONGEST:
        if len(_seen) >= CACHE:
            _seen.clear()
        _seen[word] = found
    return found


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    get = _seen.get
    return np.fromiter((get(w) or _hash(w) for w in words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of x."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k hashes; empty with fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, factor = np.zeros(n, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            factor = factor * _MULT
            total += h[j : j + n] * factor
        return mixed(total)


def runs(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of h[start : start + length] for many runs, from prefix sums of a polynomial over the integers mod 2**64."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(h) + 1, _MULT, np.uint64))
        inverse = np.cumprod(np.full(len(h) + 1, np.uint64(pow(int(_MULT), -1, 2**64)), np.uint64))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)])
        return mixed((prefix[start + length] - prefix[start]) * inverse[start] + length.astype(np.uint64))
