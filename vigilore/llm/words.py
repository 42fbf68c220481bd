"""Word hashing for the operators that work on shingles and windows (numpy inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


class _WordHashes(dict):
    """Cache from word to 64-bit hash; cleared when it holds ``most`` words."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_cache = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _K3
    x = x ^ (x >> np.uint64(29))
    x = x * _K1
    return x ^ (x >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the ordered pairs (a[i], b[i])."""
    return mix(a * _K2 + (b ^ np.uint64(seed)) * _K1 + (b >> np.uint64(31)))


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``k`` items, built by doubling."""
    out, size, base, width = None, 0, h, 1
    while width <= k:
        if k & width:
            if out is None:
                out, size = base, width
            else:
                n = len(h) - size - width + 1
                if n <= 0:
                    return h[:0]
                out, size = pair(out[:n], base[size : size + n], seed + size), size + width
        n = len(base) - width
        if n <= 0:
            if width < k and (k >> (width.bit_length())) > 0:
                return h[:0]
            break
        base, width = pair(base[:n], base[width:], seed + 7 * width), width * 2
    return out if out is not None else h[:0]
