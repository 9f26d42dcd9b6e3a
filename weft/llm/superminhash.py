"""SuperMinHash signatures (Ertl, 2017) of 5-word shingle sets, vectorised over the elements of a set.

Each element d walks a random permutation of the registers; its j-th step offers the value j + u(d, j)
to register perm_d[j]. A register keeps the least offer. Values of step j are at least j, so once every
register holds less than j + 1 no later step can change any: with n elements, about m ln(m) / n steps
do. The permutation correlates the registers, which lowers the variance below plain MinHash.
"""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
GOLDEN, MIX1, MIX2, ROLL = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0xD6E8FEB86659FD93)
#: Elements that are walked at once; bounds the memory of a very long text.
BLOCK = 8192


class WordHashes(dict):
    """64-bit hash of a word, remembered; emptied when it holds ``limit`` words to bound memory."""

    def __init__(self, limit: int = 200_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * MIX1
    x = (x ^ (x >> U64(27))) * MIX2
    return x ^ (x >> U64(31))


def shingle_set(text: str, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; A-Z lower-cased, words split at ASCII white space.

    Fewer than ``width`` words make one shingle of the whole sequence, no words an empty set.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U64)
    h = np.fromiter(map(hashes.__getitem__, words), U64, len(words))
    if len(words) < width:
        acc = np.array([len(words)], U64)
        for x in h:
            acc = mix(acc * ROLL + x)
        return acc
    acc = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        acc = acc * ROLL + h[k : len(h) - width + 1 + k]
    return np.unique(mix(acc))


def signature(elements: np.ndarray, m: int) -> np.ndarray:
    """m registers as float64; all infinite for an empty set."""
    least = np.full(m, np.inf)
    for at in range(0, len(elements), BLOCK):
        part = elements[at : at + BLOCK]
        n, rows, perm = len(part), np.arange(min(BLOCK, len(part))), None
        for j in range(m):
            if least.max() < j:
                break
            r = mix(part + GOLDEN * U64(j + 1))
            k = j + ((r & U64(0xFFFFFFFF)).astype(np.int64) * (m - j) >> 32)
            u = (r >> U64(32)).astype(np.float64) * 2.0**-32
            if perm is None:
                spot, first = k, k
                if n > 1 or m > 1:
                    np.minimum.at(least, spot, j + u)
                if least.max() < 1:
                    break
                perm = np.broadcast_to(np.arange(m, dtype=np.int16), (n, m)).copy()
                perm[rows, first] = 0
                perm[:, 0] = first
                continue
            spot = perm[rows, k].copy()
            perm[rows, k] = perm[:, j]
            perm[:, j] = spot
            np.minimum.at(least, spot, j + u)
    return least


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each ``rows`` registers."""
    bits = sig.view(U64).reshape(-1, rows)
    acc = np.arange(1, len(bits) + 1, dtype=U64) * GOLDEN
    for k in range(rows):
        acc = mix(acc * ROLL + bits[:, k])
    return acc
