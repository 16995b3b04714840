"""SuperMinHash sketches of word-shingle sets.

A document's words are runs of other bytes than ASCII white space, with A-Z in lower case; its set holds the distinct
sequences of width words (the whole sequence, if there are fewer words), each as a 64-bit hash. Every element draws a
permutation of the registers and a fraction for each step; at step j it offers j plus the fraction to the j-th
register of its permutation. Registers keep the least offer, so once none holds j or more, later steps change nothing
and are left out. Two sets agree in a register with a probability of their Jaccard similarity, at a lower variance
than with independent hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from parlance.llm.common import TwoGenerations

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S27, _S30, _S31, _S32 = np.uint64(27), np.uint64(30), np.uint64(31), np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)

_hashes = TwoGenerations(xxhash.xxh3_64_intdigest, 100_000)


def forget() -> None:
    """Empties the memo of words."""
    _hashes.forget()


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all sequences of width words in order, repeats included; of the whole sequence if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    out = words[: n - k + 1] + np.uint64(k)
    for i in range(1, k):
        out = mix(out * _GOLD) + words[i : n - k + 1 + i]
    return mix(out * _GOLD)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(shingle_hashes(word_hashes(text), width))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signature(shingles: np.ndarray, m: int) -> np.ndarray:
    """Registers as integers: the step in the upper half, the fraction in the lower one."""
    out = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    n = len(shingles)
    if not n:
        return out
    order = None
    rows = np.arange(n)
    for j in range(m):
        draw = mix(shingles + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64))
        k = (np.uint64(j) + ((draw & _LOW) * np.uint64(m - j) >> _S32)).astype(np.int64)
        if j == 0:
            target, first = k, k
        else:
            if order is None:
                order = np.tile(np.arange(m, dtype=np.int16), (n, 1))
                order[rows, first] = 0
                order[:, 0] = first
            target = order[rows, k]
            order[rows, k] = order[:, j]
            order[:, j] = target
        np.minimum.at(out, target, (np.uint64(j) << _S32) | (draw >> _S32))
        if int(out.max() >> _S32) <= j:
            break
    return out


def band_hashes(registers: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit hash for each of bands equal runs of registers; runs at different places never share one on purpose."""
    rows = registers.reshape(bands, -1)
    out = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
    for i in range(rows.shape[1]):
        out = mix(out + rows[:, i]) * _GOLD
    return mix(out)
