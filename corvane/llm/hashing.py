"""Polynomial (Rabin-Karp) hashes over whole pieces of text, in numpy.

A word's value is its XXH3 hash of 64 bits. A window's hash is a polynomial over its words' values,
modulo the prime 2**61 - 1 with a random base: a difference of two prefix sums, so every window costs a constant
number of vector operations. Modulo a prime no pattern of words collides by its shape (modulo 2**64 the Thue-Morse
patterns do, whatever the base): two different windows of n words share a hash with a chance of about n / 2**61. A
bijective finaliser spreads the result's bits.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from xxhash import xxh3_64_intdigest

U = np.uint64
#: The modulus, a Mersenne prime.
PRIME = U((1 << 61) - 1)
_M29, _M30, _M31, _M32 = (U((1 << n) - 1) for n in (29, 30, 31, 32))
#: every ASCII byte but letters and digits
NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: bytes.translate table that leaves blanks between runs of letters and digits
LETTERS_ONLY = bytes(32 if NO_LETTER[b] else b for b in range(256))
_WORD_BASE = 0x17E3_779B_97F4_A7C1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & PRIME) + (x >> U(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers below it: in halves of 31 bits, where 2**61 counts as 1."""
    a1, a0, b1, b0 = a >> U(31), a & _M31, b >> U(31), b & _M31
    middle = a1 * b0 + a0 * b1
    return _folded((a1 * b1 << U(1)) + (middle >> U(30)) + ((middle & _M30) << U(31)) + a0 * b0)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, size: int) -> np.ndarray:
    """base**0 to base**size modulo PRIME. One table a base is kept, grown by doubling."""
    have = _POWERS.get(base)
    if have is None:
        have = np.ones(1, dtype=U)
    while len(have) <= size:
        have = np.concatenate([have, times(have, U(pow(base, len(have), int(PRIME))))])
    _POWERS[base] = have
    return have[: size + 1]


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """Of values * base**place modulo PRIME, from 0 on; halves are summed apart, so that 2**30 of them cannot overflow."""
    terms = times(_folded(values), powers(base, len(values))[:-1])
    low, high = np.cumsum(terms & _M32, dtype=U), np.cumsum(terms >> U(32), dtype=U)
    out = np.zeros(len(values) + 1, dtype=U)
    out[1:] = _folded((high >> U(29)) + ((high & _M29) << U(32)) + low)
    return out


def stretch_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _WORD_BASE) -> np.ndarray:
    """The polynomial hash of values[start:end] for each pair, independent of where it stands."""
    prefix = prefix_sums(values, base)
    back = powers(pow(base, -1, int(PRIME)), len(values))
    return times(_folded(prefix[ends] + PRIME - prefix[starts]), back[starts])


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of several texts: their hashes, and each text's range of words.

    `letters`: words are runs of letters, digits and bytes beyond ASCII instead.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, letters: bool = False) -> None:
        if lower:
            texts = [t.lower() for t in texts]
        lists = [(t.translate(LETTERS_ONLY) if letters else t).split() for t in texts]
        #: text i has the words first[i] to first[i + 1]
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
        self.hashes = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(lists)), dtype=U, count=int(self.first[-1]))

    def __len__(self) -> int:
        return len(self.hashes)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start (word index in the piece) and hash of every window of `size` words within one text."""
        counts = np.diff(self.first)
        n = np.maximum(counts - size + 1, 0)
        if not n.sum():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
        before = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(before - self.first[:-1], n)
        return at, mix(stretch_hashes(self.hashes, at, at + size))


def pack_values(values: np.ndarray) -> bytes:
    """Non-negative integers in any order, a byte each and one more for every 255."""
    parts = values // 255
    out = np.full(int(parts.sum()) + len(values), 255, dtype=np.uint8)
    out[np.cumsum(parts + 1) - 1] = values % 255
    return out.tobytes()


def unpack_values(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    return np.diff(np.cumsum(raw, dtype=np.int64)[raw < 255], prepend=0)
