"""Shingle sets of texts and their minwise signatures, in numpy.

Words are runs of bytes other than space and tab to carriage return, with A-Z
lowered. A shingle is the byte string of its words joined by one space; it is
hashed to 62 bits by polynomials over its bytes modulo two primes and a final mix.
"""

from __future__ import annotations

import numpy as np

#: An odd factor for seeds.
BASE = 0x9E3779B97F4A7C15
#: Primes below 2**31, so that products of two residues fit in 64 bits, and a base for each.
PRIMES = ((2147483647, 1331537911), (2147483629, 1840700269))
#: Bytes whose terms can be summed without reduction.
PLAIN = 1 << 23
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power_table(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo the prime; kept and grown by doubling."""
    table = _powers.get((base, prime))
    if table is None or len(table) < n:
        table = np.ones(1, np.uint64)
        while len(table) < max(n, 1 << 16):
            table = np.concatenate((table, table * np.uint64(pow(base, len(table), prime)) % np.uint64(prime)))
        _powers[base, prime] = table
    return table


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``data[start:end]`` for bytes ``data``; equal spans have equal hashes."""
    out = np.zeros(len(starts), np.uint64)
    values = data.astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(data) + 1, np.uint64)
    for prime, base in PRIMES:
        p = np.uint64(prime)
        terms = values * _power_table(base, prime, len(data))[: len(data)]
        np.cumsum(terms if len(data) <= PLAIN else terms % p, out=sums[1:])
        # the difference of sums holds the span's first power, which its inverse takes away
        raw = (sums[ends] - sums[starts]) % p * _power_table(pow(base, -1, prime), prime, len(data))[starts] % p
        out = (out << np.uint64(31)) | raw
    return mix64(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles.

    A text of fewer words than ``width`` has its whole sequence as its one
    shingle; without words, or null, it has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    gaps = np.flatnonzero(joined == 0x20)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(joined)]))
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(span_hashes(joined, starts, ends))


def minwise_parameters(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``size`` hash functions."""
    seeds = mix64(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(BASE))
    return seeds[:size] | np.uint64(1), seeds[size:]


def minwise(hashes: np.ndarray, parameters: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The upper 32 bits of each function's smallest value, as int32."""
    factors, offsets = parameters
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[i : i + 2048, None] * factors + offsets).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def similar(a: np.ndarray, b: np.ndarray, part: int, whole: int) -> bool:
    """whole * size of the intersection >= part * size of the union."""
    low, high = sorted((len(a), len(b)))
    if not low or whole * low < part * high:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return whole * common >= part * (len(a) + len(b) - common)
