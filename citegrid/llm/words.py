"""Words of whole texts and their hashes, many texts at a time.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are 64-bit: two
polynomials over the bytes, modulo two primes, taken from prefix sums, then mixed with the
length. Modulo a prime two different words of n bytes agree for at most n of the bases, so
there are no families of words that agree whatever the base, as there are modulo a power
of two. They depend on the bytes of the word alone, so every task of every run agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes handled at a time; a longer text is cut at white space and put together again.
SLAB = 1 << 18
PART_ROWS = 512

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WHITE = bytes(np.flatnonzero(_SPACE).astype(np.uint8))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# Coefficients of the bytes: their value plus one, so that leading zero bytes count.
_BYTE = np.arange(1, 257, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
# Primes below 2^31 with a base each.
_PRIMES = ((2_147_483_647, 1_392_050_177), (2_147_483_629, 738_915_449))
# Bytes whose products with powers a 64-bit sum can hold; beyond, products are reduced first.
_UNREDUCED = 1 << 24
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_PRIME_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def prime_powers(n: int, prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a base and of its inverse, modulo a prime below 2^31."""
    have = _PRIME_POWERS.get(prime)
    if have is None or len(have[0]) < n:
        out = []
        for b in (base, pow(base, -1, prime)):
            row, step = np.ones(1, np.uint64), b
            while len(row) < max(n, 1 << 12):
                row, step = np.concatenate([row, row * np.uint64(step) % np.uint64(prime)]), step * step % prime
            out.append(row)
        have = _PRIME_POWERS[prime] = tuple(out)
    return have[0][:n], have[1][:n]


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 12)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _POWERS[base] = have
    return have[0][:n], have[1][:n]


def binary(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that what a task holds per row stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(index of the text, piece): long texts are cut after white space, others are whole."""
    for i, text in enumerate(texts):
        if len(text) <= SLAB:
            yield i, text
            continue
        at = 0
        while at < len(text):
            end = min(at + SLAB, len(text))
            while end < len(text) and text[end] not in _WHITE:
                end += 1
            yield i, text[at:end]
            at = end


def _hash_slab(parts: list[bytes], table: np.ndarray) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
    values, sums, half = table[data], np.zeros(len(data) + 1, np.uint64), []
    for prime, base in _PRIMES:
        up, down = prime_powers(len(data), prime, base)
        products = values * up
        if len(data) > _UNREDUCED:
            products %= np.uint64(prime)
        np.cumsum(products, out=sums[1:])
        half.append((sums[ends] - sums[starts]) % np.uint64(prime) * down[starts] % np.uint64(prime))
    hashes = mix(mix(half[0] << np.uint64(32) | half[1]) + (ends - starts).astype(np.uint64))
    first = np.cumsum([0] + [len(p) + 1 for p in parts])
    cut = np.searchsorted(starts, first)
    return [hashes[a:b] for a, b in zip(cut[:-1], cut[1:])]


def word_hashes(texts: list[bytes], fold: bool = False) -> Iterator[np.ndarray]:
    """Per text, in order, the hashes of its words; ``fold`` reads A-Z as a-z."""
    table = _FOLDED if fold else _BYTE
    held: list[np.ndarray] = []
    at = 0
    group: list[tuple[int, bytes]] = []
    size = 0

    def flush():
        for (i, _), h in zip(group, _hash_slab([p for _, p in group], table)):
            yield i, h

    def hashed():
        nonlocal group, size
        for i, piece in _pieces(texts):
            group.append((i, piece))
            size += len(piece)
            if size >= SLAB:
                yield from flush()
                group, size = [], 0
        if group:
            yield from flush()

    for i, h in hashed():
        while at < i:
            yield held[0] if len(held) == 1 else np.concatenate(held)
            held, at = [], at + 1
        held.append(h)
    if texts:
        yield held[0] if len(held) == 1 else np.concatenate(held)


def rolling(hashes: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2^64, of every run of ``width`` values."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(hashes), base)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])
