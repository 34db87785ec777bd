"""Words and word n-grams of Arrow text columns as NumPy arrays of positions and 64-bit hashes.

Hashes find what may be equal; whoever reports equality compares bytes (``Words.distinct``).

All work is on UTF-8 bytes of a few texts at a time, so its memory follows the
longest text rather than the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are taken together up to about this many bytes.
PIECE_BYTES = 1 << 20
#: The same where several arrays stand for every byte, and two workers share an executor's memory with a full heap.
SMALL_PIECE = 1 << 18

#: Two primes below 2**31 and a base for each: a word's hash is its value as a polynomial modulo both.
_PRIMES = (2147483647, 2147483629)
_BASES = (1103515245, 1664525009)
_RUN = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]+`: anything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the splitmix64 constants)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses, for exponents up to n - 1."""
    global _powers
    if not _powers or len(_powers[0]) < n:
        size = max(n, SMALL_PIECE + 1) if n <= SMALL_PIECE + 1 else max(n, PIECE_BYTES + 1)
        tables = []
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            for b in (base, pow(base, -1, prime)):
                powers = np.ones(1, np.int64)
                while len(powers) < size:
                    powers = np.concatenate([powers, powers * pow(b, len(powers), prime) % prime])
                tables.append(powers[:size])
        if n > 4 * PIECE_BYTES:  # one very long text: not worth keeping
            return tables
        _powers = tables
    return _powers


def _running(values: np.ndarray, prime: int) -> np.ndarray:
    """Prefix sums modulo a prime of values below 2**40, starting with 0."""
    out = np.zeros(len(values) + 1, np.int64)
    step, carry = 1 << 22, 0  # 2**22 values below 2**40 fit
    for a in range(0, len(values), step):
        part = out[a + 1 : a + 1 + step]
        np.cumsum(values[a : a + step], out=part)
        part += carry
        part %= prime
        carry = int(part[-1])
    return out


@dataclass
class Words:
    """Words of consecutive rows: byte range in ``data``, row and hash of each; ``first`` has a word index for every row and the end."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def text(self, i: int, n: int) -> bytes:
        """Words i to i + n - 1 joined by one space."""
        raw = self.data
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.starts[i : i + n], self.ends[i : i + n], strict=True))

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """The different words, and for every word which one it is.

        Words are told apart by their bytes: hashes only group them, and where
        two different words share one, all are compared as bytes.
        """
        raw = self.data.tobytes()
        _, where, which = np.unique(self.hashes, return_index=True, return_inverse=True)
        if not self.same(np.arange(len(which)), where[which]).all():
            names: dict[bytes, int] = {}
            which = np.fromiter((names.setdefault(raw[s:e], len(names)) for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True)), np.int64, len(self.starts))
            return list(names), which
        return [raw[s:e] for s, e in zip(self.starts[where].tolist(), self.ends[where].tolist(), strict=True)], which

    def same(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether words have the bytes of others, place by place."""
        size = self.ends - self.starts
        out = (one == other) | (size[one] == size[other])
        todo = np.flatnonzero(out & (one != other))
        for a in range(0, len(todo), 1 << 17):
            at = todo[a : a + (1 << 17)]
            n = size[one[at]]
            first = np.cumsum(n) - n
            inside = np.arange(int(n.sum())) - np.repeat(first, n)
            differ = self.data[np.repeat(self.starts[one[at]], n) + inside] != self.data[np.repeat(self.starts[other[at]], n) + inside]
            out[at[np.add.reduceat(differ, first) > 0] if len(at) else at] = False
        return out

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """All words with a space after each, and where each begins there (and the end)."""
        size = self.ends - self.starts
        first = np.cumsum(size) - size
        inside = np.repeat(self.starts - first, size) + np.arange(int(size.sum()))
        flat = np.full(len(inside) + len(size), 32, np.uint8)
        flat[np.arange(len(inside)) + np.repeat(np.arange(len(size)), size)] = self.data[inside]
        return flat.tobytes(), np.append(first, len(inside)) + np.arange(len(size) + 1)

    def normal(self) -> list[bytes]:
        """The words of every row, joined by single spaces."""
        raw, edge = self.spaced()
        return [raw[a : b - 1] if b > a else b"" for a, b in zip(edge[self.first[:-1]].tolist(), edge[self.first[1:]].tolist(), strict=True)]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every run of k words inside one row."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.rows[:n] == self.rows[k - 1 : k - 1 + n])
        return at, run_hash(self.hashes, at, k)


def run_hash(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k word hashes from each position."""
    total = np.full(len(at), k, np.uint64)
    for j in range(k):
        total = total * _RUN + hashes[at + j]
    return mix(total)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, raw


def whole_words(texts: pa.Array, keep: np.ndarray, lower: bool = True) -> Words:
    """Words of all rows in one piece."""
    offsets, raw = _buffers(texts)
    data = raw[offsets[0] : offsets[-1]]
    return _words(LOWER[data] if lower else data, offsets - offsets[0], keep)


def split_words(texts: pa.Array, keep: np.ndarray, lower: bool = True, hashed: bool = True, piece: int = PIECE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """For pieces of the column (of about ``piece`` bytes): first row, number of rows, and their words (rows counted inside the piece), without hashes if none are asked for."""
    offsets, raw = _buffers(texts)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + piece, "right")) - 1
        end = min(max(end, row + 1), rows)
        data = raw[offsets[row] : offsets[end]]
        data = LOWER[data] if lower else data
        yield row, end - row, _words(data, offsets[row : end + 1] - offsets[row], keep, hashed)
        row = end


def _words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, hashed: bool = True) -> Words:
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = keep[data]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins = inside[1:-1] & ~inside[:-2]
    begins[edges] = inside[1:-1][edges]
    stops = inside[1:-1] & ~inside[2:]
    stops[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(rows, np.arange(len(offsets)))
    if not hashed:
        return Words(data, starts, ends, rows, np.zeros(0, np.uint64), first)
    up_a, down_a, up_b, down_b = _power_tables(n + 1)
    value = data.astype(np.int64) + 1
    halves = []
    for up, down, prime in ((up_a, down_a, _PRIMES[0]), (up_b, down_b, _PRIMES[1])):
        sums = _running(value * up[:n], prime)
        halves.append(((sums[ends] - sums[starts]) % prime * down[starts] % prime).astype(np.uint64))
    hashes = mix(halves[0] << np.uint64(32) ^ halves[1] ^ ((ends - starts).astype(np.uint64) << np.uint64(31)))
    return Words(data, starts, ends, rows, hashes, first)


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values
