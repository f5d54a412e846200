"""Vectorised kernels over Arrow text columns, shared by the corpus operators.

A *chunk* is a run of whole documents of about CHUNK_BYTES of UTF-8. Words are runs of bytes other than 0x20 and
0x09-0x0D, found on the bytes of a whole chunk at once; a word's hash comes from prefix sums of polynomials modulo two
primes below 2**32, so no Python loop touches words. (Modulo 2**64 regular words, as the Thue-Morse ones, would collide
whatever the base.) Hashes depend on the fixed seeds below only, never on the machine or the run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

CHUNK_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: The two largest primes below 2**32, each with the base of its polynomial.
_PRIMES = ((4294967291, 2654435769), (4294967279, 1779033703))
#: A number for each byte, by family and prime.
_TABLES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 4294967279, (2, 2, 256), dtype=np.uint64)
_COEFFS = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, (2, 32), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
try:
    _LIBC = ctypes.CDLL(None)
except OSError:  # a platform without dynamic symbols
    _LIBC = None
_POWERS: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []


def give_back() -> None:
    """Returns freed memory to the system. Executors bound the sum over workers, and allocators keep what large
    temporary arrays have used; called at the end of a task, and after each chunk where a
    chunk takes most, though pages given back must be fetched again."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and shift)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(base: int, prime: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint32)
    done = 1
    while done < size:
        more = min(done, size - done)
        out[done : done + more] = out[:more].astype(np.uint64) * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    return out


def _powers(n: int) -> list[tuple[np.uint64, np.ndarray, np.ndarray]]:
    """(prime, powers of the base, powers of its inverse) of both primes, kept for the largest chunk so far."""
    if not _POWERS or len(_POWERS[0][1]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _POWERS[:] = [(np.uint64(p), _power_table(b, p, size), _power_table(pow(b, -1, p), p, size)) for p, b in _PRIMES]
    return _POWERS


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch at row borders into pieces of about `size` bytes of text: (rows, bytes, offsets)."""
    data, offs = text_bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


class Words:
    """Words of a chunk: starts and ends in bytes, row of each word, up to two families of 64-bit hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, *, lower: bool = False, families: int = 1):
        n = len(data)
        self.rows = len(offs) - 1
        if n == 0:
            self.starts = self.ends = self.row = np.zeros(0, np.int64)
            self.hashes = [np.zeros(0, np.uint64)] * families
            return
        space = _SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        first, last = edge[:-1].copy(), edge[1:].copy()
        first[1:] |= space[:-1]
        last[:-1] |= space[1:]
        self.starts = np.flatnonzero(first & ~space)
        self.ends = np.flatnonzero(last & ~space) + 1
        self.row = np.searchsorted(offs, self.starts, "right") - 1
        fold = _LOWER[data] if lower and families else data
        length = (self.ends - self.starts).astype(np.uint64) * _GOLD
        sums = np.zeros(n + 1 if families else 0, np.uint64)
        self.hashes = []
        for tables in _TABLES[:families]:
            key = np.zeros(len(self.starts), np.uint64)
            for table, (prime, up, down) in zip(tables, _powers(n)):
                value = table[fold]
                value *= up[:n]
                value %= prime
                np.cumsum(value, out=sums[1:])
                key = key << np.uint64(32) | (sums[self.ends] - sums[self.starts]) % prime * down[self.starts] % prime
            self.hashes.append(mix(key + length))

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def windows(self, size: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions (of the first word) and hashes of all runs of `size` words inside one row."""
        n = len(self.row) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for i in range(size):
            total += self.hashes[family][i : i + n] * _COEFFS[family][i]
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        return at, mix(total[at])


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row as (row, hash), sorted. A row with 1 to size-1 words has its whole sequence as one."""
    at, hashed = words.windows(size)
    row, counts = words.row[at], words.counts
    starts = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            here = counts[short] > i
            total[here] += words.hashes[0][starts[short[here]] + i] * _COEFFS[0][16 + i]
        total += counts[short].astype(np.uint64) * _GOLD
        row, hashed = np.concatenate([row, short]), np.concatenate([hashed, mix(total)])
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    if len(row):
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
        row, hashed = row[new], hashed[new]
    return row, hashed


class Index:
    """Finds keys above 0 in an open-addressed table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(1.5 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values, self.last = np.zeros(size, np.uint64), np.zeros(size, values.dtype), size - 1
        left, at = np.arange(len(keys)), self._start(keys)
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            done = self.keys[at] == keys[left]
            self.values[at[done]] = values[left[done]]
            left, at = left[~done], (at[~done] + 1) & self.last

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _GOLD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is there, its value)."""
        at = self._start(keys)
        held = self.keys[at]
        hit, left = held == keys, np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.last
            held = self.keys[at[left]]
            hit[left] = held == keys[left]
            left = left[(held != keys[left]) & (held != 0)]
        return hit, self.values[at]


def pack(values: np.ndarray) -> bytes:
    """Compresses unsigned integers: bytes of equal weight side by side, then zstandard."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes() if len(values) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(flat.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Compresses ascending 64-bit integers by their differences."""
    return pack(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)
