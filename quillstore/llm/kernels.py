"""Vectorised text kernels over Arrow batches: word bounds and 64-bit hashes, with no per-word Python."""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 19


def process_cache() -> dict:
    """A dictionary that lives as long as the Python worker (kernels are pickled by value, so module globals do not)."""
    return sys.__dict__.setdefault("_quillstore_llm_cache", {})


def trim_memory() -> None:
    """Give freed memory back to the system: a worker that keeps what an earlier stage took is counted with the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is-null) of a string column; a null has no bytes."""
    trim_memory()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    nulls = np.asarray(column.is_null()) if n else np.zeros(0, bool)
    return data, offsets, nulls


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges [a, b) whose bytes stay below the limit (a longer row is alone)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = process_cache()
    if "powers" not in cache or len(cache["powers"][0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        out.append(splitmix(np.arange(256, dtype=U) + U(77)))
        if size > 4 * CHUNK_BYTES:  # a huge text: do not keep its tables
            return tuple(out)
        cache["powers"] = tuple(out)
    return cache["powers"]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (relative to data) and row of each maximal run of word bytes inside a row.

    offsets: n + 1 bounds relative to data; is_word: a table of 256 booleans.
    """
    size = len(data)
    if not size:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = is_word[data]
    first = np.zeros(size + 1, bool)
    first[offsets[(offsets >= 0) & (offsets <= size)]] = True
    prev = np.empty(size, bool)
    prev[0] = False
    prev[1:] = w[:-1]
    starts = np.flatnonzero(w & (~prev | first[:-1]))
    nxt = np.empty(size, bool)
    nxt[-1] = False
    nxt[:-1] = w[1:]
    ends = np.flatnonzero(w & (~nxt | first[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over mixed byte values, then a finaliser with the length."""
    if not len(starts):
        return np.zeros(0, U)
    up, down, mixed = _powers(len(data) + 1)
    c = np.empty(len(data) + 1, U)
    c[0] = 0
    np.cumsum(mixed[data] * up[: len(data)], out=c[1:])
    return splitmix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(U))


def gram_hashes(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each k consecutive words of a row, and the index of their first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.zeros(n, U)
    for j in range(k):
        h = h * U(0xD1342543DE82EF95) + hashes[j : j + n]
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return splitmix(h[at]), at


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes unchanged."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def table(chars) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


#: Words between ASCII white space (space and \t to \r).
NOT_SPACE = ~table([32, *range(9, 14)])
#: ASCII digits, lower-case letters and every byte of a non-ASCII character.
WORD = table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def code_points(data: np.ndarray) -> np.ndarray:
    """Marks the first byte of each code point."""
    return (data & 0xC0) != 0x80
