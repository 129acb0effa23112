"""Word splitting and hashing on whole Arrow text columns, by numpy over the UTF-8 bytes.

A text column is taken as one byte buffer with row offsets, so no Python string is made for a document.  Word classes
are sets of bytes: every byte of a multi-byte UTF-8 character is 0x80 or above, so a class that holds all of
0x80-0xFF or none of them is a class of code points too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE_SEPARATED = np.ones(256, dtype=bool)
SPACE_SEPARATED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
"""[^\\x20\\x09-\\x0D]"""

LETTERS_DIGITS = np.zeros(256, dtype=bool)
LETTERS_DIGITS[0x30:0x3A] = True
LETTERS_DIGITS[0x61:0x7B] = True
LETTERS_DIGITS[0x80:] = True
"""[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F], meant for text whose A-Z are already lower case"""

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_STEP = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (a bijection): all output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_PLACES = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_TABLES: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        size = max(n, 1 << 16)
        _TABLES["up"] = _powers(size, 0x100000001B3)
        _TABLES["down"] = _powers(size, pow(0x100000001B3, -1, 1 << 64))
    return _TABLES["up"], _TABLES["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 row offsets; a null row is empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data, at


def chunks(at: np.ndarray, most: int = 1 << 20):
    """Runs of rows [a, b) of about most bytes, a longer row alone."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
        yield a, b
        a = b


class Words:
    """The words of rows [a, b): byte spans in data, 64-bit codes and each row's first word."""

    __slots__ = ("codes", "data", "ends", "first", "starts")

    def __init__(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray, lower: bool):
        lo, hi = int(at[0]), int(at[-1])
        data = data[lo:hi]
        at = at - lo
        if lower:
            data = LOWER[data]
        n = len(data)
        inside = kind[data]
        before = np.empty(n + 1, dtype=bool)
        before[0] = False
        before[1:] = inside
        edges = at[(at >= 0) & (at <= n)]
        before[edges] = False  # a word ends where its row ends
        after = np.empty(n + 1, dtype=bool)
        after[:-1] = inside
        after[-1] = False
        after[edges] = False
        self.data = data
        self.starts = np.flatnonzero(inside & ~before[:-1])
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.starts, at)
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODES[data] * up[:n], out=sums[1:])
        self.codes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """The code of each run of size words; of fewer words, but not none, one code for all of them."""
    n = len(codes)
    if n == 0:
        return codes
    if n < size:
        return mix((codes * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    out = codes[: n - size + 1] * _PLACES[0]
    for k in range(1, size):
        out += codes[k : n - size + 1 + k] * _PLACES[k]
    return mix(out + np.uint64(size))


def distinct(codes: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    codes = np.sort(codes)
    if len(codes) < 2:
        return codes
    return codes[np.concatenate(([True], codes[1:] != codes[:-1]))]


def row_words(data: np.ndarray, at: np.ndarray, kind: np.ndarray, lower: bool):
    """(row, word codes) of each row of a column; its arrays take some 50 bytes for each byte of a chunk."""
    for a, b in chunks(at, 1 << 18):
        words = Words(data, at[a : b + 1], kind, lower)
        for k in range(b - a):
            yield a + k, words.codes[words.first[k] : words.first[k + 1]]
