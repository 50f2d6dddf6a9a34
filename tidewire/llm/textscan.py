"""Vectorised views of Arrow text columns: words, chunks and their hashes, used inside Spark tasks.

Everything works on the UTF-8 bytes of a run of rows at once. A row's null text counts as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer row is handled alone, its bytes in parts of this size.
SLICE_BYTES = 1 << 20

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) over an array."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets of the rows in those bytes)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + max_bytes, "right")) - 1)
        yield a, b, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        a = b


#: The low 0 to 8 bytes of a number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Runs of more bytes are hashed (and compared) one by one.
LONG_RUN = 256


def eights(data: np.ndarray) -> np.ndarray:
    """At each byte, the eight bytes from there on as one number (zeros beyond the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, view: np.ndarray | None = None) -> np.ndarray:
    """A hash of each run of bytes, eight of them at a time, each mixed into what came before.

    Who needs certainty compares the bytes (equal_runs); who can't uses two seeds.
    """
    view = eights(data) if view is None else view
    size = ends - starts
    salt = U64(seed * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)
    out = mix((size.astype(U64) * U64(0x9E3779B97F4A7C15) + salt) ^ (view[starts] & _LOW[np.minimum(size, 8)]))
    live, k = np.flatnonzero((size > 8) & (size <= LONG_RUN)), 8
    while len(live):
        out[live] = mix((out[live] + salt + U64(k)) ^ (view[starts[live] + k] & _LOW[np.minimum(size[live] - k, 8)]))
        k += 8
        live = live[size[live] > k]
    for i in np.flatnonzero(size > LONG_RUN).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=str(seed).encode()).digest()
        out[i] = U64(int.from_bytes(digest, "little"))
    return out


def equal_runs(view: np.ndarray, starts: np.ndarray, other: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether runs of at most LONG_RUN bytes are equal; both views are of eights()."""
    equal = np.ones(len(size), bool)
    live, k = np.flatnonzero(size > 0), 0
    while len(live):
        low = _LOW[np.minimum(size[live] - k, 8)]
        equal[live] &= (view[starts[live] + k] & low) == (other[at[live] + k] & low)
        k += 8
        live = live[size[live] > k]
    return equal


#: Bytes that part words: space and 0x09 to 0x0D.
_PARTS_WORDS = np.zeros(256, bool)
_PARTS_WORDS[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the end): words are runs of other bytes than space and 0x09-0x0D."""
    starts, ends = _runs(~_PARTS_WORDS, data, offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def _runs(member: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of bytes of a class, within rows; the bytes are looked at in parts of bounded size."""
    starts, ends = [], []
    for a in range(0, len(data), SLICE_BYTES):
        b = min(a + SLICE_BYTES, len(data))
        inside = np.zeros(b - a + 2, bool)  # with one byte before and one after
        inside[1:-1] = member[data[a:b]]
        inside[0], inside[-1] = a > 0 and member[data[a - 1]], b < len(data) and member[data[b]]
        edge = np.zeros(b - a + 1, bool)
        edge[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a] = True
        starts.append(np.flatnonzero(inside[1:-1] & (edge[:-1] | ~inside[:-2])) + a)
        ends.append(np.flatnonzero(inside[1:-1] & (edge[1:] | ~inside[2:])) + a + 1)
    return (np.concatenate(starts), np.concatenate(ends)) if starts else (np.zeros(0, np.int64),) * 2


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two runs one after the other, from their hashes."""
    return mix(a * U64(0xD6E8FEB86659FD93) + (b >> U64(29) | b << U64(35)))


class WordRuns:
    """The words of one slice and hashes of runs of consecutive words, computed when asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seed: int = 0):
        self.data, self.seed = data, seed
        self.starts, self.ends, self.rows = words(data, offsets)
        self.known: dict[int, np.ndarray] = {}

    def part(self, a: int, b: int, seed: int = 0) -> WordRuns:
        """The words a to b alone, of the same rows."""
        out = object.__new__(WordRuns)
        first, last = (int(self.starts[a]), int(self.ends[b - 1])) if a < b else (0, 0)
        out.data, out.seed, out.known = self.data[first:last], seed, {}
        out.starts, out.ends, out.rows = self.starts[a:b] - first, self.ends[a:b] - first, np.clip(self.rows, a, b) - a
        return out

    def of(self, size: int) -> np.ndarray:
        """The hash of the `size` words from each word on: of its halves, a power of two first."""
        if size not in self.known:
            if size == 1:
                self.known[1] = byte_hashes(self.data, self.starts, self.ends, self.seed)
            else:
                whole = len(self.starts) - size + 1
                if whole <= 0:
                    return np.zeros(0, U64)
                first = 1 << (size - 1).bit_length() - 1
                self.known[size] = joined(self.of(first)[:whole], self.of(size - first)[first : first + whole])
        return self.known[size]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class KeyTable:
    """Numbers 64-bit keys in order of arrival; looks up whole arrays (open addressing, linear probing)."""

    def __init__(self):
        self.count = 0
        self._room(1 << 14)

    def _room(self, size: int) -> None:
        self.mask = size - 1
        self.keys, self.values = np.zeros(size, U64), np.zeros(size, np.int32)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1 where a key is new."""
        out, todo, at = np.full(len(keys), -1, np.int64), np.arange(len(keys)), (keys & U64(self.mask)).astype(np.int64)
        while len(todo):
            found = self.keys[at]
            hit = found == keys
            out[todo[hit]] = self.values[at[hit]]
            left = ~hit & (found != 0)
            todo, keys, at = todo[left], keys[left], (at[left] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Numbers distinct new keys, none of them 0."""
        if 2 * (self.count + len(keys)) > self.mask:
            used = self.keys != 0
            old, numbers = self.keys[used], self.values[used]
            self._room(1 << int(2 * (self.count + len(keys))).bit_length())
            self._put(old, numbers)
        self._put(keys, np.arange(self.count, self.count + len(keys)))
        self.count += len(keys)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at = (keys & U64(self.mask)).astype(np.int64)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            won = free & (self.keys[at] == keys)
            self.values[at[won]] = numbers[won]
            keys, numbers, at = keys[~won], numbers[~won], (at[~won] + 1) & self.mask
