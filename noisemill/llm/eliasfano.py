"""Elias-Fano sequences in numpy, and files of arrays that readers map into memory."""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np

_ONE = np.uint64(1)


def _select_bit(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the one bit of the given rank (from 0) in each word."""
    word, rank, at = word.copy(), rank.astype(np.int64), np.zeros(len(word), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << step) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        up = rank >= ones
        rank -= np.where(up, ones, 0)
        at += np.where(up, step, 0)
        word = np.where(up, word >> np.uint64(step), low)
    return at


class EliasFano:
    """A sorted sequence of unsigned integers: unary high parts, packed low parts.

    ``zeros`` and ``ones`` count the bits of each kind before every 64-bit word, which makes
    select a binary search over words and a few steps within one.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros, self.ones = n, bits, low, high, zeros, ones

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        top = (max(universe - 1, 0) >> bits) + 1 if n else 1
        marks = np.zeros(-(-(n + top) // 64) * 64, bool)
        marks[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(marks, bitorder="little").view("<u8")
        ones = np.zeros(len(high), np.int64)
        np.cumsum(np.bitwise_count(high[:-1]), out=ones[1:])
        zeros = np.arange(len(high)) * 64 - ones
        kind = np.uint32 if len(marks) < 1 << 32 else np.uint64
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if n and bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero(shift.astype(np.int64) + bits > 64)
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        return cls(n, bits, low, high, zeros.astype(kind), ones.astype(kind))

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.shape": np.array([self.n, self.bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros, f"{name}.ones": self.ones}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        return cls(*map(int, arrays[f"{name}.shape"]), *(arrays[f"{name}.{k}"] for k in ("low", "high", "zeros", "ones")))

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.int64) * self.bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        out = self.low[word] >> shift
        over = np.flatnonzero(shift.astype(np.int64) + self.bits > 64)
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.bits) - 1)

    def _position(self, counts: np.ndarray, words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(counts, rank.astype(counts.dtype), "right") - 1
        return word * 64 + _select_bit(words(word), rank - counts[word].astype(np.int64))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        high = self._position(self.ones, lambda w: self.high[w], at) - at
        return high.astype(np.uint64) << np.uint64(self.bits) | self._low(at)

    def _before(self, top: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``top``."""
        out = np.zeros(len(top), np.int64)
        some = np.flatnonzero(top)
        out[some] = self._position(self.zeros, lambda w: ~self.high[w], top[some] - 1) - (top[some] - 1)
        return out

    def find(self, values: np.ndarray, least: np.ndarray | None = None, most: np.ndarray | None = None) -> np.ndarray:
        """Each value's place, -1 where it is absent, searched as a successor within [least, most)."""
        if not self.n:
            return np.full(len(values), -1)
        top = (values >> np.uint64(self.bits)).astype(np.int64)
        a, b = self._before(top), self._before(top + 1)
        if least is not None:
            a, b = np.maximum(a, least), np.minimum(b, most)
        part, end = values & np.uint64((1 << self.bits) - 1), b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            below = self._low(middle) < part[open_]
            a[open_] = np.where(below, middle + 1, a[open_])
            b[open_] = np.where(below, b[open_], middle)
            open_ = open_[a[open_] < b[open_]]
        hit = np.flatnonzero(a < end)
        hit = hit[self._low(a[hit]) == part[hit]]
        out = np.full(len(values), -1)
        out[hit] = a[hit]
        return out


def put(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write the arrays as one file: under another name first, so that a repeated task does no harm."""
    names, at = {}, 0
    for k, v in arrays.items():
        names[k] = [at, len(v), v.dtype.str]
        at += -(-v.nbytes // 8) * 8
    head = json.dumps(names).encode()
    head += b" " * (-len(head) % 8)
    parts = [len(head).to_bytes(8, "little"), head]
    for v in arrays.values():
        parts += [np.ascontiguousarray(v).tobytes(), bytes(-v.nbytes % 8)]
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        os.makedirs(os.path.dirname(at.path), exist_ok=True)
        spare = f"{at.path}.{uuid.uuid4().hex}"
        with open(spare, "wb") as out:
            out.writelines(parts)
        os.replace(spare, at.path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path))
    with store.open_output_stream(path) as out:
        for x in parts:
            out.write(x)


#: Bytes of shards that a worker keeps where it can't map them into memory.
MOST_CACHED = 256 << 20
_cached: OrderedDict[str, np.ndarray] = OrderedDict()


def _fetched(uri: str) -> np.ndarray:
    """A file of an object store: read whole, kept until others need its place."""
    if uri in _cached:
        _cached.move_to_end(uri)
        return _cached[uri]
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        data = np.frombuffer(f.read(), np.uint8)
    _cached[uri] = data
    while len(_cached) > 1 and sum(x.nbytes for x in _cached.values()) > MOST_CACHED:
        _cached.popitem(last=False)
    return data


@lru_cache(maxsize=1024)
def _mapped(path: str) -> np.ndarray:
    return np.memmap(path, np.uint8, "r")


def mapped(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file: memory-mapped where the shared folder is mounted, else fetched."""
    at = urlparse(uri)
    data = _mapped(at.path) if at.scheme in ("", "file") else _fetched(uri)
    size = int(data[:8].view("<u8")[0])
    names = json.loads(bytes(data[8 : 8 + size]))
    return {k: data[8 + size + a : 8 + size + a + n * np.dtype(t).itemsize].view(t) for k, (a, n, t) in names.items()}
