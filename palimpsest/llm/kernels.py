"""Vectorised text kernels shared by the Arrow-batched operators.

Everything here works on one slice of an Arrow string column at a time: the UTF-8
bytes of all its texts in one numpy buffer plus the offsets of each text.  A slice
holds ``SLICE_BYTES`` of text, or one text when that is longer, so that memory does
not depend on the size of a partition.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

#: ASCII white space of the contracts: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_M1, _M2, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: A fixed random odd number for each byte value, from a seeded generator.
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 one), element by element."""
    with np.errstate(over="ignore"):
        x = x + _ODD * np.uint64(2 * seed + 1)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; nulls are empty texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    size = int(offsets[-1] - offsets[0]) if len(column) else 0
    raw = np.frombuffer(data, np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    give_back()


def give_back() -> None:
    """Hands freed memory back to the system: workers stay from task to task, and what they keep adds up on an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(out >= 65) & (out <= 90)] += 32
    return out


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes that are not in ``sep``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    w = ~sep[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] = w[heads]
    last[tails] = w[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, for buffers of ``size`` bytes."""
    if len(_powers[0]) < size:
        for k, base in enumerate((_ODD, _INVERSE)):
            table = np.full(max(size, 1 << 16), base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over random byte values, then mixed with the length.

    The buffer is multiplied by the running power once; each sum is shifted back by the inverse power of its start.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, inverse = _power_tables(len(data) + 1)
        terms = np.zeros(len(data) + 1, np.uint64)
        np.multiply(_BYTE[data], power[: len(data)], out=terms[:-1])
        cuts = np.empty(2 * len(starts), np.int64)
        cuts[::2], cuts[1::2] = starts, ends
        total = np.add.reduceat(terms, cuts)[::2] * inverse[starts]
        return mix(total ^ ((ends - starts).astype(np.uint64) << np.uint64(48)), 3)


def factorize(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each hash, the distinct hashes and where each occurs first."""
    import pandas as pd

    codes, distinct = pd.factorize(hashes)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1) > 0) if len(codes) else codes
    return codes, distinct, first


class Memo:
    """Remembers an array of numbers for each 64-bit key: sorted keys over one pool, at most ``limit`` keys."""

    def __init__(self, limit: int, dtype: type = np.uint32) -> None:
        self.limit, self.dtype = limit, dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.dtype)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys, and which of them are known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def add(self, keys: np.ndarray, size: np.ndarray, values: np.ndarray) -> None:
        """Adds new keys; ``values`` holds their arrays in a row.  Forgets the old ones when there is no room."""
        if len(self.keys) + len(keys) > self.limit:
            self.clear()
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        begin = np.cumsum(size) - size + len(self.pool)
        self.keys = np.insert(self.keys, at, keys[order])
        self.begin = np.insert(self.begin, at, begin[order])
        self.size = np.insert(self.size, at, size[order])
        self.pool = np.concatenate((self.pool, values.astype(self.dtype)))


def gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``pool[begin : begin + size]`` in a row."""
    place = np.cumsum(size) - size
    return pool[np.repeat(begin - place, size) + np.arange(int(size.sum()))]


def coded(memo: Memo, keys: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pool, begin, size) for distinct ``keys``; ``encode`` gives (values in a row, sizes) for the places not remembered."""
    order = np.argsort(keys)  # sorted keys are found much faster
    ranked = keys[order]
    at, known = memo.find(ranked)
    new = np.flatnonzero(~known)
    if len(new):
        values, size = encode(order[new])
        memo.add(ranked[new], size, values)
        at, known = memo.find(ranked)
        if not known.all():  # the memo was emptied: what it knew before must be made again
            rest = np.flatnonzero(~known)
            values, size = encode(order[rest])
            memo.add(ranked[rest], size, values)
            at, known = memo.find(ranked)
            if not known.all():
                raise ValueError("a slice has more distinct words than the memo may hold")
    back = np.empty_like(at)
    back[order] = at
    return memo.pool, memo.begin[back], memo.size[back]


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words of one text, and each text's place among them (n_docs + 1).

    A text of fewer words, but at least one, has its whole sequence as its one shingle.
    """
    count = np.bincount(doc, minlength=n_docs)
    made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    place = np.concatenate(([0], np.cumsum(made)))
    begin = np.cumsum(count) - count
    at = np.repeat(begin - place[:-1], made) + np.arange(place[-1])
    out = np.zeros(place[-1], np.uint64)
    room = np.repeat(np.minimum(count, size), made)
    with np.errstate(over="ignore"):
        for k in range(size):
            use = room > k
            out[use] = mix(out[use] * _M1 + hashes[at[use] + k], k + 5)
        out = mix(out ^ room.astype(np.uint64), 4)
    return out, place


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))
