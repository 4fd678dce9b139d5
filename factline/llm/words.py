"""Vectorised words of many texts at once: boundaries, 64-bit word hashes, n-gram hashes.

Words are runs without ASCII white space (0x20, 0x09-0x0D) in UTF-8. All functions take the
bytes of several texts laid end to end and the texts' offsets in them.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19  # texts handled at once; a longer text is handled alone

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_GOLD, _ODD = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BLOCKS = 8  # words of more than eight blocks of eight bytes are hashed one by one


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def slices(batch: pa.RecordBatch, name: str = "raw") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets of runs of texts of about SLICE_BYTES. Null texts are empty."""
    col = batch.column(batch.schema.get_field_index(name))
    large = pa.types.is_large_binary(col.type)
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if large else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def give_back() -> None:
    """Hand freed memory back to the system: Python workers outlive their tasks, and what they hold counts."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run):
    """A function of batches that gives memory back when it ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each text's first word (n + 1 of them)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = ~solid[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(solid & edge[:-1])
    edge[:-1] = ~solid
    edge[offsets] = True
    ends = np.flatnonzero(solid & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word's bytes, the same wherever the word stands.

    Blocks of eight bytes go through a bijection each, so words of up to seven bytes never
    collide; words over 64 bytes get a cryptographic hash. Seeds give independent hashes.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = LOWER[data] if lower else data
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    salt = _U(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    out = blocks[starts] & _MASKS[np.minimum(size, 8)]
    out ^= np.where(size < 8, size, 0).astype(np.uint64) << _U(56)
    out ^= salt
    out = _mixed(out)
    with np.errstate(over="ignore"):
        long = np.flatnonzero(size >= 8)
        at, left, h = starts[long], size[long], out[long]
        h = _mixed(h + left.astype(np.uint64) * _GOLD + _U(1))
        for k in range(1, _BLOCKS):
            out[long] = h
            more = np.flatnonzero(left > 8 * k)
            long, at, left, h = long[more], at[more], left[more], h[more]
            if not len(long):
                break
            h = _mixed((h ^ (blocks[at + 8 * k] & _MASKS[np.minimum(left - 8 * k, 8)])) * _ODD + salt)
        out[long] = h
    key = seed.to_bytes(8, "little")
    for k in np.flatnonzero(size > 8 * _BLOCKS).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(padded[starts[k] : ends[k]], digest_size=8, key=key).digest(), "little")
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ODD
    x += b
    return _mixed(x)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each index on; shorter than words by n - 1 (texts' borders are crossed).

    Hashes of 1, 2, 4 ... words are mixed pairwise, as in a hash tree; those that add up to n
    are mixed from left to right.
    """
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        run, length, out, done = words, 1, None, 0
        while True:
            if n & length:
                part = run[done : done + m]
                out = _mixed(part + _U(length)) if out is None else _pair(out[:m], part)
                done += length
            if done == n:
                return out
            run = _pair(run[:-length], run[length:])
            length *= 2


class Bitmap:
    """A Bloom filter of 64-bit hashes: few false positives (one in 400 or less below the bound) and no false negatives."""

    LEAST, MOST = 20, 30  # log2 of the bits: 128 KB to 128 MB, which is 2^26 keys at 16 bits each
    PROBES = 4

    def __init__(self, data: np.ndarray):
        self.data = data
        self.bits = (len(data) * 8).bit_length() - 1

    @classmethod
    def bits_for(cls, keys: int) -> int:
        """Sixteen bits or more a key, as far as MOST goes."""
        return min(cls.MOST, max(cls.LEAST, (16 * keys).bit_length()))

    @classmethod
    def empty(cls, bits: int) -> Bitmap:
        return cls(np.zeros(1 << (bits - 3), np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        mask = _U((1 << self.bits) - 1)
        at, step = keys & mask, (keys >> _U(34)) | _U(1)
        out = np.ones(len(keys), bool)
        left = np.arange(len(keys))
        for _ in range(self.PROBES):
            hit = (self.data[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1
            out[left[~hit]] = False
            left, step = left[hit], step[hit]
            at = (at[hit] + step) & mask
        return out
