"""Vectorised tokenising and hashing of Arrow text columns.

The functions work on the UTF-8 bytes of a whole batch at once: a text column
becomes one byte buffer with document offsets, words become index arrays into
it, and hashes of words and word windows become ``uint64`` arrays.  Nothing
here loops over characters or words in Python.

Word identity is a 64-bit hash.  Hashes are trees of mixed pieces, nowhere sums
over places, so that no pattern of bytes or words makes two of them meet by
construction; two different words, or two different windows, meet with a
probability of about 2**-64 a pair.  Whole texts and whole word sequences are
told apart by 128 bits of a cryptographic hash (``digests``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 1_000_000

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
#: Where an odd one out has no neighbour.
_LONE = np.uint64(0xD6E8FEB86659FD93)
#: One a hash function: those of different salts have nothing in common.
_SALTS = [np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x8B72E5A3C6D9F04E)]
#: The first bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = ~_byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
PLAIN = _byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of one longer row."""
    if not len(column):
        return
    raw, off = buffers(column)
    first = 0
    while first < len(off) - 1:
        end = int(np.searchsorted(off, off[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(off) - 1)
        yield first, end, raw[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[raw]


def words(raw: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the offsets of each document's words."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = kind[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = off[(off > 0) & (off < n)]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the input reaches every bit of the output; one to one."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def folded(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One hash for each run of ``count`` (one at least) hashes that follow each other: pairs are mixed, then pairs of those."""
    out, live = np.empty(len(count), np.uint64), np.arange(len(count))
    while True:
        off = np.cumsum(count) - count
        done = count == 1
        out[live[done]] = h[off[done]]
        live, off, count = live[~done], off[~done], count[~done]
        if not len(live):
            return out
        half = (count + 1) // 2
        inner = np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half)
        left = np.repeat(off, half) + 2 * inner
        paired = 2 * inner + 1 < np.repeat(count, half)
        h = mixed(h[left] * _MULT + np.where(paired, h[np.minimum(left + 1, len(h) - 1)], _LONE))
        count = half


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of each run of bytes: its pieces of eight bytes, mixed, folded, and mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    seed, size = _SALTS[salt], ends - starts
    out = mixed((eights[starts] & _FIRST[np.minimum(size, 8)]) ^ seed)
    long = np.flatnonzero(size > 8)
    if len(long):
        count = (size[long] + 7) // 8
        at = np.repeat(starts[long] - 8 * (np.cumsum(count) - count), count) + 8 * np.arange(count.sum())
        held = np.minimum(np.repeat(ends[long], count) - at, 8)
        out[long] = folded(mixed((eights[at] & _FIRST[held]) ^ seed), count)
    return mixed(out * _MULT + size.astype(np.uint64))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbours; as many as fit, across documents too (see ``valid``)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, piece, size = None, 0, hashes, 1
    while True:  # binary expansion of the width
        if width & size:
            out = piece[: len(hashes)] if out is None else mixed(out[: len(piece) - have] * _MULT + piece[have : have + len(out)]) if len(out) + have <= len(piece) else mixed(out[: len(piece) - have] * _MULT + piece[have:])
            have += size
        if have == width:
            return out[:n]
        piece = mixed(piece[: len(piece) - size] * _MULT + piece[size:] + np.uint64(size))
        size *= 2


def valid(word_off: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the first n window starts lie in one document with all their words."""
    ends = np.repeat(word_off[1:], np.diff(word_off))[:n]
    return np.arange(n) + width <= ends


def sequences(hashes: np.ndarray, word_off: np.ndarray) -> np.ndarray:
    """One hash for each document's whole word sequence; 0 where it has no words."""
    count = np.diff(word_off)
    out = np.zeros(len(count), np.uint64)
    some = count > 0
    out[some] = mixed(folded(hashes, count[some]) * _MULT + count[some].astype(np.uint64))
    return out


def digests(parts: Iterable[bytes | memoryview]) -> np.ndarray:
    """128 bits of a cryptographic hash of each part, as two numbers: equal ones are taken to be equal parts."""
    return np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in parts), "<i8").reshape(-1, 2)
