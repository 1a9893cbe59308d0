"""Array-at-a-time words, n-gram hashes and distinct sets of Arrow text columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Hashes are 64-bit and depend on
the word's bytes only, so every task on every machine computes the same ones.  They are chains of
mixers that no power of a base runs through, so texts have no common structure by which they could
collide: words of up to eight bytes of one length never do, others by chance alone (2**-64 a pair and hash).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Seeds and odd multipliers of the independent hashes (arbitrary, fixed so that runs agree).
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_STEPS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Words beyond this many bytes are hashed one by one.
_LONG = 64
#: The lowest n bytes of a 64-bit number.
_LOWEST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)


class Words(NamedTuple):
    """Words of a run of documents; those of document d are first[d]:first[d + 1]."""

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: tuple[np.ndarray, ...]

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _spell(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """The hash of each run of bytes start:end: eight bytes at a time, each step mixed into the last."""
    size = end - start
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    seed, step = U(SEEDS[which]), U(_STEPS[which])
    out = mix((eight[start] & _LOWEST[np.minimum(size, 8)]) ^ mix(size.astype(U) + seed))
    left, done = np.flatnonzero(size > 8), 8
    while len(left) and done < _LONG:
        more = eight[start[left] + done] & _LOWEST[np.minimum(size[left] - done, 8)]
        out[left] = mix(out[left] * step + mix(more + seed))
        done += 8
        left = left[size[left] > done]
    for i in left.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), SEEDS[which])
    return out


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker gives the memory that it no longer uses back to the system: Spark keeps workers for later tasks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's, where it has it
        if trim is not None:
            trim(0)

    return each


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, end to end, and each document's offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `most` bytes of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(column: pa.Array, lower: bool = False, hashes: int = 1, apart: np.ndarray = _SPACE) -> Words:
    """Find and hash the words of every text; with `lower`, A-Z count as a-z. `apart` marks the bytes between words."""
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not(apart[data], out=inside[:-1])
    opens = inside[:-1].copy()
    opens[1:] &= ~inside[:-2] if len(data) > 1 else opens[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    opens[cuts] = inside[cuts]
    closes = inside[:-1] & ~inside[1:]
    before = cuts - 1
    closes[before] = inside[before]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, first, start, end, tuple(_spell(data, start, end, i) for i in range(hashes)))


def prefix_hashes(w: Words, n: int) -> np.ndarray:
    """The hash of each word's first n bytes; a shorter word's is its own hash."""
    return _spell(w.data, w.start, np.minimum(w.start + n, w.end), 0)


def grams(w: Words, k: int, which: int = 0) -> np.ndarray:
    """The hash of the k words from each position on; see `gram_starts` for where that is meaningful."""
    run, step = w.hashes[which], U(_STEPS[1 - which])
    if len(run) < k:
        return np.zeros(0, dtype=U)
    out, have, span = None, 0, 1
    while True:  # runs of 1, 2, 4, ... words, of which the binary digits of k say which make up the k words
        if k & span:
            n = len(w.hashes[which]) - have - span + 1
            out = run[have : have + n] if out is None else mix(out[:n] * step + mix(run[have : have + n] + U(have)))
            have += span
        if have == k:
            return mix(out + U(k))
        run = mix(run[:-span] * step + run[span:])
        span *= 2


def gram_counts(w: Words, k: int) -> np.ndarray:
    """How many k-word runs each document has; they start at first[d], first[d] + 1, ..."""
    return np.maximum(np.diff(w.first) - k + 1, 0)


def gram_starts(w: Words, k: int) -> np.ndarray:
    """All positions from which k words of one document follow."""
    n = gram_counts(w, k)
    return np.repeat(w.first[:-1], n) + runs(n)


def runs(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1, ..."""
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)


def shingle_sets(w: Words, k: int = 5) -> list[np.ndarray]:
    """Each document's sorted distinct k-word shingles; a shorter text is one shingle, an empty one none."""
    by = {k: grams(w, k)}
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        n = min(b - a, k)
        if n not in by:
            by[n] = grams(w, n) if n else np.zeros(0, dtype=U)
        own = np.sort(by[n][a : b - n + 1]) if n else by[n]
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if n else own)
    return out


def shingles_of(text: str | None, k: int = 5) -> frozenset[tuple[bytes, ...]]:
    """One text's shingles word by word (A-Z lower-cased), to confirm what hashes suggest."""
    found = (text or "").encode().lower().split()
    return frozenset(zip(*(found[i:] for i in range(k)))) if len(found) >= k else frozenset([tuple(found)] if found else [])
