"""Vectorised word access: a batch of texts as integer codes into its distinct words.

Work that depends on a word alone is then done once per distinct word and
spread to all occurrences with numpy.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

T = TypeVar("T")

#: Bytes of text handled at a time within an Arrow batch; longer single texts pass alone.
SLICE_BYTES = 4 << 20


_HELD: dict = {}


def held_in_worker(key: Hashable, build: Callable[[], T]) -> T:
    """What `build` makes, kept in this Python worker for later tasks of the same kind.

    One thing is kept at a time: work of another kind gives its memory back first.
    """
    if key not in _HELD:
        release_worker()
        _HELD[key] = build()
    return _HELD[key]


def release_worker() -> None:
    """Give back what held_in_worker keeps, and memory that allocators hold unused (on the driver: the latter)."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def release_held() -> None:
    """For work that keeps nothing itself: give back what earlier tasks in this worker kept."""
    if _HELD:
        release_worker()


def plain_strings(column: pa.Array) -> pa.Array:
    """`column` as text without nulls (null counts as empty), in memory of its own.

    Some Arrow kernels misread slices of long strings, so no slice is passed on.
    """
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    return pa.concat_arrays([texts, pa.array([], pa.large_string())])


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of `batch` with at most `limit` bytes of `column` each (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class WordBatch:
    """Distinct words of some texts, and each text's words as codes in order.

    codes[offsets[i]:offsets[i + 1]] are the words of text i.
    """

    def __init__(self, pieces: pa.Array, drop_empty: bool = True):
        offsets = pieces.offsets.to_numpy().astype(np.int64)
        flat = pieces.values if len(pieces) else pieces.flatten()
        encoded = flat.dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = offsets - offsets[0]
        self.words: pa.Array = encoded.dictionary
        if drop_empty and len(self.words):
            empty = pc.index(self.words, "").as_py()
            if empty >= 0:
                keep = codes != empty
                before = np.concatenate(([0], np.cumsum(keep)))
                offsets, codes = before[offsets], codes[keep]
        self.codes, self.offsets = codes, offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owners(self) -> np.ndarray:
        """For each word occurrence, the number of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of per-occurrence `values` by text."""
        total = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def whitespace_words(texts: pa.Array, lower_ascii: bool = False) -> WordBatch:
    """Words `[^\\x20\\x09-\\x0D]+` of each text, in order.

    lower_ascii: the words' A-Z are lower-cased, after which some may be equal.
    """
    batch = WordBatch(pc.ascii_split_whitespace(texts))
    if lower_ascii:
        batch.words = pc.ascii_lower(batch.words)
    return batch


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, .. of each run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    first = starts - (ends - lengths)
    small = total < 1 << 30 and (not len(first) or max(int(first.max()), -int(first.min())) < 1 << 30)
    out = np.repeat(first.astype(np.int32 if small else np.int64), lengths)
    out += np.arange(total, dtype=out.dtype)
    return out


class WordMemory:
    """Remembers a ragged list of integers for each of the words met so far.

    `compute` gives the lengths of some words' lists and all their integers in
    a row. The words stay in one Arrow array, a few bytes each. It is only a
    cache: beyond `most` words or `most_bytes` it keeps those in use and starts
    anew, so results never depend on it.
    """

    def __init__(self, compute: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000, dtype=np.int32, most_bytes: int = 48 << 20):
        self.compute, self.most, self.most_bytes = compute, most, most_bytes
        self.known = pa.array([], pa.large_string())
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, dtype)

    def lists(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, lengths, flat): word i's integers are flat[starts[i]:starts[i] + lengths[i]]."""
        words = words.cast(pa.large_string())
        found = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(found < 0)
        if len(self.known) + len(missing) > self.most or self.known.nbytes + self.flat.nbytes > self.most_bytes:
            kept = np.unique(found[found >= 0])
            self.flat = self.flat[ragged_take(self.starts[kept], self.lengths[kept])]
            self.lengths = self.lengths[kept]
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.known = self.known.take(pa.array(kept))
            found[found >= 0] = np.searchsorted(kept, found[found >= 0])
        if len(missing):
            new = words.take(pa.array(missing))
            sizes, values = self.compute(new.to_pylist())
            found[missing] = np.arange(len(self.known), len(self.known) + len(missing))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
            self.lengths = np.concatenate((self.lengths, sizes))
            self.flat = np.concatenate((self.flat, values.astype(self.flat.dtype)))
            self.known = pa.concat_arrays([self.known, new])
        return self.starts[found], self.lengths[found], self.flat
