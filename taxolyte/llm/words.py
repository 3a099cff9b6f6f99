"""Hashed words and word shingles of many texts at a time, for use inside Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes that are hashed at a time.
_SLICE = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    """x with its 64 bits mixed, in place."""
    x ^= x >> np.uint64(31)
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def hash_strings(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string (no nulls): of its bytes, each mixed with its place, the mixed sum."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    strings = strings.cast(pa.large_binary())
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2], np.uint8) if strings.buffers()[2] is not None else np.zeros(0, np.uint8)
    out = np.diff(ends).astype(np.uint64)
    for a in range(int(ends[0]), int(ends[-1]), _SLICE):  # bounds memory
        b = min(a + _SLICE, int(ends[-1]))
        first, last = np.searchsorted(ends, a, side="right") - 1, np.searchsorted(ends, b, side="left")
        cut = np.clip(ends[first : last + 1], a, b)
        size = np.diff(cut)
        place = np.arange(a, b) - np.repeat(ends[first:last], size)
        each = _mixed((place.astype(np.uint64) << np.uint64(8)) + data[a:b] + np.uint64(1))
        full = np.flatnonzero(size)  # reduceat can't sum nothing
        out[first + full] += np.add.reduceat(each, cut[full] - a)
    return _mixed(out)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which waits for other tasks, gives back memory that it holds but does not use."""

    @wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return own


def groups(texts: Iterable[str | None], chars: int = 2_000_000) -> Iterator[list[str]]:
    """Texts in lists of about so many characters; null is empty."""
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= chars:
            yield group
            group, size = [], 0
            pa.default_memory_pool().release_unused()
    if group:
        yield group
        pa.default_memory_pool().release_unused()


class Words:
    """The words of some texts: codes into a list of distinct words, and where each text begins.

    Words are runs of characters other than U+0020 and U+0009 to U+000D with A-Z in lower case; with
    strip, all letters are in lower case, ASCII punctuation at both ends goes, and what is then empty is
    no word.
    """

    def __init__(self, texts: list[str], strip: bool = False):
        array = pa.array(texts, pa.large_string())
        array = pc.utf8_lower(array) if strip else pc.ascii_lower(array)
        for space in "\t\n\v\f\r":
            array = pc.replace_substring(array, space, " ")
        lists = pc.split_pattern(array, " ")
        coded = pc.dictionary_encode(lists.flatten())
        self.distinct = coded.dictionary
        if strip:
            self.distinct = pc.utf8_trim(self.distinct, PUNCTUATION)
        self._keep(np.asarray(coded.indices), np.asarray(lists.offsets))

    @classmethod
    def of_chunks(cls, texts: list[str], lists: pa.Array, coded: pa.DictionaryArray) -> Words:
        """The words of texts that are split at U+0020 and line feeds, as lists of chunks and as codes of all chunks."""
        if any(space in text for space in "\t\v\f\r" for text in texts):  # chunks may hold several words
            return cls(texts)
        out = cls.__new__(cls)
        small = pc.dictionary_encode(pc.ascii_lower(coded.dictionary))
        out.distinct = small.dictionary
        out._keep(np.asarray(small.indices)[np.asarray(coded.indices)], np.asarray(lists.offsets))
        return out

    def _keep(self, codes: np.ndarray, offsets: np.ndarray) -> None:
        """Sets codes and offsets, without empty words."""
        word = (np.asarray(pc.binary_length(self.distinct)) > 0)[codes]
        self.codes = codes[word]
        self.offsets = np.concatenate([[0], np.cumsum(word)])[offsets]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word of all texts."""
        return self.distinct_hashes()[self.codes]

    def distinct_hashes(self) -> np.ndarray:
        """A 64-bit hash for each distinct word."""
        return hash_strings(self.distinct)


def fold(parts: list[np.ndarray], n: int) -> np.ndarray:
    """One 64-bit hash for each sequence of n words; parts are the words' hashes by place."""
    out = np.full(len(parts[0]), n, np.uint64) * _M2
    for part in parts:
        out = (out ^ part) * _M1
        out ^= out >> np.uint64(29)
    return out * _M2


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text in order, and where each text's begin.

    A text with fewer words has one for its whole sequence; one without words has none.
    """
    n = np.diff(offsets)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    begins = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(begins[-1], np.uint64)
    if len(hashes) >= k:
        size = len(hashes) - k + 1
        every = fold([hashes[i : i + size] for i in range(k)], k)
        full = n >= k
        inside = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(inside, offsets[:-1][full], 1)
        np.add.at(inside, offsets[1:][full] - k + 1, -1)
        long = np.repeat(full, counts)
        out[long] = every[np.cumsum(inside)[:size] > 0]
    for i in np.flatnonzero((n > 0) & (n < k)):
        a, b = offsets[i], offsets[i + 1]
        out[begins[i]] = fold([hashes[j : j + 1] for j in range(a, b)], int(b - a))[0]
    return out, begins
