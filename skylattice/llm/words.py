"""Words and lines of whole Arrow batches of texts, as numpy arrays of codes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``codes[offsets[i]:offsets[i + 1]]`` are row i's words, as places in ``distinct``."""

    codes: np.ndarray
    offsets: np.ndarray
    distinct: pa.Array

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def map(self, f: Callable[[str], int], dtype: type) -> np.ndarray:
        """``f`` of every word, worked out once for each distinct one."""
        found = np.fromiter((f(x) for x in self.distinct.to_pylist()), dtype, len(self.distinct))
        return found[self.codes] if len(found) else np.zeros(0, dtype)


def split_words(texts: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (no nulls)."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten().dictionary_encode()
    codes, offsets = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    empty = pc.index(flat.dictionary, pa.scalar("", flat.dictionary.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        codes, offsets = codes[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
    return Words(codes, offsets, flat.dictionary)


def windows(values: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every run of ``size`` values that lies within one row, and where each run starts."""
    if len(values) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.arange(len(values) - size + 1)
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    starts = starts[starts + size <= row_end[starts]]
    hashed = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            hashed = mix(hashed * _GOLDEN + values[starts + i].astype(np.uint64) + np.uint64(i + 1))
    return hashed, starts
