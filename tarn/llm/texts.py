"""Words of whole batches of texts as Arrow arrays and NumPy codes, and mixed 64-bit hashes of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


@dataclass(frozen=True)
class Words:
    """``values`` are the words of all texts in a row, ``starts`` where each text's words begin, and the end."""

    values: pa.Array
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, the same for equal words, and the word of each number."""
        coded = self.values.dictionary_encode()
        return np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def lists(texts: pa.Array, split) -> Words:
    """The parts that ``split`` makes of each text, without empty ones; a null text has none."""
    parts = split(pc.fill_null(texts.cast(pa.large_string()), ""))
    values, ends = parts.flatten(), np.asarray(parts.offsets, dtype=np.int64)
    some = np.asarray(pc.binary_length(values), dtype=np.int64) > 0
    before = np.r_[0, np.cumsum(some)]
    return Words(values.filter(pa.array(some)), before[ends - ends[0]])


def words_of(texts: pa.Array) -> Words:
    """The words between the six ASCII blanks of each text."""
    return lists(texts, pc.ascii_split_whitespace)


def lowered(texts: pa.Array) -> pa.Array:
    """A-Z in lower case, all else as it is."""
    # Arrow's ascii_lower reads the wrong bytes of a large array that is a slice, so slices are copied first.
    whole = texts.take(pa.array(np.arange(len(texts)))) if texts.offset else texts
    return pc.ascii_lower(pc.fill_null(whole.cast(pa.large_string()), ""))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix that loses nothing."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64)
        z = (z ^ (z >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        z = (z ^ (z >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return z ^ (z >> np.uint64(33))


def followed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of ``left`` with ``right`` behind it."""
    with np.errstate(over="ignore"):
        return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


def word_hashes(words: pa.Array) -> np.ndarray:
    """XXH64 of each word, mostly called for the distinct ones."""
    return np.array([xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
