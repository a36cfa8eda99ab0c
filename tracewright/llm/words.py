"""Words of text slices as numpy arrays: occurrences, the distinct ones among them, and the letters of those."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracewright.llm.common import utf8

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True  # bytes of other characters
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of n texts, one after another: word w starts at byte starts[w] of data and is distinct word code[w];
    text t has the words bounds[t] to bounds[t + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    bounds: np.ndarray
    code: np.ndarray
    distinct: pa.Array

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        data, offsets = utf8(texts)
        space = _SPACE[data]
        new = ~space
        new[1:] &= space[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        new[first] = ~space[first]
        starts = np.flatnonzero(new)
        # each word with the white space after it, so that one buffer of offsets serves; the last one ends with data
        ends = np.append(starts, len(data)).astype(np.int64)
        held = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = held.dictionary_encode()
        return cls(data, offsets, starts, np.searchsorted(starts, offsets), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary)

    def lowered(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the distinct words, lower-cased (all scripts), and their offsets."""
        words = self.distinct.cast(pa.large_string())
        return utf8(pc.utf8_lower(words))


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and word of each run of letters within words."""
    letter = np.concatenate([_LETTER[data], [False]])
    new = letter.copy()
    new[1:] &= ~letter[:-1]
    inner = offsets[1:-1]
    new[inner] = letter[inner]
    starts = np.flatnonzero(new)
    stop = ~letter
    stop[offsets[1:]] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, "right")]
    return starts, ends - starts, np.searchsorted(offsets, starts, "right") - 1


def first_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each run as a little-endian number, zero beyond its end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[starts].copy().view("<u8").ravel()
    return eight & low_bytes(np.minimum(lengths, 8))


def low_bytes(n: np.ndarray) -> np.ndarray:
    bits = np.asarray(n, np.uint64) * np.uint64(8)
    return np.where(bits >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))
