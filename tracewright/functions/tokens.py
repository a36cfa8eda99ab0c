"""Identifiers of many texts at once as 64-bit hashes, in numpy: executors call it on Arrow arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_WORD[[*range(97, 123), 95, *range(48, 58)]] = True
_DIGIT[48:58] = True


def identifier_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each occurrence of an identifier in the lower-cased texts, and the n + 1 bounds of the texts.

    Identifiers are [a-z_][a-z0-9_]*, as the function text.tokenize gives them; null texts have none.
    """
    lowered = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
    offsets = np.frombuffer(lowered.buffers()[1], np.int64, len(lowered) + 1, lowered.offset * 8) if len(lowered) else np.zeros(1, np.int64)
    data = lowered.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = _WORD[data]
    new = word.copy()
    new[1:] &= ~word[:-1]
    begin = offsets[:-1][np.diff(offsets) > 0]
    new[begin] = word[begin]
    runs = np.flatnonzero(new)
    if not len(runs):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    # a token begins at the first sign of a run that is no digit
    at = np.arange(len(data))
    starts = np.minimum.reduceat(np.where(word & ~_DIGIT[data], at, len(data)), runs)
    limit = np.append(runs[1:], len(data))
    starts = starts[starts < limit]
    inside = np.zeros(len(data) + 1, np.int64)
    inside[starts] = 1
    token = np.cumsum(inside[:-1]) - 1
    used = word & (token >= 0)
    # signs of a run before its token belong to the token before by count: they lie behind a gap
    run_of = np.cumsum(new) - 1
    used[used] = run_of[used] == run_of[starts[token[used]]]
    place = (at[used] - starts[token[used]]).astype(np.uint64)
    each = (place << np.uint64(8)) + data[used] + np.uint64(1)
    each *= np.uint64(0x9E3779B97F4A7C15)
    each = (each ^ each >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    each = (each ^ each >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    each ^= each >> np.uint64(31)
    own = token[used]
    hashes = np.add.reduceat(each, np.searchsorted(own, np.arange(len(starts)))).view(np.int64)
    return hashes, np.searchsorted(starts, offsets)
