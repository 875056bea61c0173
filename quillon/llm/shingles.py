"""64-bit hashes of word shingles of whole texts, over the bytes of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once; a longer word is taken whole.
SEGMENT = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_WHITE] = 0
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which near numbers fall far apart."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text: runs of bytes other than white space, A-Z in lower case."""
    found = []
    at = 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data) and not _WHITE[data[end]]:  # up to the end of a word
            white = np.flatnonzero(_WHITE[data[end : end + SEGMENT]])
            end = end + int(white[0]) if len(white) else min(end + SEGMENT, len(data))
        found.append(_words(data[at:end]))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    b = _LOWER[data]
    word = ~_WHITE[b]
    start = word.copy()
    start[1:] &= ~word[:-1]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.empty(0, np.uint64)
    b = b[starts[0] :]
    starts = starts - starts[0]
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    powers = np.full(int(place.max()) + 1, _BASE, np.uint64)
    powers[0] = 1
    return mixed(np.add.reduceat(_BYTE[b] * np.multiply.accumulate(powers)[place], starts))


def shingle_set(data: np.ndarray, width: int = 3) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``width`` words; with fewer words, of the whole sequence."""
    words = word_hashes(data)
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    h = np.full(n, min(width, len(words)), np.uint64)
    for i in range(min(width, len(words))):
        h = h * _BASE + words[i : i + n]
    return np.unique(mixed(h))


def text_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text of a column; none for null."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield data[offsets[i] : offsets[i + 1]] if valid[i] else data[:0]
