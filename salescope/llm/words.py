"""Words and their fingerprints, for whole Arrow batches of texts at a time.

All work is done on the UTF-8 bytes with numpy. A word's fingerprint is a polynomial
hash over random 64-bit byte values, mixed at the end, so that no Python object is made
per word. Texts are taken in pieces of about a megabyte, which bounds the memory; a
longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

# Bytes that part words, and bytes that make up words of letters and digits.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_RANGES = ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

#: True for the bytes of words that are parted by white space.
BY_SPACE = np.ones(256, bool)
BY_SPACE[list(SPACE_BYTES)] = False
#: True for the bytes of words that hold letters, digits and everything beyond ASCII.
BY_LETTERS = np.zeros(256, bool)
for _low, _high in WORD_RANGES:
    BY_LETTERS[_low : _high + 1] = True

_random = np.random.Generator(np.random.PCG64(20_240_517))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z count as a-z
_BASE = int(_random.integers(1 << 61, 1 << 63, dtype=np.uint64)) | 1
_ORDER = _random.integers(1 << 61, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(value: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 bits."""
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``length`` of each at least."""
    size = 1 << max(20, int(length).bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers.clear()
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[size]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; NULL is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    content = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return content[ends[0] : ends[-1]], ends - ends[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold up to ``most`` bytes together, or one text."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last


def word_spans(
    data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words start in those."""
    inside = alphabet[data]
    texts = offsets[:-1][offsets[1:] > offsets[:-1]]
    before = np.concatenate(([False], inside[:-1]))
    before[texts] = False
    after = np.concatenate((inside[1:], [False]))
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """Running polynomial hash; entry i covers the first i bytes."""
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    return total


def span_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of spans, from the running hash; equal spans have equal ones."""
    _, down = powers(len(total))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashed_words(
    data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the lower-cased words, and where each text's words start."""
    starts, ends, first = word_spans(data, offsets, alphabet)
    return span_hash(prefix_hash(data), starts, ends), first


def gram_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all runs of ``size`` words, across texts too."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.full(count, size, np.uint64)
    for k in range(size):
        total += words[k : k + count] * _ORDER[k]
    return mix(total)


def gram_hash_at(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The same for the runs that start at some words only."""
    total = np.full(len(at), size, np.uint64)
    for k in range(size):
        total += words[at + k] * _ORDER[k]
    return mix(total)
