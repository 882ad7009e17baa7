"""NumPy kernels over the UTF-8 bytes of many texts at once.

A word is a run of the characters outside \\x00-\\x2F, \\x3A-\\x60 and
\\x7B-\\x7F after A-Z are lower-cased: letters and digits of ASCII and every
character beyond it. On UTF-8 bytes that is the class 0-9, a-z, A-Z, >= 0x80.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from polarmesh.llm.shared import as_large

_bytes = np.arange(256)
IS_WORD = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x41) & (_bytes <= 0x5A)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)
LOWER = np.where((_bytes >= 0x41) & (_bytes <= 0x5A), _bytes + 32, _bytes).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
BASE = np.uint64(0xD6E8FEB86659FD93)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and the offset of each text (one more than there are texts)."""
    texts = as_large(column)
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts in order, and the offset of each text among them."""
    inside = IS_WORD[data]
    first = inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = inside[edges]
    counts = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=counts[1:])
    by_text = counts[offsets]
    kept = LOWER[data[inside]]
    starts = np.flatnonzero(first[inside])
    if not len(starts):
        return np.zeros(0, np.uint64), by_text
    lengths = np.diff(starts, append=len(kept))
    powers = np.cumprod(np.full(int(lengths.max()), BASE, np.uint64))
    place = np.arange(len(kept)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(BYTE_CODES[kept] * powers[place], starts)), by_text


def shingles(hashes: np.ndarray, by_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of `size` words that lies in one text; a shorter text that has words makes one shingle."""
    n = np.diff(by_text)
    made = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_by_text = np.concatenate([[0], np.cumsum(made)])
    total = int(out_by_text[-1])
    if not total:
        return np.zeros(0, np.uint64), out_by_text
    text = np.repeat(np.arange(len(n)), made)
    at = by_text[:-1][text] + np.arange(total) - out_by_text[:-1][text]
    left = by_text[1:][text] - at
    out = np.zeros(total, np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for k in range(size):
        word = np.where(left > k, padded[at + k], np.uint64(k + 1))
        out = out * BASE + word
    return mix(out), out_by_text


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The byte at which each word of `words` starts."""
    inside = IS_WORD[data]
    first = inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = inside[edges]
    return np.flatnonzero(first)
