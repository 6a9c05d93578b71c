"""Words and hashes of a whole Arrow batch of texts at once, in numpy, without a Python string per text.

Spark hands a batch of texts as one byte buffer with offsets. All words of the batch are found and
hashed by array operations on that buffer, so the cost is a few nanoseconds a byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_M = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[48:58] = True
IS_WORD = IS_LETTER | IS_DIGIT
IS_WORD[ord("_")] = True
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _A
    return h ^ (h >> np.uint64(29))


def word_mask(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to words: letters, digits, underscore and all other than ASCII but its punctuation."""
    is_word = IS_WORD[raw]
    wide = np.flatnonzero(raw >= 0xC2)
    if len(wide):
        lead, after = raw[wide], raw[np.minimum(wide + 1, len(raw) - 1)]
        for at in (wide[(lead == 0xC2) & (after < 0xC0)], wide[(lead == 0xE2) & (after <= 0xAF)], wide[(lead == 0xE3) & (after == 0x80)], wide[lead == 0xEF]):
            is_word[at] = False
            for k in (1, 2):
                nxt = np.minimum(at + k, len(raw) - 1)
                is_word[nxt[(raw[nxt] & 0xC0) == 0x80]] = False
        for at in wide[lead == 0xF0]:  # symbols and pictographs
            is_word[at : at + 4] = False
    return is_word


@dataclass
class Words:
    """start, end: byte places; text: number of the text; hash: of the lower-cased word (ASCII letters)."""

    raw: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray

    def first_of(self) -> np.ndarray:
        """For each text the number of its first word, and one more entry for the end."""
        return np.searchsorted(self.text, np.arange(len(self.offsets)))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and where they lie within one text (places of the first word)."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text[:m] == self.text[n - 1 : n - 1 + m])
        total = np.zeros(len(at), np.uint64)
        for k in range(n):
            total = (total + self.hash[at + k]) * _M
            total ^= total >> np.uint64(27)
        return mix(total), at


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every run of set bytes; none goes over the end of a text."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    inner = offsets[:-1][offsets[:-1] < len(mask)]
    begins[inner] = mask[inner]
    start = np.flatnonzero(begins)
    stops = np.zeros(len(mask) + 1, bool)
    stops[:-1] = ~mask
    stops[offsets] = True
    ends = np.flatnonzero(stops)
    return start, ends[np.searchsorted(ends, start + 1)]


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    empty = np.zeros(0, np.int64)
    is_word = word_mask(raw)
    start, end = runs(is_word, offsets)
    if not len(start):
        return Words(raw, offsets, empty, empty, empty, np.zeros(0, np.uint64))
    length = end - start
    inside = LOWER[raw[is_word]].astype(np.uint64) + np.uint64(1)
    from_ = np.cumsum(length) - length
    place = np.arange(len(inside)) - np.repeat(from_, length)
    powers = np.ones(int(length.max()), np.uint64)
    powers[1:] = np.cumprod(np.full(len(powers) - 1, np.uint64(0x100000001B3)), dtype=np.uint64)
    hashed = mix(np.add.reduceat(inside * powers[place], from_) + length.astype(np.uint64) * _M)
    text = np.searchsorted(offsets, start, side="right") - 1
    return Words(raw, offsets, start, end, text, hashed)


def words_of_column(column: pa.Array) -> Words:
    return words_of(*text_buffer(column))


def hash_words(words: list[str]) -> np.ndarray:
    """The kernel's hashes of single words, in their order (every item must be one word)."""
    found = words_of_column(pa.array(words, pa.string()))
    if len(found.hash) != len(words):
        raise ValueError("each item must be one word")
    return found.hash


def count_in(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set in each piece bounds[i]:bounds[i+1]."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def portions(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 20) -> list[pa.RecordBatch]:
    """The batch in slices of about most_bytes bytes of text (at least one row), so that working arrays stay small and in cache."""
    if not batch.num_rows:
        return []
    _, offsets = text_buffer(batch.column(column))
    cuts, at = [0], 0
    while at < batch.num_rows:
        at = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        cuts.append(min(at, batch.num_rows))
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]
