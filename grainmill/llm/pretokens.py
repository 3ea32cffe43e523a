"""Cutting UTF-8 text into the words of the byte-level BPE pattern, whole batches at a time.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\s L N]+|\\s+(?!\\S)|\\s+``.  Which characters start a word follows
from the classes of a character and its neighbours, so a batch of texts is cut with array operations
on the Arrow buffer itself; no string is made.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# Unicode White_Space, and the contractions of the pattern.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def class_table() -> np.ndarray:
    """The class of each code point, as uint8."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    cat = unicodedata.category
    for c in range(sys.maxunicode + 1):
        k = cat(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def word_starts(data: np.ndarray, doc_from: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Byte positions at which words start.

    ``data``: the bytes of the texts, one after another; ``doc_from``: the byte at which each non-empty text starts, ascending, the first 0.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
    b0 = data[lead].astype(np.int32)
    pad = np.concatenate([data, np.zeros(4, np.uint8)])
    cp = b0.copy()
    two, three, four = (b0 >= 0xC0) & (b0 < 0xE0), (b0 >= 0xE0) & (b0 < 0xF0), b0 >= 0xF0
    for mask, bits in ((two, 0x1F), (three, 0x0F), (four, 0x07)):
        at = lead[mask]
        if len(at):
            k = {0x1F: 1, 0x0F: 2, 0x07: 3}[bits]
            v = b0[mask] & bits
            for i in range(1, k + 1):
                v = (v << 6) | (pad[at + i] & 0x3F)
            cp[mask] = v
    cls = table[cp]
    m = len(cp)
    first = np.zeros(m, bool)
    first[np.searchsorted(lead, doc_from)] = True
    prev = np.empty(m, np.uint8)
    prev[0] = OTHER
    prev[1:] = cls[:-1]
    prev_sp = np.zeros(m, bool)
    prev_sp[1:] = cp[:-1] == 0x20
    start = (cls != prev) | first
    word = cls != SPACE
    start &= ~(word & prev_sp & ~first)  # a single blank goes with the word after it
    # the last character of a run of white space stands apart when a word follows
    nxt_word = np.zeros(m, bool)
    nxt_word[:-1] = word[1:] & ~first[1:]
    start |= ~word & nxt_word
    quote = np.flatnonzero((cp == 0x27) & start)
    if len(quote):
        at = lambda k: np.where(quote + k < m, cp[np.minimum(quote + k, m - 1)], 0) * np.where(quote + k < m, ~first[np.minimum(quote + k, m - 1)], False)
        c1 = at(1)
        c2 = np.where(c1 > 0, at(2), 0)
        size = np.zeros(len(quote), np.int64)
        for w in CONTRACTIONS:
            hit = c1 == ord(w[0])
            if len(w) == 2:
                hit &= c2 == ord(w[1])
            size = np.where(hit & (size == 0), len(w) + 1, size)
        q, size = quote[size > 0], size[size > 0]
        start[q + 1] = False
        after = q + size
        after = after[after < m]
        start[after] = True
    return lead[start].astype(np.int64)


_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))


_MADE: dict[int, np.ndarray] = {}


def _powers(b: np.uint64, n: int) -> np.ndarray:
    have = _MADE.get(int(b))
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 21), b, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = _MADE[int(b)] = np.multiply.accumulate(out)
    return have[:n]


def span_hashes(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span.  Only for grouping within a batch; equality is not decided by it where the result depends on it."""
    n = len(data)
    with np.errstate(over="ignore"):
        s = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_B, n), out=s[1:])
        h = (s[end] - s[at]) * _powers(_INV, n)[at]
        h = h ^ (h >> np.uint64(29))
        return h * np.uint64(0xBF58476D1CE4E5B9) + (end - at).astype(np.uint64)


def distinct_spans(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first occurrence of each distinct word, the distinct word of each word).

    Words are grouped by hash and then compared byte by byte, eight at a time, so that a collision only costs a group of its own.
    """
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, inv = np.unique(span_hashes(data, at, end), return_index=True, return_inverse=True)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    rep = first[inv]
    other = rep != np.arange(len(at))
    live = np.flatnonzero(other)
    size = end - at
    differ = np.zeros(len(at), bool)
    differ[live] = size[live] != size[rep[live]]
    k = 0
    while len(live):
        live = live[(size[live] > k) & ~differ[live]]
        if not len(live):
            break
        left = np.minimum(8, size[live] - k).astype(np.uint64)
        x = (eight[at[live] + k] ^ eight[at[rep[live]] + k]) << ((np.uint64(8) - left) * np.uint64(8))
        differ[live[x != 0]] = True
        k += 8
    bad = np.flatnonzero(differ)
    if len(bad):
        inv = inv.copy()
        inv[bad] = len(first) + np.arange(len(bad))
        first = np.concatenate([first, bad])
    return first, inv


def text_slices(lengths: np.ndarray, most: int = 2_000_000):
    """(from, to) ranges of rows that hold at most ``most`` bytes together, or a single longer row."""
    i, n = 0, len(lengths)
    total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    while i < n:
        j = int(np.searchsorted(total, total[i] + most, side="right")) - 1
        j = max(j, i + 1)
        yield i, j
        i = j
