"""Recompression of word sequences: rounds that name runs and pairs alike wherever they stand.

Names are 64-bit hashes of what they stand for, so every task gives equal word sequences equal names
without a dictionary. In the first round a maximal run of one word becomes a symbol; in each round the
symbols are parted into left and right ones by a hash bit, and a left one followed by a right one becomes
a new symbol. With each symbol goes the span of words that decided it: equal spans always give the symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Words of the longest named run, words of the longest symbol, and rounds.
RUN, LONGEST, ROUNDS = 16, 24, 8
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


@dataclass
class Symbols:
    """Symbols of many documents: name, length in words, and the span [low, high) of words that decides each."""

    names: np.ndarray
    lengths: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray


def of_words(names: np.ndarray, doc: np.ndarray) -> Symbols:
    at = np.arange(len(names), dtype=np.int32)
    return Symbols(names, np.ones(len(names), np.int32), at, at + 1, doc)


def name_runs(s: Symbols) -> Symbols:
    """Maximal runs of up to RUN words become one symbol; longer ones stay words, decided by RUN words to each side."""
    n = len(s.names)
    if not n:
        return s
    new = np.ones(n, bool)
    new[1:] = (s.names[1:] != s.names[:-1]) | (s.doc[1:] != s.doc[:-1])
    begins = np.flatnonzero(new)
    lengths = np.diff(np.append(begins, n)).astype(np.int32)
    long = lengths > RUN
    parts = np.where(long, lengths, 1)
    at = np.repeat(begins, parts) + (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * np.repeat(long, parts)
    size = np.repeat(np.where(long, 1, lengths), parts).astype(np.int32)
    radius = np.repeat(np.where(long, RUN, 1), parts).astype(np.int32)
    names = s.names[at]
    names = np.where(size > 1, mixed(names + size.astype(np.uint64) * _B), names)
    at = at.astype(np.int32)
    # A neighbour that is missing or of another document decides too: such spans reach out of the document.
    return Symbols(names, size, at - radius, at + size + radius, s.doc[at])


def name_pairs(s: Symbols, round_number: int) -> Symbols:
    n = len(s.names)
    if n < 2:
        return s
    right = (mixed(s.names + np.uint64(round_number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(63)).astype(bool)
    pair = ~right[:-1] & right[1:] & (s.doc[1:] == s.doc[:-1]) & (s.lengths[1:] + s.lengths[:-1] <= LONGEST)
    first, second = np.append(pair, False), np.append(False, pair)
    single = ~(first | second)
    low, high = s.low.copy(), s.high.copy()
    # What stays alone stays so because of its right neighbour (left ones) or its left neighbour (right ones).
    same = s.doc[1:] == s.doc[:-1]
    after = np.append(np.where(same, s.high[1:], 1 << 30), 1 << 30).astype(np.int32)
    after_low = np.append(np.where(same, s.low[1:], s.low[:-1]), s.low[-1:]).astype(np.int32)
    before = np.append(-1 << 30, np.where(same, s.low[:-1], -1 << 30)).astype(np.int32)
    before_high = np.append(s.high[:1], np.where(same, s.high[:-1], s.high[1:])).astype(np.int32)
    by_after, by_before = single & ~right, single & right
    high[by_after] = np.maximum(high, after)[by_after]
    low[by_after] = np.minimum(low, after_low)[by_after]
    low[by_before] = np.minimum(low, before)[by_before]
    high[by_before] = np.maximum(high, before_high)[by_before]
    i = np.flatnonzero(first)
    names, lengths = s.names.copy(), s.lengths.copy()
    names[i] = mixed(s.names[i] * _A + mixed(s.names[i + 1] + _B))
    lengths[i] += s.lengths[i + 1]
    low[i], high[i] = np.minimum(s.low[i], s.low[i + 1]), np.maximum(s.high[i], s.high[i + 1])
    keep = ~second
    return Symbols(names[keep], lengths[keep], low[keep], high[keep], s.doc[keep])


def window_keys(names: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """For every word that begins a window inside its document, the name of the longest symbol decided inside it.

    Only the window's words enter: equal windows have equal keys. 0 where no window begins.
    """
    n = len(names)
    top = window.bit_length() - 1
    best = np.zeros((top + 1, n), np.uint64)
    ends = np.searchsorted(doc, doc, side="right") if n else doc
    starts = np.searchsorted(doc, doc, side="left") if n else doc

    def offer(s: Symbols) -> None:
        first, last = s.high - window, s.low
        inside = (s.low >= 0) & (s.high <= n) & (last >= first)
        f, l = first[inside], last[inside]
        d_low, d_high = starts[s.low[inside]], ends[s.low[inside]]
        ok = (s.low[inside] >= d_low) & (s.high[inside] <= d_high) & (doc[s.low[inside]] == s.doc[inside])
        f, l = np.maximum(f, d_low), np.minimum(l, d_high - window)
        ok &= f <= l
        f, l = f[ok], l[ok]
        rank = (np.minimum(s.lengths[inside][ok], 63).astype(np.uint64) << np.uint64(58)) | (mixed(s.names[inside][ok]) >> np.uint64(6))
        k = np.frexp((l - f + 1).astype(np.float64))[1] - 1
        flat = best.reshape(-1)
        np.maximum.at(flat, k * n + f, rank)
        np.maximum.at(flat, k * n + l - (1 << k) + 1, rank)

    s = of_words(names, doc)
    offer(s)
    s = name_runs(s)
    for r in range(1, ROUNDS + 1):
        s = name_pairs(s, r)
        if r % 2 == 0:
            offer(s)
    for k in range(top, 0, -1):
        half = 1 << (k - 1)
        np.maximum(best[k - 1], best[k], out=best[k - 1])
        np.maximum(best[k - 1][half:], best[k][:-half], out=best[k - 1][half:])
    return best[0]
