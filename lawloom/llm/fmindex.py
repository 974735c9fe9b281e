"""A compressed full-text index (FM-index) over word sequences, searched for many patterns at once.

The words of all texts, each text closed by a separator, are numbered and sorted by suffix; the Burrows-Wheeler
transform is kept in a wavelet matrix whose bit vectors have block ranks. A pattern is found from its last word to its
first by two ranks a word, whatever the size of the index; occurrences are located by walking to the next sampled suffix
position. All steps work on arrays of patterns or rows, so Python's cost is per step, not per pattern.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in sorted order, by prefix doubling over those that still share a rank.

    0 is the separator: separators sort by position, before all words, so that no comparison runs past the end of a text.
    """
    n = len(symbols)
    ends = symbols == 0
    key = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + n)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def starts(sorted_keys: np.ndarray) -> np.ndarray:
        new = np.ones(len(sorted_keys), bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        return new

    new = starts(key[order])
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    size = np.diff(np.append(np.flatnonzero(new), n))
    active = order[(size > 1)[np.cumsum(new) - 1]]
    width = 1
    while len(active):
        key = rank[active] * n + rank[active + width]
        active = active[np.argsort(key, kind="stable")]
        old, key = rank[active], rank[active] * n + rank[active + width]
        group, new = starts(old), starts(key)
        at = np.arange(len(active))
        place = old + at - np.flatnonzero(group)[np.cumsum(group) - 1]
        which = np.cumsum(new) - 1
        rank[active] = place[np.flatnonzero(new)][which]
        size = np.diff(np.append(np.flatnonzero(new), len(active)))
        active = active[(size > 1)[which]]
        width *= 2
    order[rank] = np.arange(n)
    return order


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones before each position."""
        block, shift = at >> 6, (at & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << shift) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """The index of a list of texts; texts are numbered in their order."""

    def __init__(self, texts: Sequence[Sequence[str]], sample: int = 8) -> None:
        self.words: dict[str, int] = {}
        number = self.words
        symbols = np.fromiter((s for text in texts for s in (*(number.setdefault(w, len(number) + 1) for w in text), 0)), np.int32)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.size = len(symbols)
        order = suffix_array(symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(number) + 2))]).astype(np.int64)
        current = symbols[order - 1]
        self.levels: list[tuple[Bits, int]] = []
        self.depth = max(1, len(number).bit_length())
        for level in reversed(range(self.depth)):
            bit = (current >> level) & 1
            self.levels.append((Bits(bit.astype(np.uint8)), int(len(bit) - bit.sum())))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        every = np.arange(len(number) + 2, dtype=np.int64)
        self.origin = np.zeros(len(every), np.int64)
        self.origin = self._path(every, np.zeros(len(every), np.int64))
        sampled = order % sample == 0
        sampled |= np.isin(order, self.text_starts)
        self.marked, self.samples = Bits(sampled.astype(np.uint8)), order[sampled].astype(np.int32)

    def _path(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for depth, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.depth - 1 - depth)) & 1, zeros + ones, at - ones)
        return at - self.origin[symbol]

    def numbers(self, words: Sequence[str]) -> np.ndarray:
        """The numbers of words in this index, -1 for words that it doesn't have."""
        return np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For patterns (one a row, as numbers, all of one length): the half-open ranges of rows of the sorted suffixes that begin with them."""
        low, high = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        live = np.flatnonzero((patterns > 0).all(axis=1))
        if not len(live):
            return low, high
        last = patterns[live, -1]
        a, b = self.first[last], self.first[last + 1]
        for column in range(patterns.shape[1] - 2, -1, -1):
            found = a < b
            live, a, b = live[found], a[found], b[found]
            symbol = patterns[live, column]
            a, b = self.first[symbol] + self._path(symbol, a), self.first[symbol] + self._path(symbol, b)
        low[live], high[live] = a, b
        return low, high

    def matching(self, joined: np.ndarray, room: np.ndarray, size: np.ndarray, most: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every position of some joined texts (word numbers, -1 for unknown ones): the length of the longest match that
        ends there, and the range of the last size[position] words, empty where they don't occur.

        All positions are extended backwards at once, until their ranges are empty or room[position], the words of its
        text up to it, is used up; matches of more than most words count as most.
        """
        length, low, high = np.zeros(len(joined), np.int32), np.zeros(len(joined), np.int64), np.zeros(len(joined), np.int64)
        live = np.flatnonzero(joined > 0)
        a, b = self.first[joined[live]], self.first[joined[live] + 1]
        for step in range(1, most + 1):
            if step > 1:
                fits = room[live] >= step
                live, a, b = live[fits], a[fits], b[fits]
                symbol = joined[live - (step - 1)]
                known = symbol > 0
                live, a, b, symbol = live[known], a[known], b[known], symbol[known]
                a, b = self.first[symbol] + self._path(symbol, a), self.first[symbol] + self._path(symbol, b)
                found = a < b
                live, a, b = live[found], a[found], b[found]
            if not len(live):
                break
            length[live] = step
            asked = size[live] == step
            low[live[asked]], high[live[asked]] = a[asked], b[asked]
        return length, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the joined texts of rows of the sorted suffixes."""
        out, live, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.astype(np.int64)
        while len(live):
            hit = self.marked.get(rows)
            out[live[hit]] = self.samples[self.marked.rank(rows[hit])] + steps
            live, rows = live[~hit], rows[~hit]
            symbol, at = np.zeros(len(rows), np.int64), rows
            for bits, zeros in self.levels:
                bit, ones = bits.get(at), bits.rank(at)
                at = np.where(bit, zeros + ones, at - ones)
                symbol = symbol * 2 + bit
            rows = self.first[symbol] + at - self.origin[symbol]
            steps += 1
        return out

    def texts_of(self, positions: np.ndarray) -> np.ndarray:
        """The texts that hold positions of the joined texts."""
        return np.searchsorted(self.text_starts, positions, side="right") - 1


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows of the ranges, and for each the number of its range."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size), which
