"""Byte-pair merges of many words at once, in arrays."""

from __future__ import annotations

import numpy as np

#: Bytes of the longest word that is merged in arrays; rows of a group of words, its two margins among them, fit SPAN.
LONGEST = 32
SPAN = 64
NEVER = np.int32(2**31 - 1)
#: Words are merged in groups of about one length, so that rounds and rows are not wasted on short ones.
WIDTHS = (6, 10, 16, LONGEST)
#: Words of a group that are merged at once: this bounds memory (some hundred bytes a word), not the work.
AT_ONCE = 1 << 15


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary of a byte-level tokenizer."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordMerges:
    """The merges of a byte-level vocabulary; ``symbols`` are the bytes that words may hold."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str, symbols: bytes) -> None:
        alphabet = byte_alphabet()
        self.none = max(vocab.values()) + 1  # beyond a word's ends; joins nothing
        if (self.none + 1) ** 2 > 2**32 or len(merges) * SPAN >= NEVER:
            raise ValueError("vocabulary too large")
        # By byte; 256 further on for the last byte of a word; 512 for none.
        self.first_ids = np.full(513, self.none, dtype=np.int32)
        for b in symbols:
            self.first_ids[b], self.first_ids[256 + b] = vocab[alphabet[b]], vocab[alphabet[b] + suffix]
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pairs[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.made = np.zeros(len(merges), dtype=np.int32)
        for rank, made in pairs.values():
            self.made[rank] = made
        keys = np.array([a * (self.none + 1) + b for a, b in pairs], dtype=np.uint32)
        self._build(keys, np.array([rank for rank, _ in pairs.values()], dtype=np.int32))

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open table of a power of two slots, at most a quarter full; a key stands at its slot or soon after."""
        bits = max(8, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.zeros(1 << bits, dtype=np.uint32), np.full(1 << bits, -1, dtype=np.int32)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.ranks[at] < 0)
            here = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[here]], self.ranks[at[here]] = keys[here], ranks[here]
            left = np.ones(len(keys), dtype=bool)
            left[here] = False
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def order(self, left: np.ndarray, right: np.ndarray, row: np.ndarray) -> np.ndarray:
        """By pair: its rank, and the row of its left part among equal ranks; NEVER if it does not merge."""
        keys = left.astype(np.uint32) * np.uint32(self.none + 1) + right.astype(np.uint32)
        at = self._slot(keys)
        ranks = self.ranks[at]
        other = np.flatnonzero((self.keys[at] != keys) & (ranks >= 0))
        while len(other):
            at[other] = (at[other] + 1) & self.mask
            ranks[other] = self.ranks[at[other]]
            other = other[(self.keys[at[other]] != keys[other]) & (ranks[other] >= 0)]
        return np.where(ranks >= 0, ranks * SPAN + row.astype(np.int32), NEVER)

    def merge(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, number of ids of each); a word has 1 to LONGEST bytes of ``data``."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lower = 0
        for width in WIDTHS:
            which = np.flatnonzero((sizes > lower) & (sizes <= width))
            for i in range(0, len(which), AT_ONCE):
                part = which[i : i + AT_ONCE]
                self._group(data, part, starts[part], sizes[part], width, found)
            lower = width
        counts = np.zeros(len(sizes), dtype=np.int64)
        for which, _, many in found:
            counts[which] = many
        base, ids = np.cumsum(counts) - counts, np.empty(int(counts.sum()), dtype=np.int32)
        for which, flat, many in found:
            ids[spread(base[which], many)] = flat
        return ids, counts

    def _group(self, data, which, starts, sizes, width, found) -> None:
        """In each round, every word's pair of the least rank (the leftmost of equal ones) becomes one id."""
        n = len(which)
        rows = np.arange(width, dtype=np.int32)[:, None]
        inside = rows < sizes
        codes = data[np.where(inside, starts + rows, 0)].astype(np.int16)
        codes[rows == sizes - 1] += 256
        codes[~inside] = 512
        ids = np.full((width + 2, n), self.none, dtype=np.int32)
        ids[1:-1] = self.first_ids[codes]
        all_rows = np.arange(width + 2, dtype=np.int32)[:, None]
        after, before = np.repeat(all_rows + 1, n, axis=1), np.repeat(all_rows - 1, n, axis=1)
        value = np.full((width + 2, n), NEVER, dtype=np.int32)
        value[1:-2] = self.order(ids[1:-2].ravel(), ids[2:-1].ravel(), np.repeat(all_rows[1:-2], n, axis=1).ravel()).reshape(width - 1, n)
        while True:
            low = value.min(axis=0)
            on = np.flatnonzero(low != NEVER)
            if 2 * len(on) <= n:  # words that are done leave
                off = np.flatnonzero(low == NEVER)
                done = ids[:, off].T
                stays = (done >= 0) & (done != self.none)
                found.append((which[off], done[stays], stays.sum(axis=1)))
                if not len(on):
                    return
                ids, after, before, value = (x.take(on, axis=1) for x in (ids, after, before, value))  # in rows, as views below need
                which, low, n, on = which[on], low[on], len(on), np.arange(len(on))
            else:
                low = low[on]
            flat_ids, flat_after, flat_before, flat_value = ids.reshape(-1), after.reshape(-1), before.reshape(-1), value.reshape(-1)
            row = low & (SPAN - 1)
            here = row * np.int64(n) + on
            gone = flat_after[here] * np.int64(n) + on
            next_row, last_row = flat_after[gone], flat_before[here]
            nxt, last = next_row * np.int64(n) + on, last_row * np.int64(n) + on
            made = self.made[low // SPAN]
            flat_ids[here], flat_ids[gone] = made, -1
            flat_after[here], flat_before[nxt] = next_row, row
            flat_value[gone] = NEVER
            flat_value[here] = self.order(made, flat_ids[nxt], row)
            flat_value[last] = self.order(flat_ids[last], made, last_row)


def spread(base: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """base[0], base[0] + 1, ... (counts[0] of them), then those of base[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(base - (ends - counts), counts)
