"""Token counts that follow edits: a segment tree of pre-tokens per document.

A text is cut into pre-tokens. They stand in blocks, the leaves of a tree whose nodes sum pre-tokens, characters and
tokens. An edit finds its place from the top by characters, re-cuts from the pre-token that it can reach, with the one
before it as context, until an old boundary is met again, and re-encodes only those; the sums above the touched blocks
are made anew. The rest of the text is neither read nor copied. Equal to counting the edited text anew.

Defined results: a null or empty text has 0 tokens; edits beyond the text are clamped to it; repeated rows give
repeated rows; an empty table gives no row; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame

from .common import per_text, texts_of

CACHE_WORDS = 600_000


class CountTree:
    """Pre-tokens and their token counts in blocks, with sums of (pre-tokens, characters, tokens) above them."""

    BLOCK = 64

    def __init__(self, words: list[str], counts: list[int]) -> None:
        cuts = range(0, max(len(words), 1), self.BLOCK)
        self.words = [words[i : i + self.BLOCK] for i in cuts]
        self.counts = [counts[i : i + self.BLOCK] for i in cuts]
        self.levels = [[self._sum(k) for k in range(len(self.words))]]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            self.levels.append([self._pair(low, i) for i in range(0, len(low), 2)])
        #: Nodes whose sums were made, over all edits.
        self.touched = 0

    def _sum(self, block: int) -> tuple[int, int, int]:
        words = self.words[block]
        return len(words), sum(map(len, words)), sum(self.counts[block])

    @staticmethod
    def _pair(low: list[tuple[int, int, int]], i: int) -> tuple[int, int, int]:
        return low[i] if i + 1 == len(low) else tuple(map(int.__add__, low[i], low[i + 1]))

    @property
    def total(self) -> tuple[int, int, int]:
        return self.levels[-1][0]

    def locate(self, char: int) -> tuple[int, int, int]:
        """Block, place in it and offset of the pre-token that holds a character; past the last one at the end."""
        node = 0
        for low in reversed(self.levels[:-1]):
            node *= 2
            if node + 1 < len(low) and char >= low[node][1]:
                char -= low[node][1]
                node += 1
        for i, word in enumerate(self.words[node]):
            if char < len(word):
                return node, i, char
            char -= len(word)
        return node, len(self.words[node]), 0

    def before(self, block: int, i: int) -> tuple[int, int] | None:
        """The place of the pre-token before; None at the start."""
        while i == 0:
            if block == 0:
                return None
            block -= 1
            i = len(self.words[block])
        return block, i - 1

    def onward(self, block: int, i: int) -> Iterator[tuple[int, int, str]]:
        """(block, place, pre-token) from a place to the end."""
        for k in range(block, len(self.words)):
            for j in range(i if k == block else 0, len(self.words[k])):
                yield k, j, self.words[k][j]

    def replace(self, first: tuple[int, int], last: tuple[int, int], words: list[str], counts: list[int]) -> None:
        """Put pre-tokens between two places (the second one stays); only the touched blocks' ancestors change."""
        (a, i), (b, j) = first, last
        for rows, new in ((self.words, words), (self.counts, counts)):
            tail = rows[b][j:]
            rows[a] = rows[a][:i] + new + (tail if a == b else [])
            if a != b:
                rows[b] = tail
                for k in range(a + 1, b):
                    rows[k] = []
        if len(self.words[a]) > 8 * self.BLOCK:
            self.__init__([w for block in self.words for w in block], [n for block in self.counts for n in block])
            return
        low, high = a, b
        for k in range(a, b + 1):
            self.levels[0][k] = self._sum(k)
        self.touched += b - a + 1
        for below, level in zip(self.levels, self.levels[1:], strict=False):
            low, high = low // 2, high // 2
            for k in range(low, high + 1):
                level[k] = self._pair(below, 2 * k)
            self.touched += high - low + 1


class CountedText:
    """A text as a tree of counted pre-tokens."""

    def __init__(self, text: str, cut: Callable[[str, int], "object"], count: Callable[[list[str]], list[int]]) -> None:
        self._cut, self._count = cut, count
        words = [m.group() for m in cut(text, 0)]
        self.tree = CountTree(words, count(words))
        #: Pre-tokens that the last edit encoded.
        self.recounted = len(words)

    @property
    def text(self) -> str:
        return "".join("".join(block) for block in self.tree.words)

    @property
    def total(self) -> int:
        return self.tree.total[2]

    @property
    def pre_tokens(self) -> int:
        return self.tree.total[0]

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace code points start to end by ``new``; returns the total afterwards."""
        tree, size = self.tree, self.tree.total[1]
        start, end = min(max(start, 0), size), min(max(end, 0), size)
        end = max(start, end)
        # The pre-token that holds the character before the edit, and one before it: a pattern may look one ahead.
        block, i, offset = tree.locate(max(start - 1, 0))
        back = offset + 1 if start else 0
        if (earlier := tree.before(block, i)) is not None:
            block, i = earlier
            back += len(tree.words[block][i])
        head = ""
        for _, _, word in tree.onward(block, i):
            if len(head) >= back:
                break
            head += word
        to_block, to_i, to_offset = tree.locate(end)
        rest = tree.onward(to_block, to_i)
        buffer, kept = head[:back] + new, len(head[:back]) + len(new)
        # Old boundaries by their place in the buffer, with the pre-token that begins there.
        bounds: dict[int, tuple[int, int]] = {} if to_offset else {kept: (to_block, to_i)}
        words: list[str] = []
        last, at, more = None, 0, True
        while last is None:
            if more:
                fresh = list(islice(rest, CountTree.BLOCK))
                more = len(fresh) == CountTree.BLOCK
                for k, j, word in fresh:
                    buffer += word[to_offset:]
                    to_offset = 0
                    bounds[len(buffer)] = (k, j + 1)
            for m in self._cut(buffer, at):
                if m.end() == len(buffer) and more:
                    break  # it may go on
                words.append(m.group())
                at = m.end()
                if kept <= at < len(buffer) and at in bounds:
                    last = bounds[at]
                    break
            else:
                last = len(tree.words) - 1, len(tree.words[-1])
        tree.replace((block, i), last, words, self._count(words))
        self.recounted = len(words)
        return self.total


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import regex
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), regex.compile(pattern)


_counts: dict[str, dict[str, int]] = {}


def counter(path: str, pattern: str) -> tuple[Callable, Callable[[list[str]], list[int]]]:
    """How to cut a text from a position, and token counts of pre-tokens through a bounded cache."""
    encoding, compiled = _encoding(path, pattern)
    known = _counts.setdefault(path, {})

    def count(words: list[str]) -> list[int]:
        missing = set(words).difference(known)
        if missing:
            if len(known) + len(missing) > CACHE_WORDS:
                known.clear()
                missing = set(words)
            for w in missing:
                known[w] = len(encoding._core_bpe.encode_ordinary(w))
        return list(map(known.__getitem__, words))

    return (lambda text, at: compiled.finditer(text, at)), count


def middle_edit(text: str) -> tuple[int, int, str]:
    """The edit that the query applies: 32 code points in the middle give way to the first 16 of the text."""
    start = len(text) // 2
    return start, start + 32, text[:16]


def count_edited(docs: DataFrame, path: str, pattern: str, edit: Callable[[str], tuple[int, int, str]] = middle_edit) -> DataFrame:
    """doc_id, n_tokens, edited_tokens, pre_tokens and recounted (pre-tokens that the edit made count anew)."""

    def kernel(texts: list[str]) -> pd.DataFrame:
        cut, count = counter(path, pattern)
        rows = []
        for text in texts:
            counted = CountedText(text, cut, count)
            before, words = counted.total, counted.pre_tokens
            rows.append((before, counted.edit(*edit(text)), words, counted.recounted))
        return pd.DataFrame(rows, columns=["n_tokens", "edited_tokens", "pre_tokens", "recounted"])

    docs = texts_of(docs)
    return per_text(docs, kernel, "n_tokens long, edited_tokens long, pre_tokens long, recounted long", docs.schema["doc_id"].dataType.simpleString(), release=_counts.clear)
