"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A score-ordered agenda of adjacent symbol pairs: the best pair is merged, its new neighbours join the agenda,
stale entries are skipped. Two adjacent characters that occur inside no piece can never be merged across, so texts
are cut there and each distinct segment is worked out once per worker, in Arrow batches, where the result is checked
against the sentencepiece library.

Defined results: a null text is encoded as the empty one (no ids); repeated rows give repeated rows; an empty table
gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import per_text, texts_of

SPACE = "▁"
#: Words that one of a worker's two caches holds; the older one goes when the younger is full.
CACHE_WORDS = 300_000
#: Segments up to so many characters are merged side by side in arrays, longer ones by a heap.
SHORT = 48
#: Segments whose agendas are held at once.
SIDE_BY_SIDE = 8192
#: Words that the library encodes in one text; it slows down on long ones.
CHECKED_TOGETHER = 128
_NONE = np.int32(1 << 30)


class PieceModel:
    """A merge-type vocabulary: pieces, scores, byte fallback, and the library's processor for checks."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = lib.get_piece_size()
        self.piece = [lib.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        self.id_of = {p: i for i, p in enumerate(self.piece) if i not in special}
        scores = {s: n for n, s in enumerate(sorted({-lib.get_score(i) for i in self.id_of.values()}))}
        self.rank = {p: scores[-lib.get_score(i)] for p, i in self.id_of.items()}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.shown = ["" if i in special else p.replace(SPACE, " ") for i, p in enumerate(self.piece)]
        for i, b in self.byte_of.items():
            self.shown[i] = chr(b) if b < 128 else ""
        self.is_high = np.array([self.byte_of.get(i, 0) >= 128 for i in range(size)])
        self.decimal = [str(i) for i in range(size)]
        if [lib.encode(t, out_type=str) for t in (" a", "ﬁ")] != [[SPACE, SPACE + "a"], [SPACE, *(["ﬁ"] if "ﬁ" in self.rank else [f"<0x{b:02X}>" for b in "ﬁ".encode()])]]:
            raise ValueError("only models that put one space mark in front and change nothing else are handled")
        self.cuts_at_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank)
        self.cuts_at_line = self.cuts_at_space and not any("\n" in p for p in self.rank)
        self._tables()
        self.nothing, self.letter, self.line = (self.merge_words([w])[0] for w in ("", SPACE + "a", "\n"))
        self.forget()

    def _tables(self) -> None:
        """Sorted arrays: characters that are neighbours within a piece, and symbol pairs that make one."""
        joined = {(ord(p[i]) << 21) | ord(p[i + 1]) for p in self.rank for i in range(len(p) - 1)}
        self.joined = np.array(sorted(joined), dtype=np.int64)
        pairs: dict[int, tuple[int, int]] = {}
        for whole, made in self.id_of.items():
            for i in range(1, len(whole)):
                a, b = self._symbol(whole[:i]), self._symbol(whole[i:])
                if a >= 0 and b >= 0:
                    pairs[(a << 32) | b] = (self.rank[whole], made)
        keys = sorted(pairs)
        self.pair_keys = np.array([*keys, 1 << 62], dtype=np.int64)
        self.pair_rank = np.array([*(pairs[k][0] for k in keys), _NONE], dtype=np.int32)
        self.pair_made = np.array([*(pairs[k][1] for k in keys), -1], dtype=np.int64)

    def _symbol(self, text: str) -> int:
        """A piece's id; a character that is no piece gets a number beyond them; -1 for other texts."""
        found = self.id_of.get(text)
        if found is not None:
            return found
        return self.size + ord(text) if len(text) == 1 else -1

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of symbols (-1: none): their place in the agenda's order, and the symbol that they make."""
        key = np.where((left >= 0) & (right >= 0), (left << 32) | right, -1)
        at = np.searchsorted(self.pair_keys, key)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_rank[at], _NONE), self.pair_made[at]

    def _merge_side_by_side(self, symbols: np.ndarray) -> np.ndarray:
        """The agendas of many segments, a row each (-1 after the end): the least entry of every row, leftmost on
        ties, is merged, and its two neighbours' entries are looked up anew, until no row has an entry left."""
        done = np.full_like(symbols, -1)
        rows = np.arange(len(symbols))
        agenda, made = self._ranks(symbols[:, :-1], symbols[:, 1:])
        while True:
            best = agenda.argmin(1) if agenda.shape[1] else np.zeros(len(rows), np.int64)
            here = np.arange(len(rows))
            live = agenda[here, best] < _NONE if agenda.shape[1] else np.zeros(len(rows), bool)
            if not live.all():
                done[rows[~live], : symbols.shape[1]] = symbols[~live]
                symbols, agenda, made, best, rows = symbols[live], agenda[live], made[live], best[live], rows[live]
                here = np.arange(len(rows))
            if not len(rows):
                return done
            symbols[here, best] = made[here, best]
            width = symbols.shape[1]
            # What stands after the merged pair moves one place to the left.
            take = np.arange(width - 1)[None, :]
            symbols = np.take_along_axis(symbols, take + (take > best[:, None]), 1)
            take = np.arange(width - 2)[None, :]
            take = take + (take >= best[:, None])
            agenda, made = np.take_along_axis(agenda, take, 1), np.take_along_axis(made, take, 1)
            for shift in (-1, 0):
                at = best + shift
                ok = np.flatnonzero((at >= 0) & (at < width - 2))
                if len(ok):
                    at = at[ok]
                    agenda[ok, at], made[ok, at] = self._ranks(symbols[ok, at], symbols[ok, at + 1])

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The agenda as a heap over a linked list, for segments where an array would take quadratic time."""
        count = len(symbols)
        left, right = list(range(-1, count - 1)), [*range(1, count), -1]
        ranks, made = self._ranks(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
        agenda = [(int(r), i, i + 1, symbols[i], symbols[i + 1], int(m)) for i, (r, m) in enumerate(zip(ranks, made, strict=True)) if r < _NONE]
        heapq.heapify(agenda)
        keys, rank_of, made_of = self.pair_keys, self.pair_rank, self.pair_made

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                at = int(np.searchsorted(keys, key := (symbols[a] << 32) | symbols[b]))
                if keys[at] == key:
                    heapq.heappush(agenda, (int(rank_of[at]), a, b, symbols[a], symbols[b], int(made_of[at])))

        while agenda:
            _, a, b, x, y, whole = heapq.heappop(agenda)
            if right[a] != b or symbols[a] != x or symbols[b] != y:
                continue
            symbols[a], symbols[b] = whole, -1
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in symbols if s >= 0]

    def merge_words(self, marked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised words by the agenda, one after the other, and the bounds of each word's ids.

        Words are cut between characters that are neighbours in no piece, as nothing can be merged across.
        """
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        if not len(codes):
            return np.empty(0, np.int64), np.zeros(len(marked) + 1, np.int64)
        uniq, inverse = np.unique(codes, return_inverse=True)
        symbols = np.array([self._symbol(chr(c)) for c in uniq], dtype=np.int64)[inverse]
        ends = np.cumsum([len(w) for w in marked])
        pair = (codes[:-1] << 21) | codes[1:]
        at = np.minimum(np.searchsorted(self.joined, pair), max(len(self.joined) - 1, 0))
        cut = self.joined[at] != pair if len(self.joined) else np.ones(len(pair), bool)
        cut[ends[(ends > 0) & (ends < len(codes))] - 1] = True
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        sizes = np.diff(np.concatenate([starts, [len(codes)]]))
        for long in np.flatnonzero(sizes > SHORT):
            a, n = starts[long], sizes[long]
            merged = self._merge_long(symbols[a : a + n].tolist())
            symbols[a : a + n] = merged + [-1] * (n - len(merged))
        short = np.flatnonzero((sizes > 1) & (sizes <= SHORT))
        short = short[np.argsort(sizes[short], kind="stable")]
        for k in range(0, len(short), SIDE_BY_SIDE):
            part = short[k : k + SIDE_BY_SIDE]
            step = np.arange(sizes[part].max())
            inside = step[None, :] < sizes[part][:, None]
            place = np.minimum(starts[part][:, None] + step[None, :], len(codes) - 1)
            symbols[place[inside]] = self._merge_side_by_side(np.where(inside, symbols[place], -1))[inside]
        kept = symbols >= 0
        owner = np.searchsorted(ends, np.flatnonzero(kept), side="right")
        flat = symbols[kept]
        if (flat >= self.size).any():
            flat, owner = self._spell(flat, owner)
        return flat, np.searchsorted(owner, np.arange(len(marked) + 1))

    def _spell(self, flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become their bytes' ids, or the unknown id."""
        foreign = np.flatnonzero(flat >= self.size)
        uniq, inverse = np.unique(flat[foreign], return_inverse=True)
        spelt = [[self.byte[x] for x in chr(c - self.size).encode("utf-8")] if self.byte else [self.library.unk_id()] for c in uniq.tolist()]
        times = np.ones(len(flat), np.int64)
        times[foreign] = np.array([len(s) for s in spelt])[inverse]
        out = np.repeat(flat, times)
        first = np.cumsum(times) - times
        for k, ids in enumerate(spelt):
            at = first[foreign[inverse == k]]
            for n, i in enumerate(ids):
                out[at + n] = i
        return out, np.repeat(owner, times)

    def merge(self, segment: str) -> list[int]:
        """Ids of one normalised segment."""
        return self.merge_words([segment])[0].tolist()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids as they stand within a document (no leading space is taken off).

        Runs of byte pieces are decoded together; a byte below 128 is a character whatever stands beside it.
        """
        high = self.is_high[ids]
        if not high.any():
            return "".join(map(self.shown.__getitem__, ids.tolist()))
        out, edges = [], np.flatnonzero(np.diff(high.astype(np.int8), prepend=0, append=0)).tolist()
        at = 0
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            out += map(self.shown.__getitem__, ids[at:a].tolist())
            out.append(bytes(map(self.byte_of.__getitem__, ids[a:b].tolist())).decode("utf-8", "replace"))
            at = b
        out += map(self.shown.__getitem__, ids[at:].tolist())
        return "".join(out)

    def words(self, text: str) -> list[str]:
        """Cut a text before each space that follows another character, and before each line feed.

        A word stands for a space mark and itself. Runs of spaces, leading ones included, stay in front of the word
        that they precede. A word that a line feed begins stands for itself alone, and has no mark of its own.
        """
        if not self.cuts_at_space:
            return [text]
        if self.cuts_at_line:
            text = text.replace("\n", " \n")
        cuts = text.split(" ")
        if "" not in cuts:
            return cuts
        out, pending = [], ""
        for word in cuts:
            if word:
                out.append(pending + word)
                pending = ""
            else:
                pending += " "
        if pending:
            out.append(pending[1:])
        return out

    def marked(self, word: str) -> str:
        """The normalised text that a word stands for."""
        whole = word if self.cuts_at_line and word.lstrip(" ").startswith("\n") else SPACE + word
        return whole.replace(" ", SPACE)

    def work_out(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and bounds of words by the agenda, checked against the library, ids and decoded text.

        The library sees many words in one text, cut by line feeds, which join no word to the next.
        """
        flat, bounds = self.merge_words([self.marked(w) for w in words])
        # Words of white space alone, and those with spaces in front, are compared one by one.
        alone = [not self.cuts_at_line or not w.strip(" \n") or w.startswith(" ") for w in words]
        for k in np.flatnonzero(alone).tolist():
            self._compare(words[k], flat[bounds[k] : bounds[k + 1]])
        if self.cuts_at_line:
            for a in range(0, len(words), CHECKED_TOGETHER):
                whole, parts = ["a"], [self.letter]
                for k in range(a, min(a + CHECKED_TOGETHER, len(words))):
                    if not alone[k]:
                        starts_line = words[k].startswith("\n")
                        whole.append(words[k] if starts_line else "\n " + words[k])
                        parts += [self.nothing if starts_line else self.line, flat[bounds[k] : bounds[k + 1]]]
                want = np.concatenate(parts)
                right = self.library.encode("".join(whole), num_threads=1)
                if want.tolist() != right or self.decode(want)[1:] != self.library.decode(right, num_threads=1):
                    for k in range(a, min(a + CHECKED_TOGETHER, len(words))):
                        self._compare(words[k], flat[bounds[k] : bounds[k + 1]])
                    raise ValueError("the agenda and the library agree on words but not on their sequence")
        return flat, bounds

    def _compare(self, word: str, ids: np.ndarray) -> None:
        """Raise unless the library gives the same ids and the same decoded text for a word."""
        before = "a" if self.cuts_at_line and word.lstrip(" ").startswith("\n") else ""
        right = self.library.encode(before + word)[1 if before else 0 :]
        if word and right != ids.tolist():
            raise ValueError(f"the agenda and the library disagree on {word!r}: {ids.tolist()} and {right}")
        text = self.library.decode([*self.library.encode(before), *right])
        if word and (mine := self.decode(ids)[0 if before else 1 :]) != text[len(before) :]:
            raise ValueError(f"the decoded ids of {word!r} are {mine!r}, to the library {text!r}")

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; new words of the batch are worked out at once."""
        cuts = [self.words(t.replace(SPACE, " ")) if t else [] for t in texts]  # both stand for a space, to the library too
        if len(self.young.number) > CACHE_WORDS:
            self.old, self.young = self.young, WordIds()
        young, old = self.young, self.old
        missing: set[str] = set()
        for words in cuts:
            missing.update(set(words).difference(young.number))
        again = [w for w in missing if w in old.number]
        young.add(again, *old.ids(again))
        fresh = [w for w in missing if w not in young.number]
        young.add(fresh, *self.work_out(fresh))
        for words in cuts:
            yield young.ids(words)[0]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text])).tolist()

    def forget(self) -> None:
        self.young, self.old = WordIds(), WordIds()


class WordIds:
    """The ids of known words, one after the other in one array."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.empty(1 << 12, np.int32)
        self.starts = np.zeros(1 << 10, np.int64)

    def add(self, words: list[str], flat: np.ndarray, bounds: np.ndarray) -> None:
        n = len(self.number)
        end = self.starts[n]
        while len(self.starts) < n + len(words) + 1:
            self.starts = np.resize(self.starts, 2 * len(self.starts))
        while len(self.flat) < end + len(flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[end : end + len(flat)] = flat
        self.starts[n + 1 : n + 1 + len(words)] = end + bounds[1:]
        self.number.update(zip(words, range(n, n + len(words)), strict=True))

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in turn, and the bounds of each one's."""
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        first = self.starts[at]
        sizes = self.starts[at + 1] - first
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(first - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def forget() -> None:
    model.cache_clear()


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def kernel(texts: list[str]) -> pd.DataFrame:
        pieces, rows = model(model_path), []
        for ids in pieces.encode_batch(texts):
            decimal = ",".join(map(pieces.decimal.__getitem__, ids.tolist()))
            back = pieces.decode(ids)[1:]  # the mark that the encoder puts in front
            rows.append((len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    docs = texts_of(docs)
    return per_text(docs, kernel, "n_tokens long, ids_sha256 string, decoded_sha256 string", docs.schema["doc_id"].dataType.simpleString(), release=forget)
