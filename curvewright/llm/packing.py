"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

Only the histogram (at most ``capacity`` rows) reaches the driver. There it is turned into packing patterns with
counts; every piece then finds its sequence from its rank among the pieces of its length.

Defined results: a null or empty text is one piece that holds the closing id alone; repeated texts and repeated
``doc_id`` rows are packed separately (ties are ordered by a hash of the row); an empty table gives no row; extra
input columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import re
import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, in_batches, texts_of, worker_task
from .word_merges import LONGEST, WordMerges, spread

CAPACITY = 2048
#: The last id of each document.
CLOSING_ID = 1
#: What is left of a document after its full sequences is cut at a multiple of this, so that gaps can be filled.
GRAIN = 256
#: Entries that a worker's cache of words with other than letters holds before it starts anew; this bounds memory, not the work.
CACHE_WORDS = 500_000
#: Code points whose different words are looked for together.
BATCH_CHARS = 1 << 21


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(pattern, count) pairs that hold each length as often as the histogram says.

    Lengths are placed longest first, each into the emptiest open pattern; a pattern is split when it occurs more
    often than there are pieces left. The work depends on the number of patterns, not on that of the pieces.
    """
    open_by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    rooms: list[int] = []
    closed: list[tuple[list[int], int]] = []

    def put(count: int, pattern: list[int], room: int) -> None:
        if room == 0:
            closed.append((pattern, count))
            return
        if not open_by_room[room]:
            bisect.insort(rooms, room)
        open_by_room[room].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # Patterns that take this length now must not take it twice before emptier ones are used up.
        while left:
            if not rooms or rooms[-1] < length:
                put(left, [length], capacity - length)
                break
            room = rooms[-1]
            count, pattern = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms.pop()
            used = min(count, left)
            if count > used:
                put(count - used, pattern, room)
            put(used, [*pattern, length], room - length)
            left -= used
    for room in rooms:
        closed.extend((pattern, count) for count, pattern in open_by_room[room])
    return closed


def slot_table(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: the first rank, first sequence and offset of each run of slots, sorted by first rank."""
    taken: dict[int, int] = defaultdict(int)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            runs[length].append((taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The normaliser and pre-tokenizer (fixed values) under which a text's ids are those of its words in turn.
WORD_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLIT = {
    "type": "Split", "behavior": "Removed", "invert": True,
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
}


#: Bytes of the small letters of ASCII, and of those of Latin-1 (a lead byte and one of these).
_SMALL, _LEAD, _AFTER_LEAD = bytes(range(0x61, 0x7B)), 0xC3, bytes(b for b in range(0x9F, 0xC0) if b != 0xB7)
#: A letter ends before any of these; the bar is left out because special tokens hold it.
_ENDS_WORD = re.compile(rb"[!-@\[-`{}~]")
#: Special tokens that hold no such sign after a letter, and no blank.
_SPECIAL = re.compile(r"<\|[A-Za-z]*\|>").fullmatch


def _among(chosen: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chosen)] = True
    return table


_IS_SMALL, _IS_AFTER_LEAD, _IS_END = _among(_SMALL), _among(_AFTER_LEAD), _among(bytes(b for b in range(128) if _ENDS_WORD.match(bytes([b]))))


@lru_cache(maxsize=2)
def _word_merges(path: str) -> WordMerges | None:
    """The file's merges if white space is dropped and crossed by no pre-token, and case does not matter; else None."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    normaliser, cutter, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    steps = cutter.get("pretokenizers") or [{}]
    known = (
        normaliser.get("normalizers") == WORD_NORMALISER
        and steps[0] == WORD_SPLIT
        and [{k: v for k, v in step.items() if k != "trim_offsets"} for step in steps[1:]] == [bytes_only]
        and all(_SPECIAL(t["content"]) and not (t["lstrip"] or t["rstrip"] or t.get("single_word")) for t in spec.get("added_tokens") or [])
        and not (spec.get("truncation") or spec.get("padding"))
        and model.get("type") == "BPE"
        and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    )
    try:
        return WordMerges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "", _SMALL + bytes([_LEAD]) + _AFTER_LEAD) if known else None
    except (KeyError, ValueError):  # a byte without an id, or too many ids
        return None


def _goes_by_words(path: str) -> bool:
    return _word_merges(path) is not None


#: A capital sigma is lowered by its place; a mark may compose with the small letter but not with the capital one.
_CASE_MATTERS = re.compile("[Σİ\u0300-\u036f]|<[|]").search


def _lowered(text: str) -> str:
    """Lowering first only merges words; texts where it could matter (a final sigma, special tokens) stay."""
    try:
        text.isascii() or text.encode("latin-1")
        matters = "<|" in text
    except UnicodeEncodeError:
        matters = _CASE_MATTERS(text)
    return text if matters else text.lower()


def _ends_in_letter(stem: str) -> bool:
    """Whether the normalised stem ends in a letter: some letters are normalised to a letter and a mark."""
    last = stem[-1]
    return last.isalpha() and (last < "\x80" or unicodedata.normalize("NFC", last.lower())[-1].isalpha())


_words: dict[str, dict[str, bytes]] = {}


def _fill(path: str, missing: list[str], cache: dict[str, bytes]) -> None:
    """Encode words that the cache lacks.

    A trailing run of commas and full stops after a letter is a pre-token of its own, so such a word is its stem's
    ids followed by those of the run.
    """
    stems: dict[str, tuple[str, str]] = {}
    need: dict[str, None] = {}
    for word in missing:
        stem = word.rstrip(",.")
        if stem and len(stem) < len(word) and _ends_in_letter(stem):
            stems[word] = stem, word[len(stem) :]
            need.update((part, None) for part in stems[word] if part not in cache)
        else:
            need[word] = None
    todo = list(need)
    for word, found in zip(todo, _tokenizer(path).encode_batch_fast(todo, add_special_tokens=False), strict=True):
        cache[word] = struct.pack(f"<{len(ids := found.ids)}I", *ids)
    for word, (stem, tail) in stems.items():
        cache[word] = cache[stem] + cache[tail]


def _letter_ends(data: np.ndarray) -> np.ndarray:
    """Whether a byte is the last one of a small letter of ASCII or Latin-1."""
    found = _IS_SMALL[data]
    found[1:] |= _IS_AFTER_LEAD[data[1:]] & (data[:-1] == _LEAD)
    return found


def _different(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first bytes of pieces, which different piece each one is, and the different ones: bytes, bounds, sizes).

    A piece begins at a blank, or where a sign or digit follows a small letter: no pre-token crosses these. The blank
    is no part of the different pieces' bounds.
    """
    data = np.frombuffer(joined, dtype=np.uint8)
    begins = data == 0x20
    begins[1:] |= _IS_END[data[1:]] & _letter_ends(data)[:-1]
    firsts = np.flatnonzero(begins)
    bounds = pa.py_buffer(np.append(firsts, len(data)).astype(np.int64))
    coded = pa.Array.from_buffers(pa.large_binary(), len(firsts), [None, bounds, pa.py_buffer(joined)]).dictionary_encode()
    _, bounds, kept = coded.dictionary.buffers()
    bounds = np.frombuffer(bounds, dtype=np.int64)[: len(coded.dictionary) + 1]
    kept = np.frombuffer(kept, dtype=np.uint8)[: bounds[-1]]
    starts = bounds[:-1] + (kept[bounds[:-1]] == 0x20)
    return firsts, coded.indices.to_numpy(), kept, starts, bounds[1:] - starts


def _encode_words(texts: list[str], path: str) -> list[np.ndarray]:
    """Each text's ids. The different pieces of all texts are encoded once: words of letters in arrays, others by the library."""
    coded = [b" " + _lowered(text).replace("\n", " ").encode() for text in texts]
    firsts, which, data, starts, sizes = _different(b"".join(coded))
    not_letters = np.append(0, np.cumsum(~(_letter_ends(data) | (data == _LEAD))))
    in_arrays = (not_letters[starts + sizes] == not_letters[starts]) & (sizes > 0) & (sizes <= LONGEST)
    merged, counts = _word_merges(path).merge(data, starts[in_arrays], sizes[in_arrays])

    cache = _words.setdefault(path, {})
    rest = np.flatnonzero(~in_arrays & (sizes > 0))
    plain = data.tobytes()
    words = [plain[a:b].decode() for a, b in zip(starts[rest].tolist(), (starts + sizes)[rest].tolist(), strict=True)]
    missing = [word for word in words if word not in cache]
    if missing:
        if len(cache) + len(missing) > CACHE_WORDS:
            cache.clear()
            missing = words
        _fill(path, missing, cache)
    found = [cache[word] for word in words]

    pool = np.concatenate([merged.astype("<u4"), np.frombuffer(b"".join(found), dtype="<u4")])
    length = np.zeros(len(sizes), dtype=np.int64)
    length[in_arrays], length[rest] = counts, np.array([len(x) // 4 for x in found], dtype=np.int64)
    base = np.zeros(len(sizes), dtype=np.int64)
    base[in_arrays] = np.cumsum(counts) - counts
    base[rest] = len(merged) + np.cumsum(length[rest]) - length[rest]
    each = length[which]
    ids = pool[spread(base[which], each)]
    ends = np.append(0, np.cumsum(each))
    at = np.searchsorted(firsts, np.cumsum([0, *map(len, coded)]))
    return [ids[a:b] for a, b in itertools.pairwise(ends[at].tolist())]


def encode_texts(texts: list[str], path: str, closing: int | None = CLOSING_ID) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers, as the tokenizers library encodes it whole.

    The tokenizer drops white space and no pre-token crosses it, so a text's ids are those of its words in turn.
    Tokenizers of other kinds encode each text whole.
    """
    end = b"" if closing is None else np.array([closing], dtype="<u4").tobytes()
    if not texts:
        return []
    if not _goes_by_words(path):
        found = _tokenizer(path).encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() + end for e in found]
    return [ids.tobytes() + end for ids in _encode_words(texts, path)]


def _forget() -> None:
    _words.clear()
    _tokenizer.cache_clear()
    _word_merges.cache_clear()


def cut(total: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """Lengths of the pieces of a document of ``total`` ids, in order: full sequences, whole grains, the rest."""
    full, rest = divmod(total, capacity)
    whole = rest - rest % grain
    return [capacity] * full + [x for x in (whole, rest - whole) if x]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens. One pass, no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with worker_task(_forget):
            for part in in_batches(frames, BATCH_CHARS):
                rows = []
                for doc_id, ids in zip(part["doc_id"], encode_texts(part["text"].tolist(), tokenizer_path), strict=True):
                    start, total = 0, len(ids) // 4
                    view = memoryview(ids)
                    for length in cut(total, capacity, grain):
                        rows.append((doc_id, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), total))
                        start += length
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def assign(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to materialised pieces.

    Ranks within a length come from small windows over (length, bucket) plus the running counts of the buckets, so
    that a length which a third of all pieces share is dealt over many tasks.
    """
    spread = max(1, found.rdd.getNumPartitions()) * 16
    keyed = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(spread)).cast("int"))
    counts = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select(
        "length", "_bucket",
        (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
    )
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slot_table(shortest_pack_first(histogram, capacity))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "start")) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_bucket", "_before")
    shared = found.sparkSession.sparkContext.broadcast(slots)
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            rank = frame["_rank"].to_numpy()
            for length, rows in frame.groupby("length", sort=False).indices.items():
                first, base, where = shared.value[int(length)]
                at = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = base[at] + rank[rows] - first[at], where[at]
            yield frame[order].assign(sequence_id=sequence, offset=offset)

    kind = found.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` ids; one row per piece."""
    return assign(durable(pieces(texts_of(docs), tokenizer_path, capacity, grain)), capacity)
