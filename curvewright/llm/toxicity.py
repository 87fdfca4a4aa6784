"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A text is the bag of its character 3- to 6-grams (word ends included), hashed to buckets; their embeddings are
averaged and a softmax over two classes follows. Unseen misspellings share most n-grams with seen words. As the
model is linear in the bag, scoring needs one scalar per bucket: a table of fixed size is broadcast.

Defined results: null and empty texts score as the bias alone; without labels of both classes the score is the
smoothed class share; repeated rows score alike; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, in_batches, keep_rows, per_text, texts_of
from .labelled import held_out, training_rows

BITS = 18
SIZES = (3, 4, 5, 6)
#: The bound of the training sample: so many labelled rows of each class.
PER_CLASS = 2000
DIM, EPOCHS, BATCH, RATE = 4, 9, 64, 0.15
#: Characters that end a word, besides white space and control characters.
BREAKS = ',.;:?"()[]{}|<>/\\'


def _solid(codes: np.ndarray) -> np.ndarray:
    low = np.ones(128, dtype=bool)
    low[:33] = False
    low[[ord(c) for c in BREAKS]] = False
    return np.where(codes < 128, low[np.minimum(codes, 127)], codes != 0xA0)


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: (bucket, text number) of all n-grams of all texts."""
    joined = " " + " ".join(texts) + " "
    codes = np.frombuffer(joined.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    if len(codes) != len(joined):  # lowering changed a length
        texts = [t.lower() for t in texts]
        codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    solid = _solid(codes)
    gaps = np.concatenate([[0], np.cumsum(~solid)]).astype(np.int32)
    value = np.where(solid, codes, 1).astype(np.uint64)
    for n in SIZES:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        at = np.flatnonzero(gaps[n - 1 : n - 1 + count] == gaps[1 : count + 1])
        h = value[at]
        for k in range(1, n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + value[at + k]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield (h >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(ends, at, side="right")


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets, ascending, and how often each occurs in each text."""
    parts = list(subwords(texts))
    bucket, owner = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in (0, 1))
    keys, counts = np.unique((owner << BITS) | bucket, return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1) << BITS)
    return [((keys[a:b] & ((1 << BITS) - 1)).astype(np.int32), counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def packed(bag: tuple[np.ndarray, np.ndarray]) -> bytes:
    """A bag without loss in about a third of its bytes: steps between buckets, then counts."""
    ids, n = bag
    return zlib.compress(np.concatenate([np.diff(ids, prepend=0), n]).astype(np.uint32).tobytes(), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(raw), dtype=np.uint32)
    half = len(both) // 2
    return np.cumsum(both[:half], dtype=np.int32), both[half:]


def train(rows: list[bytes], y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Fit embeddings and softmax jointly; returns a scalar per bucket and the bias of the toxic class's log odds.

    ``rows`` are packed bags; the driver unpacks one at a time and keeps buckets and counts in narrow integers.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return np.zeros(1 << BITS, np.float32), prior
    rng = np.random.default_rng(seed)
    seen, kept = np.zeros(1 << BITS, np.int32), []
    for i, row in enumerate(rows):
        ids, _ = unpacked(row)
        if len(ids):
            seen[ids] += 1  # the buckets of a bag are distinct
            kept.append(i)
    live = np.flatnonzero(seen > 1)  # a bucket of one text only says which text it is
    if not len(live):
        return np.zeros(1 << BITS, np.float32), prior
    number = np.full(1 << BITS, -1, np.int32)
    number[live] = np.arange(len(live))
    data = []
    for i in kept:
        ids, n = unpacked(rows[i])
        ids, total = number[ids], n.astype(np.float32).sum()
        n = n[ids >= 0]
        data.append((ids[ids >= 0], n.astype(np.min_scalar_type(n.max(initial=0))), total))
    emb = rng.normal(0, 0.05, (len(live), DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.array([0.0, prior], np.float32)
    g_emb, g_soft, g_bias = np.full((len(live), DIM), 1e-6, np.float32), np.full_like(soft, 1e-6), np.full_like(bias, 1e-6)
    label = y[kept].astype(np.int64)
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(len(kept)), RATE * (1 - epoch / EPOCHS)
        for start in range(0, len(order), BATCH):
            pick = order[start : start + BATCH]
            sizes = np.array([len(data[i][0]) for i in pick])
            ids = np.concatenate([data[i][0] for i in pick])
            w = np.concatenate([data[i][1].astype(np.float32) / data[i][2] * 50 for i in pick])
            owner = np.repeat(np.arange(len(pick)), sizes)
            own = emb[ids] * w[:, None]
            mean = np.stack([np.bincount(owner, own[:, d], len(pick)) for d in range(DIM)], 1).astype(np.float32)
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), label[pick]] -= 1
            p /= len(pick)
            back = p @ soft.T
            d_soft, d_bias = mean.T @ p, p.sum(0)
            uniq, inverse = np.unique(ids, return_inverse=True)
            d_emb = np.stack([np.bincount(inverse, back[owner, d] * w, len(uniq)) for d in range(DIM)], 1).astype(np.float32)
            g_emb[uniq] += d_emb**2
            emb[uniq] -= rate * d_emb / np.sqrt(g_emb[uniq])
            g_soft += d_soft**2
            soft -= rate * d_soft / np.sqrt(g_soft)
            g_bias += d_bias**2
            bias -= rate * d_bias / np.sqrt(g_bias)
    scalar = np.zeros(1 << BITS, np.float32)
    scalar[live] = 50 * emb @ (soft[:, 1] - soft[:, 0])
    return scalar, float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Learn from a bounded sample; bags are made on the executors, where the texts are."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_batches(frames, 1 << 18):
            yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"], "bag": [packed(b) for b in bags(part["text"].tolist())]})

    rows = training_rows(docs, labels, label, per_class)
    kind = rows.schema["doc_id"].dataType.simpleString()
    got = sorted(rows.mapInPandas(pack, f"doc_id {kind}, y int, bag binary").collect(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in got], dtype=np.int64)
    bags_of = [r["bag"] for r in got]
    del got
    scalar, bias = train(bags_of, y)
    del bags_of
    give_back()
    # The sample is near balanced; move the bias back to the shares among all learnable labels.
    whole = {r["y"]: r["n"] for r in labels.where(~held_out()).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if 0 < y.sum() < len(y):
        bias += float(np.log((whole[1] / whole[0]) / (y.sum() / (len(y) - y.sum()))))
    return scalar, bias


def logits(texts: list[str], scalar: np.ndarray, bias: float) -> np.ndarray:
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for bucket, owner in subwords(texts):
        total += np.bincount(owner, scalar[bucket], len(texts))
        count += np.bincount(owner, minlength=len(texts))
    return bias + total / np.maximum(count, 1)


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    docs = texts_of(docs)
    scalar, bias = fit(docs, labels, per_class=per_class)
    shared = docs.sparkSession.sparkContext.broadcast(scalar)

    def kernel(texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(logits(texts, shared.value, bias), -30, 30)))})

    made = per_text(docs, kernel, "score double", docs.schema["doc_id"].dataType.simpleString())
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """All columns of the rows that score below the threshold, in one pass without a shuffle."""
    scalar, bias = fit(texts_of(docs), labels, per_class=per_class)
    shared = docs.sparkSession.sparkContext.broadcast(scalar)
    limit = float(np.log(threshold / (1 - threshold)))
    return keep_rows(docs, lambda texts: logits(texts, shared.value, bias) < limit)
