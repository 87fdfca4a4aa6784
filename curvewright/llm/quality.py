"""Quality: nearest-neighbour voting over latent-semantic vectors.

Terms are hashed words, trigrams of character classes (how a text is written) and word-repeat events. Their tf-idf
vectors are projected by a truncated SVD fitted on a bounded labelled sample. The sample's vectors are broadcast
(rows and width are parameters, so their size is fixed), and each document takes exact cosine products with all of
them in blocks; its nearest neighbours vote with their similarity as weight. The sample is balanced, so a neighbour's
vote counts as many times as its class is larger among all learnable labels than in the sample.

Defined results: texts without words, and all texts when there is no labelled row, get the share of good ones among
the learnable labels (0.5 when there is none); repeated rows score alike; a null doc_id is scored and its held_out is
null; an empty table gives no row; extra columns are ignored.
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
from .textvec import word_hashes

#: Columns of character classes, of hashed words, and of word events: equal to the word 1, 2, 3 before; words; words
#: seen before in the text.
CLASSES, WORDS, EVENTS = 1019, 1024, 5
WIDTH = CLASSES + WORDS + EVENTS
RANK = 64
NEIGHBOURS = 15
#: Texts whose vectors are held at once, however short they are.
BLOCK = 256
#: The bound of the labelled sample: so many rows of each class.
PER_CLASS = 2000

_CLASS = np.full(256, 20, dtype=np.int64)
for _n, _set in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r", ".", ",", "!", "?", "|", "'\"", "()[]{}", "#", "$", "%", "&", "*", "-_", ":;"]):
    _CLASS[[ord(c) for c in _set]] = _n
_SPREAD = ((np.arange(21**3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % CLASSES


def counts(texts: list[str]) -> np.ndarray:
    """Term counts, one row per text. All characters outside ASCII are in one class."""
    out = np.zeros((len(texts), WIDTH))
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw])
    kinds = _CLASS[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    if len(kinds) > 2:
        owner = np.repeat(np.arange(len(texts)), sizes)
        code = kinds[:-2] * 441 + kinds[1:-1] * 21 + kinds[2:]
        whole = owner[:-2] == owner[2:]
        cells = owner[:-2][whole] * WIDTH + _SPREAD[code[whole]]
        out += np.bincount(cells, minlength=out.size).reshape(out.shape)
    words, owner = word_hashes(texts)
    for k in (1, 2, 3):
        if len(words) > k:
            same = (words[k:] == words[:-k]) & (owner[k:] == owner[:-k])
            out[:, WIDTH - EVENTS + k - 1] = np.bincount(owner[k:][same], minlength=len(texts))
    if len(words):
        column = CLASSES + (words >> np.uint64(64 - 10)).astype(np.int64) * WORDS // 1024
        out += np.bincount(owner * WIDTH + column, minlength=out.size).reshape(out.shape)
        out[:, WIDTH - 2] = np.bincount(owner, minlength=len(texts))
        order = np.lexsort((words, owner))
        again = (words[order][1:] == words[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        out[:, WIDTH - 1] = np.bincount(owner[order][1:][again], minlength=len(texts))
    return out


def shares(found: np.ndarray) -> np.ndarray:
    """Square roots of each term's share among the terms of its sort, so that long and short texts compare.

    The counts are overwritten by the result.
    """
    sizes = found[:, CLASSES + WORDS + 3].copy()
    for a, b in ((0, CLASSES), (CLASSES, CLASSES + WORDS), (CLASSES + WORDS, WIDTH)):
        total = sizes if b == WIDTH else found[:, a:b].sum(1)
        found[:, a:b] /= np.maximum(total, 1)[:, None]
    return np.sqrt(found, out=found)


def truncated_svd(x: np.ndarray, rank: int, rounds: int = 8, spare: int = 16) -> np.ndarray:
    """The leading right singular vectors of x by subspace iteration from a fixed start."""
    basis = np.random.default_rng(9).normal(size=(x.shape[1], min(rank + spare, x.shape[1]))).astype(x.dtype)
    for _ in range(rounds):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, turn = np.linalg.svd(np.linalg.qr(x @ basis, mode="r"))
    return basis @ turn.T[:, :rank]


class Neighbours:
    """Labelled latent vectors and the projection that makes them."""

    def __init__(self, found: np.ndarray, y: np.ndarray, whole: tuple[int, int] | None = None) -> None:
        """``found`` is overwritten; ``whole``: how many learnable labels are 0 and 1, in and out of the sample."""
        bad, good = whole or (int((y == 0).sum()), int((y == 1).sum()))
        self.prior = good / (bad + good) if bad + good else 0.5
        self.y = y.astype(np.float64)
        self.times = np.where(y == 1, good / max((y == 1).sum(), 1), bad / max((y == 0).sum(), 1))
        self.idf = (np.log((1 + len(found)) / (1 + np.count_nonzero(found, axis=0))) + 0.3).astype(np.float32)
        x = shares(found)
        x *= self.idf
        self.basis = truncated_svd(x, RANK).astype(np.float32)
        self.vectors = self._unit(x)

    def _unit(self, x: np.ndarray) -> np.ndarray:
        v = x.astype(np.float32) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def vote(self, texts: list[str]) -> np.ndarray:
        """Exact cosine products with every labelled vector, block by block; nearest ones vote."""
        out = np.full(len(texts), self.prior)
        k = min(NEIGHBOURS, len(self.y))
        for a in range(0, len(texts) if k else 0, BLOCK):
            found = counts(texts[a : a + BLOCK])
            wordless = found[:, WIDTH - 2] == 0
            sims = self._unit(shares(found) * self.idf) @ self.vectors.T
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(np.float64) ** 4 * self.times[near]
            total = w.sum(1)
            voted = np.where(total > 0, (w * self.y[near]).sum(1) / np.maximum(total, 1e-12), self.prior)
            out[a : a + BLOCK] = np.where(wordless, self.prior, voted)
        return np.round(np.clip(out, 0, 1), 6)  # products of single precision differ a little from block to block


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Neighbours:
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_batches(frames):
            yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"], "x": [zlib.compress(r.astype(np.float32).tobytes(), 1) for r in counts(part["text"].tolist())]})

    rows = training_rows(docs, labels, label, per_class)
    kind = rows.schema["doc_id"].dataType.simpleString()
    got = sorted(rows.mapInPandas(pack, f"doc_id {kind}, y int, x binary").collect(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in got], dtype=np.int64)
    x = np.empty((len(got), WIDTH), np.float32)  # the one large array of the driver; it is worked on in place
    for k, r in enumerate(got):
        x[k] = np.frombuffer(zlib.decompress(r["x"]), np.float32)
    del got
    counted = labels.where(~held_out()).groupBy(F.col(label).cast("int").alias("y")).agg(F.countDistinct("doc_id").alias("n"))
    whole = {r["y"]: r["n"] for r in counted.collect()}
    fitted = Neighbours(x, y, (whole.get(0, 0), whole.get(1, 0)))
    del x
    give_back()
    return fitted


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    docs = texts_of(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class=per_class))
    made = per_text(docs, lambda texts: pd.DataFrame({"score": shared.value.vote(texts)}), "score double", docs.schema["doc_id"].dataType.simpleString())
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.3) -> DataFrame:
    """All columns of the rows that reach the threshold, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts_of(docs), labels, per_class=per_class))
    return keep_rows(docs, lambda texts: shared.value.vote(texts) >= threshold)
