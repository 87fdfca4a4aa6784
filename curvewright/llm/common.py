"""Helpers that the corpus operators share: reading, bounded batches of texts, tables that cut lineage."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import settle as durable


#: Bytes of rows that travel to a Python worker at once (one longer row travels alone).
BATCH_BYTES = 4 << 20
_release: Callable[[], None] | None = None


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well: 10,000 whole texts are many times what a kernel takes at once.

    A smaller bound of the session stays. It holds when a plan runs, so it is left set.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([bkmg]?)b?", spark.conf.get(key).strip().lower()).groups()
    if int(number) << {"k": 10, "m": 20, "g": 30}.get(unit, 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return the allocators' free pages to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


@contextmanager
def worker_task(release: Callable[[], None] | None = None) -> Iterator[None]:
    """Around a task's work in a Python worker, which Spark keeps for later tasks of any operator.

    ``release`` empties the caches that the operator keeps between its tasks; it is called when a task of another
    operator begins. At the end the allocators' free pages go back to the system.
    """
    global _release
    if _release is not None and _release is not release:
        _release()
    _release = release
    try:
        yield
    finally:
        give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text``; a null text counts as the empty one. Other columns never travel."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: A list of 64-bit hashes up to this number of rows is broadcast: 8 bytes each, about 20 in a join's table.
BROADCAST_ROWS = 2_000_000


def few(listed: DataFrame) -> DataFrame:
    """The (written) list, broadcast if its rows, counted from file footers, are few; else joins may shuffle it."""
    return F.broadcast(listed) if listed.count() <= BROADCAST_ROWS else listed


def part_listed(rows: DataFrame, hashed: Column, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be listed, rows that are not): ``listed`` has a column ``_h`` of such hashes.

    The first part still needs an exact join; wide rows of the second part never travel. When the list is long, all
    rows are in the first part.
    """
    if listed.count() > BROADCAST_ROWS:
        return rows, rows.limit(0)
    found = F.broadcast(listed.select("_h"))
    return rows.join(found, hashed == F.col("_h"), "left_semi"), rows.join(found, hashed == F.col("_h"), "left_anti")


def in_batches(frames: Iterator[pd.DataFrame], chars: int = 1 << 20, col: str = "text") -> Iterator[pd.DataFrame]:
    """Cut Arrow batches so that one piece holds about ``chars`` code points (a longer text stands alone)."""
    for frame in frames:
        sizes = frame[col].str.len().to_numpy()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > chars:
                yield frame.iloc[start:i]
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield frame.iloc[start:]


def per_text(docs: DataFrame, kernel: Callable[[list[str]], pd.DataFrame], schema: str, id_type: str = "bigint", release: Callable[[], None] | None = None) -> DataFrame:
    """``kernel`` over whole texts in bounded batches: one output row per document, ``doc_id`` first.

    ``release`` empties the kernel's caches when a task of another operator begins in the same worker.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with worker_task(release):
            for part in in_batches(frames):
                made = kernel(part["text"].tolist())
                made.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield made

    return docs.mapInPandas(run, f"doc_id {id_type}, {schema}")


def keep_rows(docs: DataFrame, decide: Callable[[list[str]], np.ndarray], text_col: str = "text") -> DataFrame:
    """Rows of docs, with all columns as they are, for whose (null: empty) texts ``decide`` says True."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker_task():
            for batch in batches:
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                kept, start, total = [], 0, 0
                for i, text in enumerate([*texts, None]):
                    if text is None or (total and total + len(text) > 1 << 20):
                        if i > start:
                            kept.append(np.asarray(decide(texts[start:i]), dtype=bool))
                        start, total = i, 0
                    total += len(text or "")
                if kept:
                    yield batch.filter(pa.array(np.concatenate(kept)))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
