"""N-gram Jaccard join: MinHash bands, Bayesian pruning of candidates, exact verification.

Texts with equal shingle sets (told apart by a 128-bit hash of the set) are one representative with a number of
copies. Representatives that share a band of their MinHash signature are candidates; their signatures are compared a
few values at a time, and a pair is dropped once the posterior probability that its similarity reaches the threshold
falls below the tolerance. What is left is verified exactly on the shingle sets. Large buckets and classes are dealt
as pairs of blocks, which return sums and local roots (a row per member), never pairs.

Defined results: null and empty texts and texts without words have the same (empty) shingle set and count as copies
of each other; repeated rows are copies; a text of one to four words is one shingle; an empty table gives no row;
extra columns are ignored. Rows are classed by their texts, not their ids: a repeated doc_id with different texts
stands in the class of each, and a null doc_id is classed like any other; a class whose rows all lack an id has a null
class_id. Different classes have the same class_id only where a doc_id repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import durable, few, in_batches, part_listed, texts_of, worker_task
from .textvec import distinct_shingles

THRESHOLD = 0.8
#: 32 bands of 4 values: a pair at the threshold shares no band with probability 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: A candidate is dropped when it reaches the threshold with less than this posterior probability.
TOLERANCE = 1e-6
STEPS = (16, 32, 64, 128)
#: Members, and shingles of them, that one side of a block pair holds on average (blocks are dealt by hash).
BLOCK, BLOCK_SHINGLES = 512, 1 << 20

_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 62, HASHES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of shingle hashes (all ones for the empty set)."""
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(shingles), 4096):
        part = ((shingles[a : a + 4096, None] * _MUL + _ADD) >> np.uint64(32)).min(0)
        out = np.minimum(out, part.astype(np.uint32))
    return out


def needed_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each step: the least number of equal values at which a pair is kept, under a uniform prior."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in STEPS:
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= threshold].sum() / p.sum() >= tolerance:
                out[n] = m
                break
    return out


def _by_group(frames: Iterator[pd.DataFrame], kernel: Callable[[pd.DataFrame], list[tuple]], columns: list[str], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Call the kernel on each run of equal keys of sorted batches; a run may go over a batch's end."""
    held: list[pd.DataFrame] = []
    last: tuple | None = None
    for frame in frames:
        if not len(frame):
            continue
        values = [frame[k].to_numpy() for k in keys]
        fresh = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
        cuts = [0, *(np.flatnonzero(fresh) + 1), len(frame)]
        rows: list[tuple] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part, key = frame.iloc[a:b], tuple(v[a] for v in values)
            if held and key == last:
                held.append(part)
                continue
            if held:
                rows += kernel(pd.concat(held) if len(held) > 1 else held[0])
            held, last = [part], key
        if rows:
            yield pd.DataFrame(rows, columns=columns)
    if held and (rows := kernel(pd.concat(held) if len(held) > 1 else held[0])):
        yield pd.DataFrame(rows, columns=columns)


def _grouped(kernel: Callable[[pd.DataFrame], list[tuple]], columns: list[str], group: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with worker_task():
            yield from _by_group(frames, kernel, columns, [group, "i", "j"])

    return run


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least member index of each of n members' components."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _pairs(block: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that the block pair (i, j) answers for."""
    if i == j:
        return np.triu_indices(len(block), 1)
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def prune(part: pd.DataFrame, needed: dict[int, int]) -> list[tuple]:
    """(member, least member it is still joined to) of one bucket's block pair."""
    if len(part) < 2:
        return []
    ids = part["rep"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    sig = np.frombuffer(b"".join(part["sig"]), dtype=np.uint32).reshape(len(part), HASHES)[order]
    left, right = _pairs(part["blk"].to_numpy()[order], part["i"].iloc[0], part["j"].iloc[0])
    found_left, found_right = [], []
    for start in range(0, len(left), 1 << 15):
        a, b = left[start : start + (1 << 15)], right[start : start + (1 << 15)]
        same, done = np.zeros(len(a), np.int32), 0
        for n in STEPS:
            same = same + (sig[a, done:n] == sig[b, done:n]).sum(1)
            keep = same >= needed[n]
            a, b, same, done = a[keep], b[keep], same[keep], n
        found_left.append(a)
        found_right.append(b)
    a, b = np.concatenate(found_left or [left]), np.concatenate(found_right or [right])
    root = _roots(len(ids), a, b)
    return [(int(ids[k]), int(ids[r])) for k, r in enumerate(root) if r != k]


def verify(part: pd.DataFrame, threshold: float) -> list[tuple]:
    """(member, links with copies counted, least member it is linked to) of one class's block pair, exactly."""
    ids = part["rep"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, copies, block = ids[order], part["copies"].to_numpy()[order], part["blk"].to_numpy()[order]
    raw = part["shingles"].to_numpy()[order]
    sets = [np.frombuffer(r, dtype=np.uint64) for r in raw]
    sizes = np.array([len(s) for s in sets])
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    width = int(term.max()) + 1 if len(term) else 0
    shared = np.zeros((len(sets), len(sets)))
    by_term = np.argsort(term, kind="stable")
    term, owner = term[by_term], owner[by_term]
    for a in range(0, width, 4096):
        lo, hi = np.searchsorted(term, [a, a + 4096])
        x = np.zeros((len(sets), min(4096, width - a)), dtype=np.float32)
        x[owner[lo:hi], term[lo:hi] - a] = 1
        shared += x @ x.T
    linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-6
    i, j = part["i"].iloc[0], part["j"].iloc[0]
    linked &= (block[:, None] == i) & (block[None, :] == j) | (block[:, None] == j) & (block[None, :] == i)
    np.fill_diagonal(linked, False)
    links = linked @ copies.astype(np.int64)
    left, right = np.nonzero(np.triu(linked, 1))
    root = _roots(len(ids), left, right)
    return [(int(ids[k]), int(links[k]), int(ids[root[k]])) for k in np.flatnonzero(links)]


def in_block_pairs(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Deal each group's members to pairs of hash blocks: adds blk, i and j; (group, i, j) is one block pair."""
    rows = rows.withColumn("_nb", blocks.cast("int"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("_nb")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return rows.withColumn("i", F.least("blk", "_o")).withColumn("j", F.greatest("blk", "_o")).drop("_nb", "_o")


def _dealt(rows: DataFrame, group: str, parts: int) -> DataFrame:
    return rows.repartition(parts, group, "i", "j").sortWithinPartitions(group, "i", "j")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key (a 128-bit hash of the text)."""
    return texts_of(docs).withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))


def _set_keys(texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
    sets = distinct_shingles(texts)
    return sets, [hashlib.md5(s.tobytes()).digest() for s in sets]


def _signatures(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with worker_task():
            for part in in_batches(frames):
                sets, keys = _set_keys(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"], "text_key": part["text_key"], "set_key": keys, "sig": [signature(s).tobytes() for s in sets], "n": [len(s) for s in sets]})

    return docs.mapInPandas(run, f"doc_id {kind}, text_key binary, set_key binary, sig binary, n int")


def _shingle_rows(docs: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with worker_task():
            for part in in_batches(frames):
                sets, keys = _set_keys(part["text"].tolist())
                yield pd.DataFrame({"set_key": keys, "shingles": [s.tobytes() for s in sets]})

    return docs.select("text").mapInPandas(run, "set_key binary, shingles binary")


def _classes(docs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """One row per document row: doc_id, text_key, class (a number), class_id, n_links."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = durable(_signatures(docs))
    sets = found.groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    # Numbers are given when the table is written, so they hold for all that reads it.
    reps = durable(sets.select(F.monotonically_increasing_id().alias("rep"), "set_key", F.col("least.doc_id").alias("doc_id"), F.col("least.text_key").alias("text_key"), "copies", "sig", "n"))

    live = reps.where("n > 0")
    band = F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(substring(sig, b * {4 * ROWS} + 1, {4 * ROWS}), b))"))
    bands = live.select("rep", band.alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    hits = bands.join(shared, "key")
    candidates = in_block_pairs(hits.join(live.select("rep", "sig"), "rep"), "key", F.ceil(F.col("m") / BLOCK))
    needed = needed_matches(threshold, tolerance)
    dealt = _dealt(candidates.select("key", "i", "j", "blk", "rep", "sig"), "key", parts)
    edges = dealt.mapInPandas(_grouped(lambda p: prune(p, needed), ["src", "dst"], "key"), "src bigint, dst bigint")
    groups = connected_components(edges, durable).withColumnRenamed("node", "rep")
    groups = durable(groups.join(reps.select("rep", "set_key", "doc_id", "text_key", "copies", "n"), "rep"))

    sizes = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    # Hashes only keep texts from being worked on in vain: the join on set_key decides.
    hashed = F.xxhash64("doc_id", "text_key")
    texts = docs.join(few(groups.select(hashed.alias("_h"))), hashed == F.col("_h"), "left_semi")
    shingles = _shingle_rows(texts).join(groups.select("rep", "set_key", "root", "copies"), "set_key").drop("set_key").dropDuplicates(["rep"])
    rows = in_block_pairs(shingles.join(sizes, "root"), "root", F.col("blocks")).select("root", "i", "j", "blk", "rep", "copies", "shingles")
    linked = durable(_dealt(rows, "root", parts).mapInPandas(_grouped(lambda p: verify(p, threshold), ["rep", "links", "low"], "root"), "rep bigint, links bigint, low bigint"))

    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(linked.select(F.col("rep").alias("src"), F.col("low").alias("dst")), durable).withColumnRenamed("node", "rep")
    known = reps.select("set_key", "rep", "doc_id", "copies").join(links, "rep", "left").join(roots, "rep", "left").withColumn("class", F.coalesce("root", "rep"))
    least = known.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    known = known.join(least, "class").select("set_key", "class", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return found.select("doc_id", "text_key", "set_key").join(known, "set_key").drop("set_key")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document row: doc_id, class_id (least doc_id of its class) and n_links.

    n_links counts the other rows whose shingle sets reach the threshold, copies included.
    """
    return _classes(_keyed(docs), threshold, tolerance).select("doc_id", "class_id", "n_links")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """All columns of the documents that stay: one row of each class, one with the least id (a null id comes last).

    Rows are removed by id and text, so another text of the same id stays. Of rows that repeat both, one stays.
    """
    order = lambda c: F.struct(F.col(c).isNull(), c, "text_key")
    found = durable(_classes(_keyed(docs), THRESHOLD, TOLERANCE).groupBy("class", "doc_id", "text_key").agg(F.count("*").alias("n")))
    first = found.groupBy("class").agg(F.min(order("doc_id")).alias("least"))
    marked = found.join(first, "class").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), (order("doc_id") == F.col("least")).alias("stays"), "n")
    # Most rows stay, and few repeat: only the others are listed.
    marked = durable(marked.where(~F.col("stays") | (F.col("n") > 1)))
    marked = marked.withColumn("_h", F.xxhash64("_id", "_key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = F.unhex(F.md5(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")))
    some, others = part_listed(rows, F.xxhash64("row.doc_id", key), marked)
    some = some.join(marked, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (key == F.col("_key")), "left").where(F.coalesce("stays", F.lit(True)))
    one = others.select("row.*").unionByName(some.where("stays is null").select("row.*"))
    return one.unionByName(some.where("stays").dropDuplicates(["_id", "_key"]).select("row.*"))
