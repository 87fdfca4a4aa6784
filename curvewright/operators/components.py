"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import shuffled
from ..functions.kernels import least_roots

MAX_ROUNDS = 60
#: Edges, counted in each round, up to which a round's table of least neighbours is broadcast: it has at most two
#: rows of some 40 bytes for each edge, and the driver holds several such tables at once.
BROADCAST_EDGES = 50_000
#: Edges that a task joins into stars at once.
LOCAL_EDGES = 1_000_000
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _local_stars(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs (keys..., src > dst), dealt by ranges of keys and nodes, as the stars that each task's pairs make.

    A star joins what its pairs join, so components stay what they are. A cloud that is whole in a range is done; one
    that lies in several is left to the rounds, with a row for each of its nodes and ranges.
    """
    columns = [*keys, "src", "dst"]

    def stars(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def joined() -> pd.DataFrame:
            part = pd.concat(held, ignore_index=True)
            cloud = part.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            cloud, node = np.concatenate([cloud, cloud]), np.concatenate([part["src"].to_numpy(), part["dst"].to_numpy()])
            order = np.lexsort((node, cloud))
            new = np.r_[True, (np.diff(cloud[order]) != 0) | (np.diff(node[order]) != 0)]
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.cumsum(new) - 1
            first = order[new]
            root = least_roots(len(first), *number.reshape(2, -1))
            moved = np.flatnonzero(root != np.arange(len(first)))
            out = part[keys].take(first[moved] % len(part)).reset_index(drop=True)
            return out.assign(src=node[first[moved]], dst=node[first[root[moved]]])[columns]

        for part in parts:
            held.append(part)
            n += len(part)
            if n >= LOCAL_EDGES:
                held = [joined()]
                n = len(held[0])
                if 2 * n >= LOCAL_EDGES:
                    yield held.pop()
                    n = 0
        if n:
            yield joined()

    return pairs.repartitionByRange(*keys, "dst").mapInPandas(stars, pairs.schema)


def connected_components(edges: DataFrame, settle: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., node, root) for every node of the edges (keys..., src, dst); root is the least node of its component.

    Each round is two aggregations by node (with map-side combine) and two joins on it. The join's small side, a row
    for each node, is broadcast when the edges were counted to be few; otherwise it is written first, so that both
    sides are plain shuffles and adaptive execution splits a node with very many edges. Rounds grow with the
    logarithm of the longest path. ``settle`` cuts lineage: it must materialise its argument where all executors can
    read it. With text keys and whole numbers for nodes, tasks join what they hold of each cloud beforehand, so that only
    clouds that lie in several tasks need rounds.
    """
    keys = list(keys)
    both = [*keys, "src", "dst"]

    def star(pairs: DataFrame, large: bool, few: bool) -> DataFrame:
        """pairs: src > dst. Connects each node's larger (or smaller) neighbours to the least of its neighbourhood."""
        around = pairs.unionByName(pairs.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else pairs
        least = around.groupBy(*keys, "src").agg(F.min("dst").alias("_low"))
        least = F.broadcast(least) if few else shuffled(settle(least))
        if large:
            least = least.select(*keys, "src", F.least("src", "_low").alias("_low"))
            moved = around.where("dst > src").join(least, [*keys, "src"]).select(*keys, F.col("dst").alias("src"), F.col("_low").alias("dst"))
        else:
            down = pairs.join(least, [*keys, "src"]).select(*keys, F.col("dst").alias("src"), F.col("_low").alias("dst"))
            moved = down.unionByName(least.select(*keys, "src", F.col("_low").alias("dst")))
        return moved.where("src <> dst").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64(*both) % 1_000_003), F.sum(F.xxhash64(*reversed(both)) % 998_244_353)).first())

    def done(pairs: DataFrame) -> bool:
        """Whether every node hangs on one other, which hangs on none."""
        ends = F.explode(F.array(*[F.struct(F.col(c).alias("node"), F.lit(n).alias("out")) for c, n in (("src", 1), ("dst", 0))])).alias("_end")
        met = pairs.select(*keys, ends).groupBy(*keys, "_end.node").agg(F.sum("_end.out").alias("out"), F.min("_end.out").alias("low"))
        return met.where("out > 1 or (out = 1 and low = 0)").isEmpty()

    seen = edges.select(*both).where("src is not null and dst is not null")
    current = seen.where("src <> dst").select(*keys, F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    kinds = dict(current.dtypes)
    local = bool(keys) and all(kinds[k] == "string" for k in keys) and {kinds["src"], kinds["dst"]} <= set(_WHOLE)
    current = settle(_local_stars(current, keys) if local else current.distinct())
    last = mark(current)
    for _ in range(MAX_ROUNDS):
        if not last[0] or (local and done(current)):
            break
        few = last[0] <= BROADCAST_EDGES
        current = settle(star(star(current, True, few), False, few))
        now = mark(current)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    found = current.select(*keys, F.col("src").alias("node"), F.col("dst").alias("root"))
    return found.unionByName(found.select(*keys, F.col("root").alias("node"), "root").distinct())
