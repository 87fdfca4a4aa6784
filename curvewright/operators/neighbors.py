"""Distance joins and adjacency graphs: pitch, radius, k nearest, spanning forest, shortcut pruning.

Points are (cloud, id, x, y, z); edges are (cloud, src, dst, w) with src < dst. Every operator works on many clouds.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import NeighborConfig
from ..functions.geometry import AXES, distance
from ..functions.joins import shuffled, with_cloud
from ..functions.lineage import settle
from .components import connected_components
from .order import exact_median

EPS = 1e-9


def _cells(points: DataFrame, radius: Column, sent: str = "") -> DataFrame:
    """points with the cubic cell cx, cy, cz that each is in, as wide as the radius; ``sent`` to the cells around it.

    Sent to "all", a point stands in its own cell and the 26 around it; to "half", in its own (where ``own`` is true)
    and the 13 that follow it. A cell is a hair wider than the radius, so that pairs exactly at it never stand two
    cells apart; a radius of zero needs any width.
    """
    width = F.when(radius > 0, radius * (1 + 1e-9)).otherwise(1.0)
    found = points.select("*", *[F.floor(F.col(c) / width).alias(f"c{c}") for c in AXES])
    if not sent:
        return found
    steps = [s for s in product((-1, 0, 1), repeat=len(AXES)) if sent == "all" or s >= (0, 0, 0)]
    step = F.explode(F.array(*[F.struct(*[F.lit(i).alias(c) for c, i in zip(AXES, s, strict=True)]) for s in steps]))
    own = F.lit(True)
    for c in AXES:
        own &= F.col(f"_step.{c}") == 0
    moved = {f"c{c}": F.col(f"c{c}") + F.col(f"_step.{c}") for c in AXES}
    return found.withColumn("_step", step).withColumns({**moved, "own": own}).drop("_step")


def _meet(asking: DataFrame, everyone: DataFrame, more: tuple[Column, ...] = (), half: bool = False) -> DataFrame:
    """(cloud, src, dst, w, more...) of an asking point a and another b at most a's ``r`` apart, from rows with cells.

    One side is sent to neighbouring cells, so the join is an equi-join on the cell and a pair meets once each way;
    sent to half of them, once in all, and src is the one that was sent.
    """
    a, b = asking.alias("a"), shuffled(everyone).alias("b")
    same = F.col("a.cloud") == F.col("b.cloud")
    for c in AXES:
        same &= F.col(f"a.c{c}") == F.col(f"b.c{c}")
    apart = F.col("a.id") != F.col("b.id")
    if half:
        apart &= ~F.col("a.own") | (F.col("a.id") < F.col("b.id"))
    w = distance("a", "b")
    joined = a.join(b, same & apart & (w <= F.col("a.r")))
    return joined.select(F.col("a.cloud").alias("cloud"), F.col("a.id").alias("src"), F.col("b.id").alias("dst"), w.alias("w"), *more)


def _pairs(points: DataFrame, radius: Column, more: tuple[Column, ...] = ()) -> DataFrame:
    """Every pair of points at most ``radius`` apart once, in either order."""
    wide = points.select("cloud", "id", *AXES, radius.alias("r"))
    return _meet(_cells(wide, F.col("r"), "half"), _cells(wide, F.col("r")), more, True)


def pairs_within(points: DataFrame, radius: Column | float) -> DataFrame:
    """(cloud, src, dst, w) of all pairs, src < dst, at most ``radius`` apart (a number or a cloud's), inclusive."""
    pairs = _pairs(points, radius if isinstance(radius, Column) else F.lit(float(radius)))
    return pairs.select("cloud", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")


def offsets_within(points: DataFrame, radius: Column) -> DataFrame:
    """(cloud, id, ox, oy, oz) for each other point at most ``radius`` from each point."""
    return turned_offsets(_pairs(points, radius, tuple((F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"o{c}") for c in AXES)))


def turned_offsets(pairs: DataFrame, keys: Sequence[str] = ("cloud",)) -> DataFrame:
    """(keys..., id, ox, oy, oz) for both ends of pairs (keys..., src, dst, ox, oy, oz), whose offsets lead from src to dst."""
    ways = [F.struct(F.col(end).alias("id"), *[(F.col(f"o{c}") * sign).alias(f"o{c}") for c in AXES]) for end, sign in (("src", 1.0), ("dst", -1.0))]
    return pairs.select(*keys, F.explode(F.array(*ways)).alias("_way")).select(*keys, "_way.*")


def _start_radius(points: DataFrame) -> DataFrame:
    """(cloud, n, r): the width at which a cloud's occupied cells hold two points on average, from one aggregate."""
    ends = [f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    span = F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in AXES])
    counts = points.groupBy("cloud").agg(F.count("*").alias("n"), *ends).select("cloud", "n", span.alias("span"))
    levels = range(1, 21)
    cell = lambda j: F.struct(*[F.floor(F.col(c) * 2.0**j / F.greatest("span", F.lit(1e-300))) for c in AXES])
    occupied = with_cloud(points, settle(counts)).groupBy("cloud", "n", "span").agg(*[F.approx_count_distinct(cell(j)).alias(f"o{j}") for j in levels])
    fine = F.greatest(*[F.when(F.col("n") / F.col(f"o{j}") >= 2.0, F.lit(j)).otherwise(0) for j in levels])
    return occupied.select("cloud", "n", F.when(F.col("span") > 0, F.col("span") / F.pow(F.lit(2.0), fine)).otherwise(1.0).alias("r"))


def nearest(points: DataFrame, k: int, ends: bool = True) -> DataFrame:
    """(cloud, src, dst, w): the k nearest other points of every point, ties by id; fewer in tiny clouds.

    Without ``ends``, for k = 1, only (cloud, src, w): the least of a plain number needs no sort of the pairs.

    Neighbours are told apart by id, so a coincident point is a neighbour at distance 0. The first radius comes from
    how many cells are occupied at halving widths; points that find k neighbours within it are final, the others go
    on with twice, then four times as much. Each round is one table.
    """
    points = points.select("cloud", "id", *AXES)
    start = settle(_start_radius(points)).where("n > 1")
    everyone = with_cloud(points, start)
    waiting, found, wider = everyone, None, 1
    while True:
        radius = F.col("r") * wider
        if found is None:
            pairs = both_ways(_pairs(everyone, radius))
        else:
            pairs = _meet(_cells(waiting, radius, "all").withColumn("r", radius), _cells(everyone, radius))
        if not ends:
            hit = pairs.groupBy("cloud", "src").agg(F.min("w").alias("w")).withColumn("m", F.lit(1))
        elif k == 1:
            hit = pairs.groupBy("cloud", "src").agg(F.min(F.struct("w", "dst")).alias("h")).select("cloud", "src", "h.dst", "h.w", F.lit(1).alias("m"))
        else:
            own = Window.partitionBy("cloud", "src")
            ranked = pairs.withColumn("_rank", F.row_number().over(own.orderBy("w", "dst"))).where(F.col("_rank") <= k)
            hit = ranked.withColumn("m", F.count("*").over(own)).drop("_rank")
        hit = settle(with_cloud(hit, start.select("cloud", "n")).where(F.col("m") >= F.least(F.lit(k), F.col("n") - 1)).drop("n", "m"))
        found = hit if found is None else found.unionByName(hit)
        waiting = settle(waiting.join(shuffled(hit.select("cloud", F.col("src").alias("id")).distinct()), ["cloud", "id"], "left_anti"))
        if waiting.isEmpty():
            return found
        wider *= 2 if wider == 1 else 4


def pitch(points: DataFrame) -> DataFrame:
    """(cloud, pitch): exact median over points of the distance to the nearest other point; 1.0 for single points."""
    near = exact_median(nearest(points, 1, False), "w", "_p")
    return points.select("cloud").distinct().join(near, "cloud", "left").select("cloud", F.coalesce("_p", F.lit(1.0)).alias("pitch"))


def with_scale(points: DataFrame, scale: float | None, name: str = "scale") -> DataFrame:
    """points with their cloud's scale: the given one, or the pitch."""
    if scale is not None:
        return points.withColumn(name, F.lit(float(scale)))
    return with_cloud(points, settle(pitch(points).withColumnRenamed("pitch", name)))


def radius_edges(points: DataFrame, factor: float = 1.6, scale: float | None = None) -> DataFrame:
    """Edges between points at most ``factor`` times the scale apart."""
    return pairs_within(with_scale(points, scale), F.lit(float(factor)) * F.col("scale"))


def knn_edges(points: DataFrame, k: int = 10) -> DataFrame:
    """Undirected union of each point's edges to its k nearest others."""
    near = nearest(points, k)
    return near.select("cloud", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").groupBy("cloud", "src", "dst").agg(F.min("w").alias("w"))


def mst_edges(points: DataFrame, k: int = 10) -> DataFrame:
    """Minimum spanning forest of the k-nearest graph under the total order (w, src, dst), by Boruvka rounds."""
    edges = settle(knn_edges(points, k))
    labels = edges.select("cloud", F.col("src").alias("node")).unionByName(edges.select("cloud", F.col("dst").alias("node"))).distinct().withColumn("comp", F.col("node"))
    chosen = None
    while True:
        at = lambda side: shuffled(labels.select("cloud", F.col("node").alias(side), F.col("comp").alias(f"c_{side}")))
        open_edges = edges.join(at("src"), ["cloud", "src"]).join(at("dst"), ["cloud", "dst"]).where("c_src <> c_dst")
        key = F.struct("w", "src", "dst", "c_src", "c_dst")
        ends = open_edges.select("cloud", F.explode(F.array("c_src", "c_dst")).alias("comp"), key.alias("e"))
        picked = settle(ends.groupBy("cloud", "comp").agg(F.min("e").alias("e")).select("cloud", "e.*").distinct())
        if picked.isEmpty():
            return edges.limit(0) if chosen is None else chosen
        step = picked.select("cloud", "src", "dst", "w")
        chosen = step if chosen is None else chosen.unionByName(step)
        merged = connected_components(picked.select("cloud", F.col("c_src").alias("src"), F.col("c_dst").alias("dst")), settle, ("cloud",))
        labels = settle(labels.join(shuffled(merged.withColumnRenamed("node", "comp")), ["cloud", "comp"], "left").select("cloud", "node", F.coalesce("root", "comp").alias("comp")))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    turned = edges.withColumn("_ends", F.explode(ends))
    return turned.select(*[F.col(f"_ends.{c}").alias(c) if c in ("src", "dst") else F.col(c) for c in edges.columns])


def with_lengths(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edges with w taken anew from coordinates."""
    e, a, b = edges.select("cloud", "src", "dst").alias("e"), shuffled(points).alias("a"), shuffled(points).alias("b")
    joined = e.join(a, (F.col("e.cloud") == F.col("a.cloud")) & (F.col("e.src") == F.col("a.id"))).join(b, (F.col("e.cloud") == F.col("b.cloud")) & (F.col("e.dst") == F.col("b.id")))
    return joined.select("e.cloud", "e.src", "e.dst", distance("a", "b").alias("w"))


def prune_shortcuts(edges: DataFrame, eps: float = EPS) -> DataFrame:
    """Edges (i, j) without a common neighbour k whose both legs are shorter than w - eps.

    A witness's legs are strictly shorter than the edge, so removing edges longest first against the live graph
    equals this one anti-join against the original graph.
    """
    e = edges.select("cloud", "src", "dst", "w")
    legs = both_ways(e)
    first = e.join(shuffled(legs.select("cloud", "src", F.col("dst").alias("k"), F.col("w").alias("w1"))), ["cloud", "src"]).where(F.col("w1") < F.col("w") - eps)
    second = legs.select("cloud", F.col("src").alias("dst"), F.col("dst").alias("k"), F.col("w").alias("w2"))
    seen = first.join(shuffled(second), ["cloud", "dst", "k"]).where(F.col("w2") < F.col("w") - eps).select("cloud", "src", "dst")
    return e.join(shuffled(seen), ["cloud", "src", "dst"], "left_anti")


def ball_counts(points: DataFrame, factor: float = 2.5, scale: float | None = None) -> DataFrame:
    """(cloud, id, n): points within the radius of each point, itself included."""
    near = both_ways(radius_edges(points, factor, scale)).groupBy("cloud", F.col("src").alias("id")).agg(F.count("*").alias("_m"))
    return points.select("cloud", "id").join(shuffled(near), ["cloud", "id"], "left").select("cloud", "id", (F.coalesce("_m", F.lit(0)) + 1).alias("n"))


def build_edges(points: DataFrame, cfg: NeighborConfig) -> DataFrame:
    """The adjacency graph that the settings ask for, not pruned."""
    cfg.check()
    if cfg.method == "radius":
        return radius_edges(points, cfg.radius_factor, cfg.scale)
    return (knn_edges if cfg.method == "knn" else mst_edges)(points, cfg.k)
