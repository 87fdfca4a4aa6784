"""Junction consolidation and stub pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES
from ..functions.joins import shuffled, with_cloud
from ..functions.lineage import settle
from .components import connected_components
from .neighbors import with_lengths
from .order import exact_median, numbered
from .topology import degrees


def median_edge(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cloud, median_edge): exact median edge length from coordinates; 0.0 without edges."""
    lengths = exact_median(settle(with_lengths(edges, nodes).select("cloud", "w")), "w", "_m")
    return nodes.select("cloud").distinct().join(shuffled(lengths), "cloud", "left").select("cloud", F.coalesce("_m", F.lit(0.0)).alias("median_edge"))


def merge_nodes(nodes: DataFrame, edges: DataFrame, merged: DataFrame, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contract the components of ``merged`` edges: (new nodes, new edges, membership (cloud, id, node_id)).

    A new id counts the clusters with a smaller least member; it stands at its members' mean place. Parallel edges
    become one and edges within a cluster go.
    """
    roots = connected_components(merged.select("cloud", "src", "dst"), settle, ("cloud",)).withColumnRenamed("node", "id")
    member = nodes.select("cloud", "id").join(shuffled(roots), ["cloud", "id"], "left").select("cloud", "id", F.coalesce("root", "id").alias("root"))
    member = settle(member)
    number = numbered(member.select("cloud", "root").distinct(), "root", ["root"], "node_id")
    member = settle(member.join(shuffled(number), ["cloud", "root"]).select("cloud", "id", "node_id"))
    at = (places if places is not None else nodes).select("cloud", "id", *AXES)
    new_nodes = at.join(shuffled(member), ["cloud", "id"]).groupBy("cloud", "node_id").agg(*[F.avg(c).alias(c) for c in AXES]).withColumnRenamed("node_id", "id")
    side = lambda s, n: shuffled(member.select("cloud", F.col("id").alias(s), F.col("node_id").alias(n)))
    moved = edges.select("cloud", "src", "dst").join(side("src", "p"), ["cloud", "src"]).join(side("dst", "q"), ["cloud", "dst"])
    new_edges = moved.where("p <> q").select("cloud", F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst")).distinct()
    return new_nodes.select("cloud", "id", *AXES), new_edges, member


def junction_edges(nodes: DataFrame, edges: DataFrame, max_gap: DataFrame) -> DataFrame:
    """Edges between two nodes of degree 3 or more that are shorter than the cloud's max_gap."""
    branch = degrees(nodes, edges).where("degree >= 3").select("cloud", "id")
    short = with_cloud(with_lengths(edges, nodes), settle(max_gap)).where("w < max_gap")
    for side in ("src", "dst"):
        short = short.join(shuffled(branch.withColumnRenamed("id", side)), ["cloud", side], "left_semi")
    return short.select("cloud", "src", "dst", "w")


def consolidate(nodes: DataFrame, edges: DataFrame, factor: float = 2.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fuse junctions joined by edges shorter than ``factor`` times the median edge; see ``merge_nodes``."""
    gap = median_edge(nodes, edges).select("cloud", (F.col("median_edge") * factor).alias("max_gap"))
    return merge_nodes(nodes, edges, junction_edges(nodes, edges, gap))


def prune_stubs(segs: DataFrame, min_points: int) -> DataFrame:
    """Drop open segments with one free end and one branch end that have fewer points than ``min_points``."""
    free = F.col("end_a").isNull() | F.col("end_b").isNull()
    return segs.where(~((F.col("n_branch_ends") == 1) & ~F.col("closed") & free & (F.col("n_points") < min_points)))
