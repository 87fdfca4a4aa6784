"""Topology of a graph: degrees, node kinds, ordered segments, summary.

Nodes are (cloud, id[, x, y, z]); edges are (cloud, src, dst). Self-loops are rejected by ``segments``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import AXES
from ..functions.joins import shuffled
from ..functions.lineage import settle
from .components import connected_components
from .neighbors import both_ways
from .order import numbered


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cloud, id, degree); a self-loop counts twice, a node without edges has 0."""
    ends = edges.select("cloud", F.explode(F.array("src", "dst")).alias("id")).groupBy("cloud", "id").agg(F.count("*").cast("int").alias("_d"))
    return nodes.select("cloud", "id").join(shuffled(ends), ["cloud", "id"], "left").select("cloud", "id", F.coalesce("_d", F.lit(0)).alias("degree"))


def node_kinds(degree: DataFrame) -> DataFrame:
    kind = F.when(F.col("degree") >= 3, "branch").when(F.col("degree") == 2, "interior").when(F.col("degree") == 1, "tip").otherwise("isolated")
    return degree.withColumn("kind", kind)


def branch_points(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """(cloud, branch_id, node_id, x, y, z): nodes of degree 3 and more, numbered by id within the cloud."""
    axes = [c for c in AXES if c in nodes.columns]
    picked = numbered(degree.where("degree >= 3").select("cloud", F.col("id").alias("node_id")), "node_id", ["node_id"], "branch_id")
    placed = picked.join(shuffled(nodes.select("cloud", F.col("id").alias("node_id"), *axes)), ["cloud", "node_id"])
    return placed.select("cloud", F.col("branch_id").cast("int").alias("branch_id"), "node_id", *axes)


def tips(degree: DataFrame) -> DataFrame:
    return degree.where("degree = 1").select("cloud", "id")


def isolated(degree: DataFrame) -> DataFrame:
    return degree.where("degree = 0").select("cloud", "id")


def _paths(degree: DataFrame, edges: DataFrame) -> DataFrame:
    """(cloud, points, loop): every chain once, oriented from its least special end (or loop start).

    List ranking on darts (directed edges): a dart that leaves a node of degree 2 is preceded by the one that enters
    it; pointers double until each dart knows its chain's first dart and its distance, in log2(longest chain) joins.
    A pure loop is cut at its least node.
    """
    darts = both_ways(edges.select("cloud", "src", "dst")).withColumnRenamed("src", "u").withColumnRenamed("dst", "v")
    inner = degree.where("degree = 2").select("cloud", F.col("id").alias("u"))
    comps = connected_components(edges, settle, ("cloud",))
    rings = comps.join(shuffled(degree.withColumnRenamed("id", "node")), ["cloud", "node"]).groupBy("cloud", "root").agg(F.max("degree").alias("hi"), F.min("degree").alias("lo")).where("hi = 2 and lo = 2")
    cut = rings.select("cloud", F.col("root").alias("u"))
    passing = darts.join(shuffled(inner), ["cloud", "u"], "left_semi").join(shuffled(cut), ["cloud", "u"], "left_anti")
    before = darts.select("cloud", F.col("u").alias("pu"), F.col("v").alias("u"))
    linked = passing.join(shuffled(before), ["cloud", "u"]).where("pu <> v")
    state = darts.join(shuffled(linked), ["cloud", "u", "v"], "left").select("cloud", "u", "v", F.coalesce("pu", "u").alias("pu"), F.when(F.col("pu").isNull(), F.col("v")).otherwise(F.col("u")).alias("pv"), F.col("pu").isNotNull().cast("long").alias("d"))
    state = settle(state)
    while True:
        jump = state.select("cloud", F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("pu").alias("qu"), F.col("pv").alias("qv"), F.col("d").alias("e"))
        new = settle(state.join(shuffled(jump), ["cloud", "pu", "pv"]).select("cloud", "u", "v", F.col("qu").alias("pu"), F.col("qv").alias("pv"), (F.col("d") + F.col("e")).alias("d"), (F.col("e") > 0).alias("moved")))
        moved = not new.where("moved").isEmpty()
        state = new.drop("moved")
        if not moved:
            break
    chains = state.groupBy("cloud", F.col("pu").alias("a"), F.col("pv").alias("first")).agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("hops"))
    chains = chains.select("cloud", F.concat(F.array("a"), F.col("hops.v")).alias("points"))
    last, hop_back = F.element_at("points", -1), F.element_at("points", -2)
    a, first = F.element_at("points", 1), F.element_at("points", 2)
    kept = chains.where((a < last) | ((a == last) & (first <= hop_back)))
    loops = shuffled(cut.select("cloud", F.col("u").alias("_cut")))
    return kept.join(loops, (kept.cloud == loops.cloud) & (F.element_at("points", 1) == F.col("_cut")), "left").select(kept.cloud, "points", F.col("_cut").isNotNull().alias("loop"))


SEGMENT_COLUMNS = ("cloud", "seg_id", "points", "end_node_a", "end_node_b", "end_a", "end_b", "closed", "n_branch_ends", "n_points")


def segments(nodes: DataFrame, edges: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """Ordered, un-branching chains: anchored ones, pure loops (start repeated at the end), isolated nodes.

    seg_id follows (first node, first hop) among anchored chains, then loops by least node, then isolates by id.
    """
    if not edges.where("src = dst").isEmpty():
        raise ValueError("self-loops are not supported")
    degree = settle(degrees(nodes, edges) if degree is None else degree)
    edges = settle(edges.select("cloud", "src", "dst"))
    chains = _paths(degree, edges)
    single = isolated(degree).select("cloud", F.array("id").alias("points"), F.lit(False).alias("loop"), F.lit(2).alias("class"))
    rows = chains.withColumn("class", F.when(F.col("loop"), 1).otherwise(0)).unionByName(single)
    ends_none = F.col("class") > 0
    rows = rows.select(
        "cloud", "points", "class",
        F.when(~ends_none, F.element_at("points", 1)).alias("end_node_a"),
        F.when(~ends_none, F.element_at("points", -1)).alias("end_node_b"),
        ((F.size("points") > 1) & (F.element_at("points", 1) == F.element_at("points", -1))).alias("closed"),
    )
    branch = settle(numbered(degree.where("degree >= 3").select("cloud", "id"), "id", ["id"], "_branch"))
    for side in ("a", "b"):
        rows = rows.join(shuffled(branch.select("cloud", F.col("id").alias(f"end_node_{side}"), F.col("_branch").cast("int").alias(f"end_{side}"))), ["cloud", f"end_node_{side}"], "left")
    rows = settle(rows)
    # Anchored chains come first, then loops, then isolates: each class is numbered by its first nodes.
    first = F.element_at("points", 1)
    second = F.when(F.size("points") > 1, F.element_at("points", 2))
    rows = rows.withColumn("_first", first).withColumnRenamed("cloud", "_cloud").withColumn("cloud", F.struct("_cloud", "class"))
    rows = numbered(rows, "_first", ["_first", second, "points"], "_number").withColumn("cloud", F.col("_cloud"))
    sizes = rows.groupBy("cloud", "class").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy("cloud").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_past", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    rows = rows.join(shuffled(sizes.select("cloud", "class", "_past")), ["cloud", "class"])
    distinct_ends = F.size(F.array_distinct(F.array_compact(F.array("end_a", "end_b")))).cast("int")
    rows = rows.withColumn("seg_id", (F.col("_number") + F.col("_past")).cast("int"))
    return rows.withColumn("n_branch_ends", distinct_ends).withColumn("n_points", F.size("points").cast("int")).select(*SEGMENT_COLUMNS)


def summary(nodes: DataFrame, degree: DataFrame, segs: DataFrame) -> DataFrame:
    """One row per cloud: branch_points, segments, by branch ends 0, 1 and 2, closed_loops, isolated."""
    counted = segs.groupBy("cloud").agg(
        F.count("*").alias("segments"), *[F.count_if(F.col("n_branch_ends") == i).alias(f"branch_ends_{i}") for i in range(3)],
        F.count_if(F.col("closed") & (F.col("n_branch_ends") == 0)).alias("closed_loops"))
    kinds = degree.groupBy("cloud").agg(F.count_if(F.col("degree") >= 3).alias("branch_points"), F.count_if(F.col("degree") == 0).alias("isolated"))
    zero = {c: 0 for c in ("segments", "branch_ends_0", "branch_ends_1", "branch_ends_2", "closed_loops")}
    return kinds.join(shuffled(counted), "cloud", "left").fillna(zero).select("cloud", "branch_points", *zero, "isolated")


def segment_edges(segs: DataFrame) -> DataFrame:
    """(cloud, seg_id, idx, a, b): consecutive nodes of each segment."""
    hops = F.explode(F.transform(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))), lambda p, i: F.struct(i.alias("idx"), p.alias("a"), F.get("points", i + 1).alias("b"))))
    return segs.select("cloud", "seg_id", hops.alias("h")).select("cloud", "seg_id", "h.*")


def edge_partition_faults(edges: DataFrame, segs: DataFrame) -> DataFrame:
    """Edges that are not in exactly one segment hop; empty for a right result."""
    hops = segment_edges(segs).select("cloud", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    own = edges.select("cloud", "src", "dst")
    return own.exceptAll(hops).unionByName(hops.exceptAll(own))
