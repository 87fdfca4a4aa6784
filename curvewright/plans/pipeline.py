"""From points to topology: extraction, its trace, and requests."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config, build_config, clean_config
from ..functions.geometry import AXES
from ..functions.joins import shuffled, with_cloud
from ..functions.lineage import settle, settle_points
from ..operators import cleanup, neighbors, reduce, topology
from ..sources import clouds


@dataclass
class Topology:
    """The result as DataFrames, keyed by cloud."""

    nodes: DataFrame
    edges: DataFrame
    degree: DataFrame
    segments: DataFrame
    branch_points: DataFrame
    isolated: DataFrame
    membership: DataFrame
    stages: dict[str, DataFrame] = field(default_factory=dict)

    def summary(self) -> DataFrame:
        return topology.summary(self.nodes, self.degree, self.segments)

    def summary_text(self) -> DataFrame:
        """(cloud, text): one line for each cloud."""
        s = self.summary()
        return s.select("cloud", F.format_string("%d branch points, %d segments (0-branch: %d, 1-branch: %d, 2-branch: %d), %d closed loop(s), %d isolated point(s)", "branch_points", "segments", "branch_ends_0", "branch_ends_1", "branch_ends_2", "closed_loops", "isolated").alias("text"))

    def show(self) -> None:
        self.summary_text().show(truncate=False)


def extract_topology(edges: DataFrame, nodes: DataFrame, min_stub_points: int = 0, membership: DataFrame | None = None) -> Topology:
    """Branch points, segments and isolates of any simple graph whose ids are those of ``nodes``."""
    nodes, edges = settle(nodes), settle(edges.select("cloud", "src", "dst"))
    degree = settle(topology.degrees(nodes, edges))
    segs = topology.segments(nodes, edges, degree)
    if min_stub_points:
        segs = cleanup.prune_stubs(segs, min_stub_points)
    own = nodes.select("cloud", "id", F.col("id").alias("node_id"))
    return Topology(nodes, edges, degree, settle(segs), topology.branch_points(nodes, degree), topology.isolated(degree), membership if membership is not None else own)


def extract(points: DataFrame, config: Config | None = None, keep_stages: bool = False, max_frames: int = 0) -> Topology:
    """Points (cloud, id, x, y, z) to topology. In mode auto each cloud goes the way that its own vote says."""
    cfg = (config or Config()).check()
    points = settle_points(points.select("cloud", "id", *AXES))
    if cfg.reduce.mode != "auto":
        return _extract(points, cfg, cfg.reduce.mode, keep_stages, max_frames)
    votes = settle(reduce.auto_vote(points, cfg.reduce))
    parts = [_extract(with_cloud(points, votes.where(F.col("chosen") == m), "left_semi"), cfg, m, keep_stages, max_frames) for m in ("collapse", "surface") if not votes.where(F.col("chosen") == m).isEmpty()]
    if not parts:
        return _extract(points, cfg, "surface", keep_stages, max_frames)
    names = ("nodes", "edges", "degree", "segments", "branch_points", "isolated", "membership")
    made = parts[0] if len(parts) == 1 else Topology(*[getattr(parts[0], n).unionByName(getattr(parts[1], n)) for n in names])
    stages = {k: v for p in parts for k, v in p.stages.items()}
    return Topology(*[getattr(made, n) for n in names], stages={**stages, "auto": votes} if keep_stages else {})


def _extract(points: DataFrame, cfg: Config, mode: str, keep: bool, max_frames: int) -> Topology:
    stages: dict[str, DataFrame] = {"input": points}
    membership = None
    if mode == "collapse":
        graph = settle(reduce.contraction_graph(points, cfg.reduce))
        last = int(cfg.reduce.contraction_iterations)
        shown = frame_numbers(last, max_frames) if max_frames else []
        frames = settle(reduce.contraction_frames(points, graph, cfg.reduce, {last, *shown}))
        contracted = frames.where(F.col("frame") == last).drop("frame")
        nodes, edges, membership = reduce.edge_collapse(contracted, graph, cfg.reduce.merge_factor, points)
        nodes, edges = settle(nodes), settle(neighbors.with_lengths(edges, nodes))
        stages |= {"contraction_graph": graph, "contracted": contracted, "skeleton_points": nodes, "skeleton_edges": edges}
        if max_frames:
            stages["contraction_frames"] = frames.where(F.col("frame").isin(shown))
    else:
        nodes, edges = points, settle(neighbors.build_edges(points, cfg.neighbors))
        stages["adjacency_edges"] = edges
    if mode != "surface" and cfg.neighbors.prune_shortcuts:
        kept = settle(neighbors.prune_shortcuts(edges))
        stages["pruned_edges"] = edges.join(shuffled(kept), ["cloud", "src", "dst"], "left_anti")
        edges = kept
    if mode != "surface" and cfg.junction_merge_factor > 0:
        gap = settle(cleanup.median_edge(nodes, edges).select("cloud", (F.col("median_edge") * float(cfg.junction_merge_factor)).alias("max_gap")))
        merged = settle(cleanup.junction_edges(nodes, edges, gap))
        stages |= {"max_gap": gap, "merged_edges": merged, "before_points": nodes}
        if not merged.isEmpty():
            nodes, edges, moved = cleanup.merge_nodes(nodes, edges, merged)
            via = membership if membership is not None else points.select("cloud", "id", F.col("id").alias("node_id"))
            membership = via.join(shuffled(moved.select("cloud", F.col("id").alias("node_id"), F.col("node_id").alias("_to"))), ["cloud", "node_id"]).select("cloud", "id", F.col("_to").alias("node_id"))
    found = extract_topology(edges, nodes, cfg.min_stub_points if mode != "surface" else 0, membership)
    found.stages = {**stages, "mode": points.select("cloud", F.lit(mode).alias("effective_mode")).distinct()} if keep else {}
    return found


def frame_numbers(total: int, max_frames: int) -> list[int]:
    """Evenly spaced iteration numbers from 0 to total, truncated to integers."""
    count = min(max_frames, total + 1)
    return sorted({int(total * i / (count - 1)) for i in range(count)}) if count > 1 else [0]


def trace(points: DataFrame, config: Config | None = None, animate: bool = False, max_frames: int = 12) -> dict[str, DataFrame]:
    """Every stage of the extraction as a DataFrame: input, reduction, pruned and merged edges, topology, summary."""
    found = extract(points, config, keep_stages=True, max_frames=max_frames if animate else 0)
    return {
        **found.stages, "nodes": found.nodes, "edges": found.edges, "node_kinds": topology.node_kinds(found.degree), "segments": found.segments,
        "branch_points": found.branch_points, "isolated": found.isolated, "membership": found.membership, "summary": found.summary(), "notes": found.summary_text(),
    }


#: Digits of the coordinates in a trace that is written out, rounded half to even.
POINT_DIGITS = 4


def trace_json(stages: Mapping[str, DataFrame]) -> DataFrame:
    """(stage, cloud, json): one row per row of every stage, as JSON; coordinates as one rounded point."""
    out = None
    for name, df in stages.items():
        columns = [c for c in df.columns if c not in ("cloud", *AXES)]
        if set(AXES) <= set(df.columns):
            df = df.withColumn("point", F.array(*[F.bround(c, POINT_DIGITS) for c in AXES]))
            columns.append("point")
        row = df.select(F.lit(name).alias("stage"), F.col("cloud").cast("string").alias("cloud"), F.to_json(F.struct(*columns)).alias("json"))
        out = row if out is None else out.unionByName(row)
    return out


def run_pipeline(spark: SparkSession, request: Mapping[str, Any]) -> dict[str, Any]:
    """A request {dataset, gen_params, config, animate} to {dataset, meta, stages}; KeyError for an unknown dataset."""
    key = request.get("dataset")
    points, meta = clouds.generate(spark, key, request.get("gen_params") or {})
    cfg = build_config(clean_config(request.get("config") or {}))
    return {"dataset": key, "meta": meta, "stages": trace(points, cfg, bool(request.get("animate")))}


def associate(points: DataFrame, found: Topology) -> DataFrame:
    """Nearest segment hop of every point: seg_id, idx, t in [0, 1], d_perp, foot arclength along the segment.

    Distances that agree to nine digits are ties; the least seg_id and idx is taken.

    Points meet the hops of their own cloud through an equi-join on it, folded at once into a least row per point.
    """
    hops = topology.segment_edges(found.segments)
    at = found.nodes.select("cloud", "id", *AXES)
    a, b = (at.select("cloud", F.col("id").alias(s), *[F.col(c).alias(f"{s}{c}") for c in AXES]) for s in ("a", "b"))
    hops = hops.join(shuffled(a), ["cloud", "a"]).join(shuffled(b), ["cloud", "b"])
    length = F.sqrt(sum(((F.col(f"b{c}") - F.col(f"a{c}")) * (F.col(f"b{c}") - F.col(f"a{c}")) for c in AXES), F.lit(0.0)))
    order = Window.partitionBy("cloud", "seg_id").orderBy("idx")
    hops = hops.withColumn("len", length).withColumn("cum", F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len"))
    pairs = points.select("cloud", "id", *AXES).join(shuffled(hops), "cloud")
    dot = sum(((F.col(c) - F.col(f"a{c}")) * (F.col(f"b{c}") - F.col(f"a{c}")) for c in AXES), F.lit(0.0))
    t = F.when(F.col("len") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / (F.col("len") * F.col("len"))))).otherwise(0.0)
    pairs = pairs.withColumn("t", t)
    off = sum(((F.col(c) - F.col(f"a{c}") - F.col("t") * (F.col(f"b{c}") - F.col(f"a{c}"))) ** 2 for c in AXES), F.lit(0.0))
    best = F.min(F.struct(F.round(F.sqrt(off), 9).alias("_near"), "seg_id", "idx", "t", F.sqrt(off).alias("d_perp"), (F.col("cum") + F.col("t") * F.col("len")).alias("foot_arclength"))).alias("h")
    return pairs.groupBy("cloud", "id").agg(best).select("cloud", "id", "h.seg_id", "h.idx", "h.t", "h.d_perp", "h.foot_arclength")
