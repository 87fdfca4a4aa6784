"""Hand-built graphs and small clouds with known topology."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvewright import Config, NeighborConfig, ReduceConfig, extract, extract_topology, from_array, generate, run_pipeline, trace
from curvewright.config import build_config, clean_config, config_schema
from curvewright.functions.kernels import contract
from curvewright.functions.lineage import settle
from curvewright.operators import cleanup, neighbors, order, reduce, topology
from curvewright.operators.components import connected_components
from curvewright.plans.pipeline import frame_numbers, trace_json
from curvewright.sources.clouds import DATASETS, dataset_schema


def graph(spark, edges, extra=()):
    ids = sorted({i for e in edges for i in e} | set(extra))
    nodes = spark.createDataFrame([("0", i, float(i), 0.0, 0.0) for i in ids], "cloud string, id long, x double, y double, z double")
    return extract_topology(spark.createDataFrame([("0", *sorted(e)) for e in edges], "cloud string, src long, dst long"), nodes)


def rows(found):
    return [(r.points, r.closed, r.n_branch_ends) for r in found.segments.orderBy("seg_id").collect()]


#: A path with ids out of order, a star of four, a caterpillar, a ring of five, a ring with two tails at one node, a
#: theta of three paths between two nodes, and two components with a lone node.
GRAPHS = [
    ([(4, 9), (9, 2), (2, 7)], (), 0, [([4, 9, 2, 7], False, 0)]),
    ([(5, 1), (5, 2), (5, 3), (3, 8), (5, 4)], (), 1, [([1, 5], False, 1), ([2, 5], False, 1), ([4, 5], False, 1), ([5, 3, 8], False, 1)]),
    ([(0, 1), (1, 2), (2, 3), (1, 11), (2, 12)], (), 2, [([0, 1], False, 1), ([1, 2], False, 2), ([1, 11], False, 1), ([2, 3], False, 1), ([2, 12], False, 1)]),
    ([(3, 6), (6, 4), (4, 8), (8, 5), (5, 3)], (), 0, [([3, 5, 8, 4, 6, 3], True, 0)]),
    ([(2, 5), (5, 7), (7, 2), (2, 10), (2, 11)], (), 1, [([2, 5, 7, 2], True, 1), ([2, 10], False, 1), ([2, 11], False, 1)]),
    ([(0, 9), (0, 4), (4, 9), (0, 5), (5, 6), (6, 9)], (), 2, [([0, 4, 9], False, 2), ([0, 5, 6, 9], False, 2), ([0, 9], False, 2)]),
    ([(1, 2), (3, 4), (4, 6)], (20,), 0, [([1, 2], False, 0), ([3, 4, 6], False, 0), ([20], False, 0)]),
]


def test_hand_built_graphs(spark):
    """All graphs at once, a cloud each, against what was worked out by hand."""
    edges = [(str(n), *sorted(e)) for n, (own, _, _, _) in enumerate(GRAPHS) for e in own]
    ids = [(str(n), i) for n, (own, extra, _, _) in enumerate(GRAPHS) for i in sorted({i for e in own for i in e} | set(extra))]
    nodes = spark.createDataFrame([(c, i, float(i), 0.0, 0.0) for c, i in ids], "cloud string, id long, x double, y double, z double")
    found = extract_topology(spark.createDataFrame(edges, "cloud string, src long, dst long"), nodes)
    got, branches = {}, {}
    for r in found.segments.orderBy("seg_id").collect():
        got.setdefault(r.cloud, []).append((r.points, r.closed, r.n_branch_ends))
    for r in found.branch_points.collect():
        branches[r.cloud] = branches.get(r.cloud, 0) + 1
    for n, (_, _, branch, want) in enumerate(GRAPHS):
        assert (branches.get(str(n), 0), got[str(n)]) == (branch, want)
    assert topology.edge_partition_faults(found.edges, found.segments).isEmpty()


def test_self_loops_are_rejected(spark):
    with pytest.raises(ValueError):
        graph(spark, [(0, 1), (1, 1)])


def test_pruning_keeps_short_legs_and_even_rings(spark):
    bent = from_array(spark, [[0, 0, 0], [2, 0, 0], [2, 1.5, 0]])
    kept = neighbors.prune_shortcuts(neighbors.radius_edges(bent, 3.0, 1.0))
    assert sorted((r.src, r.dst) for r in kept.collect()) == [(0, 1), (1, 2)]
    hub = np.array([[0, 0, 0], *[[3 * np.cos(a), 3 * np.sin(a), 0] for a in np.arange(5) * 2 * np.pi / 5]])
    spokes = neighbors.prune_shortcuts(neighbors.radius_edges(from_array(spark, hub), 9.0, 1.0))
    assert sorted((r.src, r.dst) for r in spokes.collect()) == [(0, i) for i in range(1, 6)]


def test_neighbours_equal_brute_force(spark):
    points = np.random.default_rng(4).normal(size=(120, 3))
    points[7] = points[3]
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    cloud = settle(from_array(spark, points))
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if apart[i, j] <= 0.6}
    assert {(r.src, r.dst) for r in neighbors.radius_edges(cloud, 0.6, 1.0).collect()} == want
    near = {(i, j) for i in range(120) for j in sorted((k for k in range(120) if k != i), key=lambda k: (apart[i, k], k))[:4]}
    assert {(r.src, r.dst) for r in neighbors.nearest(cloud, 4).collect()} == near
    np.fill_diagonal(apart, np.inf)
    assert neighbors.pitch(cloud).first().pitch == pytest.approx(float(np.median(apart.min(1))))


def test_spanning_forest(spark):
    cloud = settle(from_array(spark, np.random.default_rng(2).normal(size=(40, 3))))
    near = [(r.w, r.src, r.dst) for r in neighbors.knn_edges(cloud, 5).collect()]
    root = list(range(40))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = set()
    for _, a, b in sorted(near):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b))
    assert {(r.src, r.dst) for r in neighbors.mst_edges(cloud, 5).collect()} == want


@pytest.mark.parametrize("few", [0, 500_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr("curvewright.operators.components.BROADCAST_EDGES", few)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 55), (9, 3)], "src long, dst long")
    found = {r.node: r.root for r in connected_components(edges, settle).collect()}
    assert found == {**dict.fromkeys(range(31), 0), 50: 50, 55: 50, 60: 50}


def test_whole_clouds_need_no_rounds_of_components(spark):
    """A task joins what it holds of a cloud, so long chains with ids out of order are one table, not many rounds of them."""
    order = np.random.default_rng(7).permutation(300)
    edges = spark.createDataFrame([(c, int(a), int(b)) for c in "pq" for a, b in zip(order, order[1:])], "cloud string, src long, dst long")
    tables = []
    found = connected_components(edges, lambda df: tables.append(settle(df)) or tables[-1], ("cloud",))
    assert sorted((r.cloud, r.node, r.root) for r in found.collect()) == [(c, n, 0) for c in "pq" for n in range(300)]
    assert len(tables) == 1


@pytest.mark.parametrize("most", [40, 10**6])
def test_components_across_tasks_and_chunks(spark, monkeypatch, most):
    """Clouds whose edges lie in several ranges and chunks are joined by the rounds that follow."""
    monkeypatch.setattr("curvewright.operators.components.LOCAL_EDGES", most)
    rng = np.random.default_rng(3)
    pairs = [(c, int(a), int(b)) for c in "pq" for a, b in rng.integers(0, 120, (90, 2))]
    edges = spark.createDataFrame(pairs, "cloud string, src long, dst long")
    least = {(c, n): n for c, a, b in pairs for n in (a, b) if a != b}
    for _ in range(120):
        for c, a, b in pairs:
            if a != b:
                least[c, a] = least[c, b] = min(least[c, a], least[c, b])
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the ranges become one task
    try:
        found = {(r.cloud, r.node): r.root for r in connected_components(edges, settle, ("cloud",)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found == least


def test_tiny_clouds(spark):
    empty = from_array(spark, [])
    assert extract(empty).segments.isEmpty()
    one = extract(from_array(spark, [[1, 2, 3]]))
    assert rows(one) == [([0], False, 0)]
    assert neighbors.pitch(from_array(spark, [[1, 2, 3]])).first().pitch == 1.0
    assert rows(extract(from_array(spark, [[1, 2, 3]]), Config(neighbors=NeighborConfig(method="knn")))) == [([0], False, 0)]


def test_many_clouds_at_once(spark):
    a, b = generate(spark, "y_junction")[0], generate(spark, "loop")[0].withColumn("cloud", F.lit("1"))
    s = {r.cloud: r for r in extract(a.unionByName(b)).summary().collect()}
    assert (s["0"].branch_points, s["0"].segments, s["1"].closed_loops) == (1, 3, 1)


def named(df, name):
    return df.withColumn("cloud", F.lit(name))


def shapes(spark):
    """Clouds of points on lines: a cross of four arms, a lattice of three by two, a line."""
    arms = [(k * dx, k * dy, 0.0) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)) for k in range(1, 7)]
    line = [(0.5 * k, 0.0, 0.0) for k in range(20)]
    grid = generate(spark, "grid", {"nx": 3, "ny": 2})[0]
    return named(from_array(spark, [(0, 0, 0), *arms]), "x").unionByName(named(grid, "grid")).unionByName(named(from_array(spark, line), "line"))


def test_points_on_lines(spark):
    points = shapes(spark)
    found = extract(points)
    s = {r.cloud: r for r in found.summary().collect()}
    assert (s["x"].branch_points, s["x"].segments, s["x"].branch_ends_1) == (1, 4, 4)
    assert (s["grid"].branch_points, s["grid"].branch_ends_1, s["line"].branch_points, s["line"].segments) == (2, 0, 0, 1)
    center = next(r for r in found.branch_points.collect() if r.cloud == "x")
    assert (center.x, center.y, center.z) == pytest.approx((0, 0, 0), abs=1e-9)
    size = {r.cloud: r.n for r in found.nodes.groupBy("cloud").agg(F.count("*").alias("n")).collect()}
    assert size == {r.cloud: r.n for r in points.groupBy("cloud").agg(F.count("*").alias("n")).collect()}
    assert all(r.n_points == 7 for r in found.segments.where("cloud = 'x'").collect())
    corners = found.degree.join(found.nodes, ["cloud", "id"]).where("cloud = 'grid' and x in (0, 8) and y in (0, 4)")
    assert [r.degree for r in corners.collect()] == [2] * 4
    assert extract(points.where("cloud = 'x'"), Config(neighbors=NeighborConfig(prune_shortcuts=False))).nodes.count() < 25


def test_tubes_collapse_to_their_centre_lines(spark):
    """Cylinder, Y of tubes, torus and tree: what their centre lines must be."""
    settings = {"reduce.mode": "collapse", "neighbors.radius_factor": 1.8}
    points = named(generate(spark, "cylinder")[0], "cylinder").unionByName(named(generate(spark, "torus")[0], "torus"))
    tree, meta = generate(spark, "tree")
    points = settle(points.unionByName(named(tree, "tree")))
    found = extract(points, build_config(settings))
    nodes = {c: np.array([(r.x, r.y, r.z) for r in rows]) for c, rows in by_cloud(found.nodes).items()}
    segs, s = by_cloud(found.segments), {r.cloud: r for r in found.summary().collect()}
    [seg] = segs["cylinder"]
    assert not seg.closed and seg.n_points >= 15
    assert np.hypot(*nodes["cylinder"].T[:2]).mean() < 0.25 and np.ptp(nodes["cylinder"][:, 2]) > 6
    [ring] = segs["torus"]
    assert ring.closed and ring.n_points >= 24 and s["torus"].branch_points == 0
    assert abs(np.hypot(*nodes["torus"].T[:2]).mean() - 5) < 1.25 and np.abs(nodes["torus"][:, 2]).mean() < 0.25
    assert s["tree"].branch_points >= 5 and s["tree"].isolated == 0 and not any(x.closed for x in segs["tree"])
    assert len(meta["truth"]["branch_points"]) == 7 and len(meta["truth"]["polylines"]) == 15
    assert found.membership.count() == points.count()
    ids = by_cloud(found.nodes.select("cloud", "id"))
    assert all({i for x in rows for i in x.points} <= {r.id for r in ids[c]} for c, rows in segs.items())


def by_cloud(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cloud, []).append(r)
    return out


def test_a_junction_of_tubes_is_one_node(spark):
    points = settle(generate(spark, "y_tube")[0])
    stages = trace(points, build_config({"reduce.mode": "collapse"}), animate=True, max_frames=4)
    blob = topology.degrees(stages["skeleton_points"], stages["skeleton_edges"]).where("degree >= 3").count()
    [center] = stages["branch_points"].collect()
    assert blob > 1 and (center.x, center.y, center.z) == pytest.approx((0, 0, 0), abs=0.4)
    [s] = stages["summary"].collect()
    assert (s.segments, s.branch_ends_1) == (3, 3)
    assert sorted({r.frame for r in stages["contraction_frames"].collect()}) == frame_numbers(10, 4)
    assert set(stages) >= {"input", "contracted", "skeleton_edges", "pruned_edges", "merged_edges", "node_kinds", "notes", "mode"}
    text = trace_json({n: stages[n] for n in ("input", "summary")}).collect()
    assert len(text) == 505 and all(json.loads(r.json) for r in text)


def test_anchors_keep_a_tube_long(spark):
    points = settle(generate(spark, "cylinder")[0])
    graph = settle(neighbors.radius_edges(points, 2.5))
    span = {}
    for gain in (0.0, 8.0):
        rows = reduce.contract_points(points, graph, ReduceConfig(boundary_anchor=gain)).collect()
        at = np.array([(r.x, r.y, r.z) for r in rows])
        span[gain] = np.ptp(at[:, 2])
        assert np.hypot(at[:, 0], at[:, 1]).mean() < 0.25 or not gain
    assert span[8.0] > 1.5 * span[0.0] and span[8.0] > 7.5


def test_every_dataset_and_request(spark):
    for key, spec in DATASETS.items():
        points, meta = generate(spark, key, {"unknown": 1})
        assert points.columns == ["cloud", "id", "x", "y", "z"] and meta["label"] == int(spec["category"] == "tubiform")
        assert json.loads(json.dumps(meta))["truth"]["polylines"]
        ids = [r.id for r in points.select("id").collect()]
        assert sorted(ids) == list(range(len(ids)))
    made = run_pipeline(spark, {"dataset": "loop", "config": {"reduce.mode": "auto", "neighbors.scale": 0}})
    assert made["dataset"] == "loop" and made["stages"]["auto"].first().chosen == "surface"


def test_stub_pruning_and_surface(spark):
    y = generate(spark, "y_junction")[0]
    assert extract(y, Config(min_stub_points=8)).segments.isEmpty()
    assert extract(y, Config(reduce=ReduceConfig(mode="surface"))).nodes.count() == 19


def test_conjugate_gradients_equal_the_dense_solve(monkeypatch):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(60, 3))
    left, right = np.arange(59), np.arange(1, 60)
    dense = contract(p, left, right, np.ones(60), 0.5, 1.6, 5)
    monkeypatch.setattr("curvewright.functions.kernels.DENSE_POINTS", 0)
    for a, b in zip(dense, contract(p, left, right, np.ones(60), 0.5, 1.6, 5), strict=True):
        assert np.allclose(a, b, atol=1e-7)


def test_settings():
    with pytest.raises(ValueError):
        Config(reduce=ReduceConfig(mode="other")).check()
    with pytest.raises(ValueError):
        NeighborConfig(method="other").check()
    cfg = build_config(clean_config({"reduce.scale": 0, "neighbors.k": 4, "min_stub_points": 3, "unknown": 1, "reduce.other": 2}))
    assert (cfg.reduce.scale, cfg.neighbors.k, cfg.min_stub_points) == (None, 4, 3)
    assert sum(len(g["params"]) for g in config_schema()) == 12 and len(dataset_schema()) == 11
    assert frame_numbers(10, 12) == list(range(11)) and frame_numbers(10, 3) == [0, 5, 10]


def test_unknown_dataset(spark):
    with pytest.raises(KeyError):
        generate(spark, "other")


def test_consolidation_of_nothing(spark):
    nodes = from_array(spark, [[0, 0, 0], [5, 0, 0]])
    assert cleanup.median_edge(nodes, spark.createDataFrame([], "cloud string, src long, dst long, w double")).first().median_edge == 0.0


def test_medians_and_numbers_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=2001), "b": np.round(rng.normal(size=500), 1), "c": [4.0], "d": [1.0, 2.0, 4.0, 10.0], "e": [7.0] * 600}
    rows = settle(spark.createDataFrame([(c, float(v), i * i) for c, own in values.items() for i, v in enumerate(own)], "cloud string, w double, id long"))
    got = {r.cloud: r.m for r in order.exact_median(rows, "w", "m").collect()}
    assert got == {c: pytest.approx(float(np.median(own))) for c, own in values.items()}
    numbers = {(r.cloud, r.id): r.n for r in order.numbered(rows, "id", ["id"], "n").collect()}
    assert numbers == {(c, i * i): i for c, own in values.items() for i in range(len(own))}


def test_contraction_that_does_not_settle_is_an_error(monkeypatch):
    monkeypatch.setattr("curvewright.functions.kernels.DENSE_POINTS", 0)
    monkeypatch.setattr("curvewright.functions.kernels.CG_STEPS", 1)
    with pytest.raises(ArithmeticError):
        contract(np.random.default_rng(0).normal(size=(60, 3)), np.arange(59), np.arange(1, 60), np.ones(60), 0.5, 1.6, 5)


def test_every_pair_within_the_radius_is_met_once(spark):
    """On a lattice whose step is the radius all pairs stand at it, in every direction of neighbouring cells; two points coincide."""
    at = np.array([(x, y, z) for x in range(-1, 2) for y in range(-1, 2) for z in range(-1, 2)] + [(0, 0, 0)], dtype=float)
    points = from_array(spark, at[np.random.default_rng(5).permutation(len(at))])
    place = np.array([(r.x, r.y, r.z) for r in sorted(points.collect(), key=lambda r: r.id)])
    w = np.sqrt(((place[:, None] - place[None]) ** 2).sum(-1))
    for radius in (1.0, 3**0.5, 0.0):
        got = sorted((r.src, r.dst) for r in neighbors.pairs_within(points, radius).collect())
        assert got == [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(w <= radius, 1)), strict=True)], radius
        offsets = neighbors.offsets_within(points, F.lit(radius)).groupBy("id").agg(*[F.sum(f"o{c}").alias(c) for c in "xyz"]).collect()
        near = (w <= radius) & ~np.eye(len(w), dtype=bool)
        want = {i: (place[near[i]] - place[i]).sum(0) for i in np.nonzero(near.any(1))[0]}
        assert {r.id for r in offsets} == set(want) and all(np.allclose((r.x, r.y, r.z), want[r.id]) for r in offsets)
