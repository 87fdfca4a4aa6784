"""Queries over whole tables: every block of keys and every user, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvewright.config import ReduceConfig
from curvewright.functions.kernels import contract
from curvewright.plans import queries

CUSTOMERS, ORDERS, USERS = 95, 384 * 3 + 100, 60


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.range(CUSTOMERS).select(F.col("id").alias("c_custkey")).write.parquet(f"{d}/customer.parquet")
    spark.range(ORDERS).select(F.col("id").alias("o_orderkey")).write.parquet(f"{d}/orders.parquet")
    rows = [(u * 100 + i, u, i, float(i % 7)) for u in range(USERS) for i in range(1 + u % 3)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, value double").write.parquet(f"{d}/events.parquet")
    return d


def run(spark, d, name):
    return queries.QUERIES[name](spark, d).collect()


def places(points):
    rows = sorted(points.collect(), key=lambda r: r.id)
    return np.array([r.id for r in rows]), np.array([r.cloud for r in rows]), np.array([(r.x, r.y, r.z) for r in rows])


def graph(at, factor=2.5):
    """Pitch and radius edges of one cloud."""
    w = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    pitch = np.median((w + np.diag(np.full(len(at), np.inf))).min(1))
    left, right = np.nonzero(np.triu(w <= factor * pitch, 1))
    return pitch, left, right


def test_contraction_and_local_shape_take_every_order(spark, tables):
    ids, cloud, at = places(queries.cloud_d5(spark, tables))
    assert list(ids) == list(range(ORDERS)) and len(set(cloud)) == 4
    for name in ("anchor_weights", "local_dim", "contract"):
        assert sorted(r.id for r in run(spark, tables, name)) == list(ids), name
    anchor = {r.id: r.anchor for r in run(spark, tables, "anchor_weights")}
    got = {r.id: (r.x, r.y, r.z) for r in run(spark, tables, "contract")}
    cfg = ReduceConfig()
    for c in set(cloud):
        own = ids[cloud == c]
        _, left, right = graph(at[own])
        last = contract(at[own], left, right, np.array([anchor[i] for i in own]), cfg.wh / (2 * len(left) / len(own)), cfg.sl, cfg.contraction_iterations)[-1]
        assert np.allclose(last, [got[i] for i in own], atol=1e-4)
    surface = {r.cloud: (r.nodes, r.edges) for r in run(spark, tables, "extract_surface")}
    assert {c: n for c, (n, _) in surface.items()} == {"0": 384, "1": 384, "2": 384, "3": 100}
    loops = {r.cloud: (r.branch_points, r.closed_loops) for r in run(spark, tables, "extract_collapse")}
    assert [loops[c] for c in "012"] == [(0, 1)] * 3 and set(loops) == set("0123")


def test_every_customer_stands_in_a_shape(spark, tables):
    found = {r.cloud: (r.branch_points, r.segments, r.isolated) for r in run(spark, tables, "extract_none_d2")}
    assert found == {str(k): (1, 3, 0) for k in range(5)}
    assert sorted(r.n_points for r in run(spark, tables, "segments_loop")) == [41, 41]
    assert {r.id: r.d_perp for r in run(spark, tables, "associate")} == dict.fromkeys(range(CUSTOMERS), 0.0)
    _, cloud, at = places(queries.cloud_d3(spark, tables))
    for r in run(spark, tables, "pitch_d3"):
        assert r.pitch == pytest.approx(graph(at[cloud == r.cloud])[0], abs=1e-5)
    assert queries.flagship(spark, tables).count() == 5


def test_every_user_is_a_chain(spark, tables):
    got = {r.cloud: (r.branch_points, r.segments, r.isolated) for r in run(spark, tables, "extract_none")}
    assert got == {str(u): (0, 1, int(u % 3 == 0)) for u in range(USERS)}
