"""No table with a row for each point or edge is broadcast, however small its compressed file is."""

import re

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from curvewright.functions import joins, lineage
from curvewright.functions.lineage import settle, settle_points
from curvewright.operators import components, order, reduce
from curvewright.operators.neighbors import radius_edges
from curvewright.plans import queries

QUERIES = ["anchor_weights", "auto_vote", "local_dim", "rng_prune_d5"]
QUERIES += ["collapse", "contract", "contract_residual", "contraction_frames", "extract_collapse", "extract_none", "extract_none_d2", "extract_none_d3", "extract_surface"]
QUERIES += ["mst_weight", "trace_json", "associate", "segments_loop", "trace"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.range(80).select(F.col("id").alias("c_custkey")).write.parquet(f"{d}/customer.parquet")
    spark.range(400).select(F.col("id").alias("o_orderkey")).write.parquet(f"{d}/orders.parquet")
    rows = [(u * 100 + i, u, i, float(i % 7)) for u in range(6) for i in range(1 + u % 3)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, value double").write.parquet(f"{d}/events.parquet")
    return d


def broadcast_keys(df):
    """The keys of the joins that are planned as broadcasts before anything runs."""
    return re.findall(r"Broadcast(?:HashJoin \[([^\]]*)\]|NestedLoopJoin)", df._jdf.queryExecution().sparkPlan().toString())


@pytest.mark.parametrize("name", QUERIES)
def test_points_and_edges_are_not_broadcast(spark, tables, monkeypatch, name):
    """Only joins on the cloud alone may be broadcasts: their tables have a row for each cloud, and are counted."""
    monkeypatch.setattr(components, "BROADCAST_EDGES", 0)  # else by counted edges
    planned, write = [], DataFrameWriter.parquet

    def parquet(self, *args, **more):
        planned.extend(broadcast_keys(self._df))
        return write(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    planned.extend(broadcast_keys(queries.QUERIES[name](spark, tables)))
    assert planned and all(re.fullmatch(r"cloud#\d+", k) for k in planned), planned


@pytest.mark.parametrize("most, found", [(3, 1), (2, 0)])
def test_tables_of_clouds_are_counted(spark, monkeypatch, most, found):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", most)
    rows, table = (settle(spark.range(n).select((F.col("id") % 3).alias("cloud"), F.col("id").alias(c))) for n, c in ((9, "id"), (3, "n")))
    met = joins.with_cloud(rows, table)
    assert len(broadcast_keys(met)) == found
    assert sorted((r.id, r.n) for r in met.collect()) == [(i, i % 3) for i in range(9)]


def test_points_of_one_file_are_dealt_over_tasks(spark):
    n = 200_000
    points = spark.range(0, n, 1, 1).select(F.lit("0").alias("cloud"), "id", *[F.rand(i).alias(c) for i, c in enumerate("xyz")])
    dealt = settle_points(points)
    assert len(settle(points).inputFiles()) == 1 < len(dealt.inputFiles())
    assert dealt.agg(F.count("*"), F.countDistinct("id")).first() == (n, n)


@pytest.mark.parametrize("most, found", [(3 * 400, 1), (3 * 300, 0)])
def test_wide_tables_of_few_clouds_are_not_broadcast(spark, monkeypatch, most, found):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", most)
    rows = settle(spark.range(9).select((F.col("id") % 3).alias("cloud"), "id"))
    table = settle(spark.range(3).select(F.col("id").alias("cloud"), F.array(*[F.lit(i) for i in range(40)]).alias("n")))
    met = joins.with_cloud(rows, table)
    assert len(broadcast_keys(met)) == found
    assert sorted((r.id, len(r.n)) for r in met.collect()) == [(i, 40) for i in range(9)]


@pytest.mark.parametrize("most, held", [(10, 0), (2, order.BUCKETS - 1)])
def test_small_clouds_are_numbered_without_quantiles(spark, monkeypatch, most, held):
    sizes = []

    def kept(df):
        sizes.append(df.agg(F.max(F.size("_q"))).first()[0])
        return settle(df)

    monkeypatch.setattr(order, "RANGE_ROWS", most)
    monkeypatch.setattr(order, "settle", kept)
    rows = spark.range(15).select((F.col("id") % 3).cast("string").alias("cloud"), (100 - F.col("id")).alias("v"))
    found = {(r.cloud, r.v): r.n for r in order.numbered(rows, "v", ["v"], "n").collect()}
    assert sizes == [held]
    assert found == {(str(i % 3), 100 - i): 4 - i // 3 for i in range(15)}


def test_residual_meets_an_edge_once_for_all_frames(spark, tables, monkeypatch):
    met, apply = [], reduce.laplacian_apply

    def counted(nodes, edges, *more):
        met.append(edges.count())
        return apply(nodes, edges, *more)

    monkeypatch.setattr(reduce, "laplacian_apply", counted)
    rows = queries.QUERIES["contract_residual"](spark, tables).collect()
    points = settle_points(queries.cloud_d5(spark, tables))
    assert met == [radius_edges(points, 2.5).count()] * 2
    assert len(rows) == 400 and not any(r.residual for r in rows)


def shuffled_bytes(spark):
    """Bytes that shuffles have written so far."""
    context = spark._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_frames_of_the_residual_travel_once(spark, tables):
    """Ten frames of a point take 240 bytes; what its ten or so neighbours hold of them is not sent about."""
    before = shuffled_bytes(spark)
    assert len(queries.QUERIES["contract_residual"](spark, tables).collect()) == 400
    assert shuffled_bytes(spark) - before < 400 * 2000


def test_residual_of_a_wrong_iterate_and_of_clouds_without_a_system(spark, tmp_path, monkeypatch):
    spark.range(386).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    assert [r for r in queries.QUERIES["contract_residual"](spark, str(tmp_path)).collect() if r.residual] == []
    solve = reduce.contract

    def moved(points, *more):
        frames = solve(points, *more)
        frames[7 % len(frames)][3 % len(points), 1] += 0.01
        return frames

    monkeypatch.setattr(reduce, "contract", moved)
    wrong = {r.id for r in queries.QUERIES["contract_residual"](spark, str(tmp_path)).collect() if r.residual}
    assert 3 in wrong and not wrong & {384, 385}


def test_dealt_joins_hold_only_while_a_table_is_written(spark):
    name, keys = lineage.ALL_KEYS, ["cloud", "id"]
    left, right = (spark.range(60).select((F.col("id") % 3).alias("cloud"), "id", (F.col("id") * k).alias(f"v{k}")).repartition("cloud") for k in (2, 3))
    before, started = spark.conf.get(name), shuffled_bytes(spark)
    plain = settle(left.join(right.hint("merge"), keys))
    between = shuffled_bytes(spark)
    dealt = settle(left.join(right.hint("merge"), keys), dealt=True)
    assert shuffled_bytes(spark) - between < between - started
    assert sorted(dealt.collect()) == sorted(plain.collect()) == [(i % 3, i, 2 * i, 3 * i) for c in range(3) for i in range(c, 60, 3)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        settle(left.select((F.col("id") / F.lit(0)).alias("v")), dealt=True)
    assert spark.conf.get(name) == before
