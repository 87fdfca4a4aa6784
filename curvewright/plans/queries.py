"""Registered queries over clouds derived from the driver tables, and the SQL that says what they must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config, ReduceConfig, build_config
from ..functions.geometry import AXES
from ..functions.joins import shuffled, with_cloud
from ..functions.lineage import settle, settle_points
from ..operators import cleanup, neighbors, reduce, topology
from ..operators.components import connected_components
from ..sources import clouds
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]

# ---- clouds --------------------------------------------------------------------------------------------------------


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cloud_d1(spark: SparkSession, d: str) -> DataFrame:
    """A noisy cloud: the first three components of each embedding."""
    e = _read(spark, d, "embeddings")
    return clouds.as_cloud(e.select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate(AXES)]), "vec_id")


def _ring(expr: str, divisor: str) -> str:
    return f"{expr}(2 * pi() * {divisor})"


_D2 = "round((CASE WHEN {k} = 0 THEN 0 ELSE floor(({k} - 1) / 3) + 1 END) * {f}(2 * pi() * (({k} + 2) % 3) / 3), 6) + 0.0"


# Shapes over whole tables: one Y, loop or torus for each block of keys, and a chain for each user.


def cloud_d2(spark: SparkSession, d: str) -> DataFrame:
    """A Y junction for every 19 customers."""
    k = "(c_custkey % 19)"
    c = _read(spark, d, "customer").selectExpr("c_custkey div 19 block", "c_custkey id", *[f"{_D2.format(k=k, f=f)} {n}" for f, n in (("cos", "x"), ("sin", "y"))], "cast(0 as double) z")
    return clouds.as_cloud(c, cloud="block")


def cloud_d3(spark: SparkSession, d: str) -> DataFrame:
    """A tilted loop for every 40 customers; an arc for what is left."""
    a = "(2 * pi() * (c_custkey % 40) / 40)"
    c = _read(spark, d, "customer").selectExpr("c_custkey div 40 block", "c_custkey id", f"round(4 * cos{a}, 6) + 0.0 x", f"round(4 * sin{a}, 6) + 0.0 y", f"round(1.2 * sin{a}, 6) + 0.0 z")
    return clouds.as_cloud(c, cloud="block")


def cloud_d4(spark: SparkSession, d: str) -> DataFrame:
    """One open chain for each user, each a cloud."""
    x = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    z = F.round(F.col("value") * 0.001, 6) + 0.0
    return clouds.as_cloud(_read(spark, d, "events").select("user_id", "event_id", x.alias("x"), F.lit(0.0).alias("y"), z.alias("z")), "event_id", cloud="user_id")


def cloud_d5(spark: SparkSession, d: str) -> DataFrame:
    """A torus for every 384 orders; a part of one for what is left."""
    u, v = "(2 * pi() * floor(o_orderkey % 384 / 12) / 32)", "(2 * pi() * (o_orderkey % 12) / 12)"
    o = _read(spark, d, "orders").selectExpr("o_orderkey div 384 block", "o_orderkey id", f"round((5 + cos{v}) * cos{u}, 6) + 0.0 x", f"round((5 + cos{v}) * sin{u}, 6) + 0.0 y", f"round(sin{v}, 6) + 0.0 z")
    return clouds.as_cloud(o, cloud="block")


_ANGLE = "2 * pi() * (c_custkey % 40) / 40"
_U, _V = "2 * pi() * (o_orderkey % 384 // 12) / 32", "2 * pi() * (o_orderkey % 12) / 12"
_CLOUD_SQL = {
    "d1": "SELECT '0' AS cloud, vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings",
    "d2": f"""SELECT (c_custkey // 19)::VARCHAR AS cloud, c_custkey AS id, {_D2.format(k='(c_custkey % 19)', f='cos')} AS x,
  {_D2.format(k='(c_custkey % 19)', f='sin')} AS y, 0.0::DOUBLE AS z FROM customer""",
    "d3": f"""SELECT (c_custkey // 40)::VARCHAR AS cloud, c_custkey AS id, round(4 * cos({_ANGLE}), 6) + 0.0 AS x,
  round(4 * sin({_ANGLE}), 6) + 0.0 AS y, round(1.2 * sin({_ANGLE}), 6) + 0.0 AS z FROM customer""",
    "d4": """SELECT user_id::VARCHAR AS cloud, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS x,
  0.0::DOUBLE AS y, round(value * 0.001::DOUBLE, 6) + 0.0 AS z FROM events""",
    "d5": f"""SELECT (o_orderkey // 384)::VARCHAR AS cloud, o_orderkey AS id, round((5 + cos({_V})) * cos({_U}), 6) + 0.0 AS x,
  round((5 + cos({_V})) * sin({_U}), 6) + 0.0 AS y, round(sin({_V}), 6) + 0.0 AS z FROM orders""",
}
_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def _sql(cloud: str, body: str, factor: float = 1.6, extra: str = "") -> str:
    """CTEs p (points), near, pitch, e (radius edges), s (both ways), k (pruned edges), ks, deg, then the body.

    Ids differ between the clouds of a table, so only what is made for a cloud as a whole joins on it.
    """
    return f"""WITH RECURSIVE p AS ({_CLOUD_SQL[cloud]}),
pairs AS (SELECT a.cloud, a.id AS src, b.id AS dst, {_DIST} AS w FROM p a JOIN p b ON a.cloud = b.cloud AND a.id <> b.id),
near AS (SELECT cloud, src, min(w) AS m FROM pairs GROUP BY ALL),
pitch AS (SELECT c.cloud, coalesce(median(m), 1.0) AS pitch FROM (SELECT DISTINCT cloud FROM p) c LEFT JOIN near ON near.cloud = c.cloud GROUP BY c.cloud),
e AS (SELECT pairs.cloud, src, dst, w FROM pairs JOIN pitch ON pitch.cloud = pairs.cloud WHERE src < dst AND w <= {factor!r}::DOUBLE * pitch),
s AS (SELECT cloud, src, dst, w FROM e UNION ALL SELECT cloud, dst, src, w FROM e),
k AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM s a JOIN s b ON a.dst = b.dst
  WHERE a.src = e.src AND b.src = e.dst AND a.w < e.w - 1e-9::DOUBLE AND b.w < e.w - 1e-9::DOUBLE)),
ks AS (SELECT cloud, src, dst, w FROM k UNION ALL SELECT cloud, dst, src, w FROM k),
deg AS (SELECT p.cloud, p.id, count(ks.src)::INTEGER AS degree FROM p LEFT JOIN ks ON ks.src = p.id GROUP BY ALL){extra}
{body}"""


_R6 = "round({0}, 6) + 0.0 AS {1}"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _r6(*names: str) -> list:
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]


def _edges(spark: SparkSession, d: str, cloud: Query = cloud_d1) -> tuple[DataFrame, DataFrame]:
    points = settle_points(cloud(spark, d))
    return points, settle(neighbors.prune_shortcuts(settle(neighbors.radius_edges(points))))


# ---- neighbourhoods ------------------------------------------------------------------------------------------------

for _name, _cloud in (("d1", cloud_d1), ("d2", cloud_d2), ("d3", cloud_d3), ("d4", cloud_d4), ("d5", cloud_d5)):
    _query("pitch" if _name == "d1" else f"pitch_{_name}", _sql(_name, "SELECT cloud, round(pitch, 6) + 0.0 AS pitch FROM pitch"))(
        lambda s, d, c=_cloud: neighbors.pitch(settle_points(c(s, d))).select("cloud", *_r6("pitch"))
    )


@_query("radius_edges", _sql("d1", f"SELECT src, dst, {_R6.format('w', 'w')} FROM e"))
def _radius(s, d):
    return neighbors.radius_edges(cloud_d1(s, d)).select("src", "dst", *_r6("w"))


_KNN = "knn AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(w) AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w, dst) AS rn FROM pairs) WHERE rn <= 10 GROUP BY ALL)"


@_query("knn_edges", _sql("d1", f"SELECT src, dst, {_R6.format('w', 'w')} FROM knn", extra=f", {_KNN.replace('min(w) AS w', 'w')}"))
def _knn(s, d):
    return neighbors.knn_edges(cloud_d1(s, d)).select("src", "dst", *_r6("w"))


@_query("mst_edges")
def _mst(s, d):
    return neighbors.mst_edges(cloud_d1(s, d)).select("src", "dst", *_r6("w"))


_LOOP_WEIGHT = """, sizes AS (SELECT cloud, count(*) AS n FROM p GROUP BY cloud)
SELECT k.cloud, n - 1 AS n_edges, round(sum(w) - CASE WHEN count(*) = n THEN max(w) ELSE 0 END, 6) + 0.0 AS weight FROM k JOIN sizes ON sizes.cloud = k.cloud GROUP BY k.cloud, n"""


@_query("mst_weight", _sql("d3", "", extra=_LOOP_WEIGHT))
def _mst_weight(s, d):
    """The spanning tree of a loop is the loop without its longest edge, of an arc the arc; the SQL says it by their edges."""
    found = neighbors.mst_edges(settle_points(cloud_d3(s, d))).groupBy("cloud").agg(F.count("*").alias("n_edges"), F.sum("w").alias("weight"))
    return found.select("cloud", "n_edges", *_r6("weight"))


@_query("rng_prune", _sql("d1", f"SELECT src, dst, {_R6.format('w', 'w')} FROM k"))
def _prune(s, d):
    return _edges(s, d)[1].select("src", "dst", *_r6("w"))


@_query("rng_prune_d5", _sql("d5", f"SELECT src, dst, {_R6.format('w', 'w')} FROM k", 2.5))
def _prune5(s, d):
    return neighbors.prune_shortcuts(settle(neighbors.radius_edges(settle_points(cloud_d5(s, d)), 2.5))).select("src", "dst", *_r6("w"))


@_query("trace_pruned", _sql("d1", "SELECT src, dst FROM e EXCEPT SELECT src, dst FROM k"))
def _pruned(s, d):
    edges = settle(neighbors.radius_edges(cloud_d1(s, d)))
    return edges.join(shuffled(neighbors.prune_shortcuts(edges)), ["cloud", "src", "dst"], "left_anti").select("src", "dst")


@_query("ball_counts", _sql("d1", "SELECT p.id, 1 + count(s.src) AS n FROM p LEFT JOIN s ON s.src = p.id GROUP BY p.id", 2.5))
def _ball(s, d):
    return neighbors.ball_counts(cloud_d1(s, d)).select("id", "n")


# ---- topology ------------------------------------------------------------------------------------------------------


@_query("degree", _sql("d1", "SELECT id, degree FROM deg"))
def _degree(s, d):
    return topology.degrees(*_edges(s, d)).select("id", "degree")


@_query("branch_points", _sql("d1", f"SELECT row_number() OVER (PARTITION BY cloud ORDER BY id) - 1 AS branch_id, id AS node_id, {', '.join(_R6.format(c, c) for c in AXES)} FROM deg JOIN p USING (cloud, id) WHERE degree >= 3"))
def _branch(s, d):
    p, e = _edges(s, d)
    return topology.branch_points(p, topology.degrees(p, e)).select(F.col("branch_id").cast("long").alias("branch_id"), "node_id", *_r6(*AXES))


@_query("tips", _sql("d1", "SELECT id FROM deg WHERE degree = 1"))
def _tips(s, d):
    return topology.tips(topology.degrees(*_edges(s, d))).select("id")


@_query("isolated", _sql("d1", "SELECT id FROM deg WHERE degree = 0"))
def _isolated(s, d):
    return topology.isolated(topology.degrees(*_edges(s, d))).select("id")


@_query("node_kinds", _sql("d1", "SELECT id, degree, CASE WHEN degree >= 3 THEN 'branch' WHEN degree = 2 THEN 'interior' WHEN degree = 1 THEN 'tip' ELSE 'isolated' END AS kind FROM deg"))
def _kinds(s, d):
    return topology.node_kinds(topology.degrees(*_edges(s, d))).select("id", "degree", "kind")


_REACH = ", reach AS (SELECT id AS node, id AS root FROM p UNION SELECT ks.dst, reach.root FROM reach JOIN ks ON ks.src = reach.node), comp AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"


@_query("components", _sql("d1", "SELECT comp.node, comp.root FROM comp JOIN deg ON deg.id = comp.node WHERE degree > 0", extra=_REACH))
def _components(s, d):
    return connected_components(_edges(s, d)[1], settle, ("cloud",)).select("node", "root")


#: Chains by a recursive walk from every special node, loops from the least node of their component.
_WALK = (
    _REACH
    + """, ring AS (SELECT root FROM comp JOIN deg ON deg.id = comp.node GROUP BY root HAVING min(degree) = 2 AND max(degree) = 2),
stop AS (SELECT id FROM deg WHERE degree <> 2 UNION SELECT root FROM ring),
walk AS (SELECT ks.src AS a, [ks.src, ks.dst] AS path, ks.src AS prev, ks.dst AS cur FROM ks JOIN stop ON stop.id = ks.src
  UNION ALL SELECT w.a, list_append(w.path, ks.dst), w.cur, ks.dst FROM walk w JOIN ks ON ks.src = w.cur AND ks.dst <> w.prev WHERE w.cur NOT IN (SELECT id FROM stop)),
chain AS (SELECT path AS points, a, cur AS b, a IN (SELECT root FROM ring) AS ring FROM walk WHERE cur IN (SELECT id FROM stop) AND (a < cur OR (a = cur AND path[2] <= path[-2]))),
seg AS (SELECT points, CASE WHEN ring THEN 1 ELSE 0 END AS class, CASE WHEN NOT ring THEN a END AS ea, CASE WHEN NOT ring THEN b END AS eb, a = b AS closed FROM chain
  UNION ALL SELECT [id], 2, NULL, NULL, false FROM deg WHERE degree = 0),
br AS (SELECT cloud, id, row_number() OVER (PARTITION BY cloud ORDER BY id) - 1 AS b FROM deg WHERE degree >= 3),
segs AS (SELECT p.cloud, (row_number() OVER (PARTITION BY p.cloud ORDER BY class, points[1], points[2]) - 1)::INTEGER AS seg_id, points, ea AS end_node_a, eb AS end_node_b, x.b::INTEGER AS end_a, y.b::INTEGER AS end_b, closed,
  (CASE WHEN x.b IS NULL AND y.b IS NULL THEN 0 WHEN x.b IS NULL OR y.b IS NULL OR x.b = y.b THEN 1 ELSE 2 END)::INTEGER AS n_branch_ends, len(points)::INTEGER AS n_points, class
  FROM seg JOIN p ON p.id = points[1] LEFT JOIN br x ON x.id = ea LEFT JOIN br y ON y.id = eb)"""
)
_SEG_COLUMNS = "cloud, seg_id, array_to_string(points, ',') AS points, end_node_a, end_node_b, end_a, end_b, closed, n_branch_ends, n_points"


def _seg_rows(segs: DataFrame) -> DataFrame:
    return segs.select("cloud", "seg_id", F.array_join(F.col("points").cast("array<string>"), ",").alias("points"), "end_node_a", "end_node_b", "end_a", "end_b", "closed", "n_branch_ends", "n_points")


@_query("segments_chain", _sql("d1", f"SELECT {_SEG_COLUMNS} FROM segs WHERE class = 0", extra=_WALK))
def _chains(s, d):
    segs = topology.segments(*_edges(s, d))
    return _seg_rows(segs.where("end_node_a is not null"))


@_query("segments_loop", _sql("d3", f"SELECT {_SEG_COLUMNS} FROM segs WHERE class = 1", extra=_WALK))
def _loops(s, d):
    return _seg_rows(topology.segments(*_edges(s, d, cloud_d3)).where("closed and end_node_a is null"))


@_query("segments_all", _sql("d1", f"SELECT {_SEG_COLUMNS} FROM segs", extra=_WALK))
def _all_segments(s, d):
    return _seg_rows(topology.segments(*_edges(s, d)))


_SUMMARY = """SELECT cloud, (SELECT count(*) FROM br WHERE br.cloud = segs.cloud) AS branch_points, count(*) AS segments,
  count(*) FILTER (n_branch_ends = 0) AS branch_ends_0, count(*) FILTER (n_branch_ends = 1) AS branch_ends_1, count(*) FILTER (n_branch_ends = 2) AS branch_ends_2,
  count(*) FILTER (closed AND n_branch_ends = 0) AS closed_loops, (SELECT count(*) FROM deg WHERE degree = 0 AND deg.cloud = segs.cloud) AS isolated
FROM segs GROUP BY cloud"""


@_query("summary", _sql("d1", _SUMMARY, extra=_WALK))
def _summary(s, d):
    p, e = _edges(s, d)
    deg = settle(topology.degrees(p, e))
    return topology.summary(p, deg, topology.segments(p, e, deg))


@_query("edge_partition", "SELECT 0 AS src, 0 AS dst WHERE false")
def _partition(s, d):
    p, e = _edges(s, d)
    return topology.edge_partition_faults(e, topology.segments(p, e)).select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))


@_query("stub_prune", _sql("d1", f"SELECT {_SEG_COLUMNS} FROM segs WHERE NOT (n_branch_ends = 1 AND NOT closed AND (end_a IS NULL OR end_b IS NULL) AND n_points < 3)", extra=_WALK))
def _stubs(s, d):
    return _seg_rows(cleanup.prune_stubs(topology.segments(*_edges(s, d)), 3))


# ---- cleanup -------------------------------------------------------------------------------------------------------


@_query("median_edge", _sql("d1", "SELECT round(coalesce(median(w), 0.0), 6) + 0.0 AS median_edge FROM k"))
def _median(s, d):
    return cleanup.median_edge(*_edges(s, d)).select(*_r6("median_edge"))


_MERGE = ", gap AS (SELECT cloud, 2.0 * median(w) AS g FROM k GROUP BY cloud), m AS (SELECT k.src, k.dst FROM k JOIN deg a ON a.id = k.src JOIN deg b ON b.id = k.dst JOIN gap ON gap.cloud = k.cloud WHERE a.degree >= 3 AND b.degree >= 3 AND k.w < g)"
_CLUSTER = ", ms AS (SELECT src, dst FROM m UNION ALL SELECT dst, src FROM m), r AS (SELECT id AS node, id AS root FROM p UNION SELECT ms.dst, r.root FROM r JOIN ms ON ms.src = r.node), mem AS (SELECT node AS id, dense_rank() OVER (PARTITION BY cloud ORDER BY root) - 1 AS node_id FROM (SELECT node, min(root) AS root FROM r GROUP BY node) JOIN p ON p.id = node)"
_NODES = f"SELECT node_id AS id, {', '.join(f'round(avg({c}), 6) + 0.0 AS {c}' for c in AXES)} FROM p JOIN mem USING (id) GROUP BY node_id"
_NEW_EDGES = "SELECT DISTINCT least(a.node_id, b.node_id) AS src, greatest(a.node_id, b.node_id) AS dst FROM {0} JOIN mem a ON a.id = {0}.src JOIN mem b ON b.id = {0}.dst WHERE a.node_id <> b.node_id"


@_query("trace_merged", _sql("d1", "SELECT src, dst FROM m", extra=_MERGE))
def _merged(s, d):
    p, e = _edges(s, d)
    gap = cleanup.median_edge(p, e).select("cloud", (F.col("median_edge") * 2.0).alias("max_gap"))
    return cleanup.junction_edges(p, e, gap).select("src", "dst")


@_query("consolidate", _sql("d1", _NODES, extra=_MERGE + _CLUSTER))
def _consolidate(s, d):
    return cleanup.consolidate(*_edges(s, d))[0].select("id", *_r6(*AXES))


@_query("consolidate_edges", _sql("d1", _NEW_EDGES.format("k"), extra=_MERGE + _CLUSTER))
def _consolidate_edges(s, d):
    return cleanup.consolidate(*_edges(s, d))[1].select("src", "dst")


# ---- reduction -----------------------------------------------------------------------------------------------------


@_query("laplacian_apply", _sql("d1", f"SELECT a.id, {', '.join(f'round(coalesce(sum(a.{c} - b.{c}), 0.0), 6) + 0.0 AS l{c}' for c in AXES)} FROM p a LEFT JOIN s ON s.src = a.id LEFT JOIN p b ON b.id = s.dst GROUP BY a.id", 2.5))
def _laplacian(s, d):
    p = settle_points(cloud_d1(s, d))
    return reduce.laplacian_apply(p, neighbors.radius_edges(p, 2.5)).select("id", *_r6("lx", "ly", "lz"))


_MOMENT_SQL = ", ".join(f"round(sum((b.{m[0]} - a.{m[0]}) * (b.{m[1]} - a.{m[1]})), 6) + 0.0 AS {m}" for m in ("xx", "xy", "xz", "yy", "yz", "zz"))


@_query("anchor_moments", _sql("d1", f"SELECT a.id, count(*) AS n, {_MOMENT_SQL}, {', '.join(f'round(avg(b.{c} - a.{c}), 6) + 0.0 AS m{c}' for c in AXES)}, round(avg(s.w), 6) + 0.0 AS mean_len FROM p a JOIN s ON s.src = a.id JOIN p b ON b.id = s.dst GROUP BY a.id", 2.5))
def _moments(s, d):
    p = settle_points(cloud_d1(s, d))
    return reduce.anchor_moments(p, neighbors.radius_edges(p, 2.5)).select("id", "n", *_r6("xx", "xy", "xz", "yy", "yz", "zz", "mx", "my", "mz", "mean_len"))


#: Eigenvalues of a symmetric 3x3 matrix (columns xx to zz of m) in closed form; l1 is the largest, l3 the least.
_EIGEN = """, q AS (SELECT *, (xx + yy + zz) / 3 AS q, xy * xy + xz * xz + yz * yz AS o FROM m),
pp AS (SELECT *, sqrt(greatest(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * o) / 6, 0)) AS h FROM q),
det AS (SELECT *, CASE WHEN h > 0 THEN ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * h ** 3) ELSE 1 END AS r FROM pp),
phi AS (SELECT *, acos(greatest(-1, least(1, r))) / 3 AS phi FROM det),
eig AS (SELECT *, q + 2 * h * cos(phi) AS l1, q + 2 * h * cos(phi + 2 * pi() / 3) AS l3 FROM phi)"""
#: The part of the mean offset that is across the eigenvector of the least eigenvalue (the longest cross product of
#: two rows of the matrix less that eigenvalue), over the mean length.
_ANCHOR_SQL = f""", m AS (SELECT a.id, count(*) AS n, {', '.join(f'sum((b.{u} - a.{u}) * (b.{v} - a.{v})) AS {u}{v}' for u, v in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))},
  avg(b.x - a.x) AS mx, avg(b.y - a.y) AS my, avg(b.z - a.z) AS mz, avg(s.w) AS mean_len FROM p a JOIN s ON s.src = a.id JOIN p b ON b.id = s.dst GROUP BY a.id){_EIGEN},
c AS (SELECT *, xx - l3 AS a, yy - l3 AS b, zz - l3 AS c FROM eig),
v AS (SELECT *, [xy * yz - xz * b, xz * xy - a * yz, a * b - xy * xy] AS v1, [xy * c - xz * yz, xz * xz - a * c, a * yz - xy * xz] AS v2, [b * c - yz * yz, yz * xz - xy * c, xy * yz - b * xz] AS v3 FROM c),
w AS (SELECT *, [list_inner_product(v1, v1), list_inner_product(v2, v2), list_inner_product(v3, v3)] AS len FROM v),
u AS (SELECT *, CASE WHEN len[1] >= len[2] AND len[1] >= len[3] THEN v1 WHEN len[2] >= len[3] THEN v2 ELSE v3 END AS normal, greatest(len[1], len[2], len[3]) AS big FROM w),
score AS (SELECT id, n, sqrt(greatest(0, mx * mx + my * my + mz * mz - list_inner_product([mx, my, mz], normal) ** 2 / big)) / (mean_len + 1e-9::DOUBLE) AS score FROM u)
SELECT p.id, round(1 + 8 * CASE WHEN n >= 3 THEN score ELSE 1 END, 3) + 0.0 AS anchor FROM p LEFT JOIN score ON score.id = p.id"""


@_query("anchor_weights", _sql("d5", "", 2.5, _ANCHOR_SQL))
def _anchor(s, d):
    p = settle_points(cloud_d5(s, d))
    found = reduce.anchor_weights(p, neighbors.radius_edges(p, 2.5), 8.0)
    return found.select("id", (F.round("anchor", 3) + 0.0).alias("anchor"))


_SHAPES = f""", ball AS (SELECT src, dst FROM s UNION ALL SELECT id, id FROM p),
t AS (SELECT a.id, a.cloud, count(*) AS n, {', '.join(f'sum(b.{u} - a.{u}) AS s{u}' for u in AXES)}, {', '.join(f'sum((b.{u} - a.{u}) * (b.{v} - a.{v})) AS s{u}{v}' for u, v in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))}
  FROM p a JOIN ball ON ball.src = a.id JOIN p b ON b.id = ball.dst GROUP BY ALL),
m AS (SELECT id, cloud, n, {', '.join(f's{u}{v} - s{u} * s{v} / n AS {u}{v}' for u, v in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM t){_EIGEN},
shape AS (SELECT id, cloud, CASE WHEN n >= 3 AND l1 > 0 THEN (3 * q - l1 - l3) / l1 ELSE 0 END AS r2, CASE WHEN n >= 3 AND l1 > 0 THEN l3 / l1 ELSE 0 END AS r3 FROM eig)"""


@_query("local_dim", _sql("d5", "SELECT id, round(r2, 4) + 0.0 AS r2, round(r3, 4) + 0.0 AS r3 FROM shape", 2.5, _SHAPES))
def _local(s, d):
    return reduce.local_shape(settle_points(cloud_d5(s, d))).select("id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("r2", "r3")])


_VOTE = "SELECT cloud, round(avg((r2 > 0.35 AND r3 < 0.2)::INTEGER), 6) + 0.0 AS sheet_fraction, CASE WHEN avg((r2 > 0.35 AND r3 < 0.2)::INTEGER) > 0.5 THEN 'collapse' ELSE 'surface' END AS chosen FROM shape GROUP BY cloud"


@_query("auto_vote", _sql("d5", _VOTE, 2.5, _SHAPES))
def _vote(s, d):
    return reduce.auto_vote(settle_points(cloud_d5(s, d)), ReduceConfig()).select("cloud", *_r6("sheet_fraction"), "chosen")


_COLLAPSE = ", ml AS (SELECT src AS id, max(w) AS m FROM s GROUP BY src), m AS (SELECT e.src, e.dst FROM e JOIN ml a ON a.id = e.src JOIN ml b ON b.id = e.dst WHERE e.w < 0.5 * least(a.m, b.m))"


@_query("collapse_clusters", _sql("d1", "SELECT id, node_id FROM mem", 2.5, _COLLAPSE + _CLUSTER))
def _clusters(s, d):
    p = settle_points(cloud_d1(s, d))
    return reduce.edge_collapse(p, settle(neighbors.radius_edges(p, 2.5)))[2].select("id", "node_id")


@_query("collapse_edges", _sql("d1", _NEW_EDGES.format("e"), 2.5, _COLLAPSE + _CLUSTER))
def _collapsed_edges(s, d):
    p = settle_points(cloud_d1(s, d))
    return reduce.edge_collapse(p, settle(neighbors.radius_edges(p, 2.5)))[1].select("src", "dst")


@_query("contract")
def _contract(s, d):
    p = settle_points(cloud_d5(s, d))
    return reduce.contract_points(p, settle(neighbors.radius_edges(p, 2.5)), ReduceConfig()).select("id", *_r6(*AXES))


@_query("contract_residual", "SELECT o_orderkey AS id, 0.0::DOUBLE AS residual FROM orders")
def _residual(s, d):
    """Every iterate solves its linear system: the largest part of the right side that is left over, for each point."""
    p = settle_points(cloud_d5(s, d))
    found = reduce.contraction_residual(p, settle(neighbors.radius_edges(p, 2.5).select("cloud", "src", "dst")), ReduceConfig())
    return found.groupBy("id").agg((F.round(F.max("residual"), 6) + 0.0).alias("residual"))


@_query("contraction_frames")
def _frames(s, d):
    p = settle_points(cloud_d5(s, d))
    frames = reduce.contraction_frames(p, settle(neighbors.radius_edges(p, 2.5)), ReduceConfig(), pipeline.frame_numbers(10, 12))
    return frames.select("frame", "id", *_r6(*AXES))


@_query("collapse")
def _collapse(s, d):
    return reduce.collapse(settle_points(cloud_d5(s, d)), ReduceConfig(mode="collapse"))[0].select("cloud", "id", *_r6(*AXES))


# ---- pipeline ------------------------------------------------------------------------------------------------------

for _name, _cloud in (("extract_none_d2", cloud_d2), ("extract_none_d3", cloud_d3), ("extract_none", cloud_d4)):
    _query(_name, _sql({cloud_d2: "d2", cloud_d3: "d3", cloud_d4: "d4"}[_cloud], _SUMMARY, extra=_WALK))(lambda s, d, c=_cloud: pipeline.extract(c(s, d)).summary())

_SURFACE = "SELECT cloud, count(*) AS nodes, sum(n)::BIGINT // 2 AS edges, count(*) FILTER (n >= 3) AS branch_points FROM (SELECT p.cloud, p.id, count(s.src) AS n FROM p LEFT JOIN s ON s.src = p.id GROUP BY ALL) GROUP BY cloud"


@_query("extract_surface", _sql("d5", _SURFACE))
def _surface(s, d):
    found = pipeline.extract(cloud_d5(s, d), build_config({"reduce.mode": "surface"}))
    return found.degree.groupBy("cloud").agg(F.count("*").alias("nodes"), F.floor(F.sum("degree") / 2).cast("long").alias("edges"), F.count_if(F.col("degree") >= 3).alias("branch_points"))


@_query("extract_collapse")
def _extract_collapse(s, d):
    """A whole torus is one closed loop without branch points."""
    return pipeline.extract(cloud_d5(s, d), build_config({"reduce.mode": "collapse"})).summary().select("cloud", "branch_points", "closed_loops")


_STAGES = """, stages AS (SELECT 'input' AS stage, cloud FROM p UNION ALL SELECT 'adjacency_edges', cloud FROM e UNION ALL SELECT 'edges', cloud FROM k
  UNION ALL SELECT 'segments', cloud FROM segs UNION ALL SELECT 'branch_points', cloud FROM br)
SELECT stage, cloud, count(*) AS n FROM stages GROUP BY ALL"""


@_query("trace", _sql("d3", "", extra=_WALK + _STAGES))
def _trace(s, d):
    """Rows of the stages of the whole trace, for each loop."""
    stages = pipeline.trace(cloud_d3(s, d))
    rows = [stages[n].select(F.lit(n).alias("stage"), "cloud") for n in ("input", "adjacency_edges", "edges", "segments", "branch_points", "pruned_edges", "merged_edges")]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    return whole.groupBy("stage", "cloud").agg(F.count("*").alias("n"))


@_query("trace_json", _sql("d2", "SELECT 'input' AS stage, cloud, id, round_even(x, 4) + 0.0 AS x, round_even(y, 4) + 0.0 AS y, round_even(z, 4) + 0.0 AS z, NULL::VARCHAR AS kind FROM p UNION ALL SELECT 'node_kinds', cloud, id, NULL, NULL, NULL, CASE WHEN degree >= 3 THEN 'branch' WHEN degree = 2 THEN 'interior' WHEN degree = 1 THEN 'tip' ELSE 'isolated' END FROM deg"))
def _json(s, d):
    """Two stages of the trace, written as JSON and read back."""
    stages = pipeline.trace(cloud_d2(s, d))
    rows = pipeline.trace_json({n: stages[n] for n in ("input", "node_kinds")})
    read = F.from_json("json", "id long, point array<double>, kind string")
    back = rows.select("stage", "cloud", read.alias("r"))
    return back.select("stage", "cloud", "r.id", *[(F.get("r.point", F.lit(i)) + 0.0).alias(c) for i, c in enumerate(AXES)], "r.kind")


_HOPS = """, hop AS (SELECT cloud, seg_id, i - 1 AS idx, points[i] AS a, points[i + 1] AS b FROM (SELECT cloud, seg_id, points, unnest(range(1, len(points))) AS i FROM segs WHERE len(points) > 1)),
geo AS (SELECT hop.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2) AS len FROM hop JOIN p a ON a.id = hop.a JOIN p b ON b.id = hop.b),
cum AS (SELECT *, sum(len) OVER (PARTITION BY cloud, seg_id ORDER BY idx) - len AS cum FROM geo),
foot AS (SELECT p.id, cum.*, CASE WHEN len > 0 THEN greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay) + (z - az) * (bz - az)) / (len * len))) ELSE 0.0 END AS t, x, y, z FROM p JOIN cum ON p.cloud = cum.cloud),
far AS (SELECT *, sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2 + (z - az - t * (bz - az)) ** 2) AS d_perp FROM foot),
first AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d_perp, 9), seg_id, idx) AS rank FROM far)
SELECT cloud, id, seg_id, idx::INTEGER AS idx, round(t, 6) + 0.0 AS t, round(d_perp, 6) + 0.0 AS d_perp, round(cum + t * len, 6) + 0.0 AS foot_arclength FROM first WHERE rank = 1"""


@_query("associate", _sql("d2", "", extra=_WALK + _HOPS))
def _associate(s, d):
    p = settle_points(cloud_d2(s, d))
    found = pipeline.associate(p, pipeline.extract(p))
    return found.select("cloud", "id", "seg_id", F.col("idx").cast("int").alias("idx"), *_r6("t", "d_perp", "foot_arclength"))


# ---- generators ----------------------------------------------------------------------------------------------------


def _gen_sql(rows: str, x: str, y: str, z: str, id: str = "i") -> str:
    return f"SELECT {id} AS id, round({x}, 6) + 0.0 AS x, round({y}, 6) + 0.0 AS y, round({z}, 6) + 0.0 AS z FROM {rows}"


def _tube_sql(arms: list[tuple[tuple, tuple, tuple]], radius: float, length: float, n_axial: int, n_circ: int, start: float) -> str:
    """arms: (d, u, v) frames written out as numbers."""
    values = ", ".join(f"({k}, {', '.join(repr(float(c)) + '::DOUBLE' for vec in arm for c in vec)})" for k, arm in enumerate(arms))
    names = ", ".join(f"{n}{c}" for n in "duv" for c in AXES)
    at = f"({start!r} + i * {(length - start)!r} / {n_axial - 1})"
    a = f"(2 * pi() * j / {n_circ})"
    place = [f"{at} * d{c} + {radius!r} * (cos{a} * u{c} + sin{a} * v{c})" for c in AXES]
    return _gen_sql(f"(VALUES {values}) arm(k, {names}), range({n_axial}) ri(i), range({n_circ}) rj(j)", *place, id=f"k * {n_axial * n_circ} + i * {n_circ} + j")


_S3 = "sqrt(3.0) / 2"
_Y = "CASE WHEN i = 0 THEN 0 ELSE (i - 1) % 6 + 1 END * {f}(2 * pi() * (CASE WHEN i = 0 THEN 0 ELSE (i - 1) // 6 END) / 3)"
_LINE = "SELECT {first} + i AS i, {ax}::DOUBLE + i * ({bx}::DOUBLE - {ax}::DOUBLE) / {m} AS x, {ay}::DOUBLE + i * ({by}::DOUBLE - {ay}::DOUBLE) / {m} AS y FROM range({n}) r(i)"


def _lines_sql(lines: list[tuple[float, float, float, float, int]]) -> str:
    first, out = 0, []
    for ax, ay, bx, by, n in lines:
        out.append(_LINE.format(first=first, ax=repr(ax), ay=repr(ay), bx=repr(bx), by=repr(by), m=n - 1, n=n))
        first += n
    return " UNION ALL ".join(out)


_H = [(-2.0, 0.0, -3.8, 2.4, 7), (-2.0, 0.0, -3.8, -2.4, 7), (2.0, 0.0, 3.8, 2.4, 7), (2.0, 0.0, 3.8, -2.4, 7), (-2.0, 0.0, 2.0, 0.0, 9)]
_GRID = [(0.0, 4.0 * j, 12.0, 4.0 * j, 25) for j in range(3)] + [(4.0 * i, 0.0, 4.0 * i, 8.0, 17) for i in range(4)]
_GENERATED = {
    "open_chain": _gen_sql("range(25) r(i)", "i * 0.5::DOUBLE", "2 * sin(i * 0.5 / 12 * pi())", "0.0::DOUBLE"),
    "loop": _gen_sql("range(40) r(i)", "4 * cos(2 * pi() * i / 40)", "4 * sin(2 * pi() * i / 40)", "1.2 * sin(2 * pi() * i / 40)"),
    "y_junction": _gen_sql("range(19) r(i)", f"({_Y.format(f='cos')})", f"({_Y.format(f='sin')})", "0.0::DOUBLE"),
    "h_network": _gen_sql(f"({_lines_sql(_H)})", "x", "y", "0.0::DOUBLE"),
    "lollipop": _gen_sql("range(34) r(i)", "CASE WHEN i < 9 THEN -4 + i * 0.5 ELSE 2 - 2 * cos(2 * pi() * (i - 9) / 25) END", "CASE WHEN i < 9 THEN 0.0 ELSE 2 * sin(2 * pi() * (i - 9) / 25) END", "0.0::DOUBLE"),
    "grid": _gen_sql(f"(SELECT row_number() OVER (ORDER BY x, y) - 1 AS i, x, y FROM (SELECT DISTINCT round(x, 6) AS x, round(y, 6) AS y FROM ({_lines_sql(_GRID)})))", "x", "y", "0.0::DOUBLE"),
    "cylinder": _tube_sql([((0, 0, 1), (0, 1, 0), (-1, 0, 0))], 1.0, 10.0, 20, 16, 0.0),
    "cross_tube": _tube_sql([((1, 0, 0), (0, 0, 1), (0, -1, 0)), ((-1, 0, 0), (0, 0, -1), (0, -1, 0)), ((0, 1, 0), (0, 0, -1), (-1, 0, 0)), ((0, -1, 0), (0, 0, 1), (-1, 0, 0))], 0.6, 6.0, 14, 12, 0.3),
    "y_tube": _tube_sql([((1, 0, 0), (0, 0, 1), (0, -1, 0)), ((-0.5, 0.75**0.5, 0), (0, 0, -1), (-(0.75**0.5), -0.5, 0)), ((-0.5, -(0.75**0.5), 0), (0, 0, 1), (-(0.75**0.5), 0.5, 0))], 0.6, 6.0, 14, 12, 0.3),
    "torus": _gen_sql("range(384) r(i)", "(5 + cos(2 * pi() * (i % 12) / 12)) * cos(2 * pi() * (i // 12) / 32)", "(5 + cos(2 * pi() * (i % 12) / 12)) * sin(2 * pi() * (i // 12) / 32)", "sin(2 * pi() * (i % 12) / 12)"),
    "tree": None,
}
for _name, _text in _GENERATED.items():
    _query(f"gen_{_name}", _text)(lambda s, d, k=_name: clouds.generate(s, k)[0].select("id", *_r6(*AXES)))


@_query("jitter")
def _noisy(s, d):
    return clouds.generate(s, "loop", {"noise": 0.1, "seed": 3})[0].select("id", *_r6(*AXES))


_DENSE = """WITH v AS (SELECT n_regionkey AS line, n_nationkey AS pos, (n_nationkey % 5)::DOUBLE AS x, (n_nationkey % 3)::DOUBLE AS y, 0.0::DOUBLE AS z FROM nation),
s AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, row_number() OVER w AS n FROM v WINDOW w AS (PARTITION BY line ORDER BY pos)),
q AS (SELECT *, greatest(1, floor(sqrt((nx - x) ** 2 + (ny - y) ** 2) * 6.0))::INTEGER AS k FROM s WHERE nx IS NOT NULL),
u AS (SELECT line, 0 AS a, 0 AS j, x, y, z FROM s WHERE n = 1 UNION ALL SELECT line, n, j, x + (nx - x) * (j / k), y + (ny - y) * (j / k), z FROM q, (SELECT unnest(range(1, 40)) AS j) WHERE j <= k)
SELECT line, row_number() OVER (PARTITION BY line ORDER BY a, j) - 1 AS pos, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM u"""


@_query("densify", _DENSE)
def _densify(s, d):
    n = _read(s, d, "nation").selectExpr("n_regionkey line", "n_nationkey pos", "cast(n_nationkey % 5 as double) x", "cast(n_nationkey % 3 as double) y", "cast(0 as double) z")
    return clouds.densify(n).select("line", F.col("pos").cast("long").alias("pos"), *_r6(*AXES))


#: A tree of region, nation and supplier keys without coordinates.
_TREE_SQL = "WITH e AS (SELECT 0::BIGINT AS src, 1 + r_regionkey AS dst FROM region UNION ALL SELECT 1 + n_regionkey, 100 + n_nationkey FROM nation UNION ALL SELECT 100 + s_nationkey, 1000 + s_suppkey FROM supplier), deg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT count(*) FILTER (d >= 3) AS branch_points, count(*) FILTER (d = 1) AS tips FROM deg"


@_query("extract_topology", _TREE_SQL)
def _tree(s, d):
    region, nation, supplier = (_read(s, d, t) for t in ("region", "nation", "supplier"))
    edges = region.selectExpr("0L src", "1L + r_regionkey dst").unionByName(nation.selectExpr("1L + n_regionkey src", "100L + n_nationkey dst")).unionByName(supplier.selectExpr("100L + s_nationkey src", "1000L + s_suppkey dst")).withColumn("cloud", F.lit("0"))
    nodes = edges.select("cloud", F.explode(F.array("src", "dst")).alias("id")).distinct()
    found = pipeline.extract_topology(edges, nodes)
    return found.degree.agg(F.count_if(F.col("degree") >= 3).alias("branch_points"), F.count_if(F.col("degree") == 1).alias("tips"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Where the junctions are: branch points of all customers' Y clouds after the whole extraction."""
    return pipeline.extract(cloud_d2(spark, d), Config()).branch_points
