"""Exact order statistics and running numbers of clouds, dealt over many tasks however large one cloud is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import shuffled, with_cloud
from ..functions.lineage import settle

#: The middle of a cloud's values that is looked at one by one, as a share on either side of the median, and the
#: accuracy of the sketch that bounds it: its ranks are off by a share of 1 / ACCURACY at most.
MIDDLE, ACCURACY = 0.001, 5000
#: Ranges of values in which a cloud's rows are numbered side by side, and rows up to which a cloud is one range.
BUCKETS, RANGE_ROWS = 32, 10_000


def exact_median(rows: DataFrame, value: str, out: str) -> DataFrame:
    """(cloud, out): the median of a column, the mean of the two middle values for even counts.

    A mergeable sketch bounds the median's rank from both sides. Values below are counted, the few different ones
    between the bounds are counted each, and a running sum over those finds the middle.
    """
    sketch = F.percentile_approx(value, F.array(F.lit(0.5 - MIDDLE), F.lit(0.5 + MIDDLE)), ACCURACY)
    bounds = rows.groupBy("cloud").agg(sketch.alias("_b"), F.count(value).alias("_n"))
    near = with_cloud(rows.select("cloud", F.col(value).alias("_v")), settle(bounds)).where(F.col("_v") <= F.get("_b", F.lit(1)))
    kept = F.when(F.col("_v") >= F.get("_b", F.lit(0)), F.col("_v"))  # null: all values below
    counts = near.groupBy("cloud", "_n", kept.alias("_v")).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy("cloud").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_c").over(upto))
    middle = [F.min(F.when(F.col("_upto") > F.floor((F.col("_n") - k) / 2), F.col("_v"))) for k in (1, 0)]
    return counts.groupBy("cloud").agg(((middle[0] + middle[1]) / 2).alias(out))


def numbered(rows: DataFrame, by: str, order: list, out: str) -> DataFrame:
    """rows with ``out``: 0-based numbers within the cloud in ``order``, whose first key is the number ``by``.

    Rows are dealt to ranges of ``by`` between approximate quantiles, numbered within them, and moved on by the
    counts of the ranges before. A small cloud is one range and needs no quantiles.
    """
    steps = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    quantiles = F.percentile_approx(by, steps, 10 * BUCKETS)
    quantiles = F.when(F.count("*") > RANGE_ROWS, quantiles).otherwise(F.array().cast(f"array<{rows.schema[by].dataType.simpleString()}>"))
    bounds = rows.groupBy("cloud").agg(quantiles.alias("_q"))
    dealt = with_cloud(rows, settle(bounds)).withColumn("_b", F.size(F.filter("_q", lambda q: q <= F.col(by)))).drop("_q")
    within = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("cloud", "_b").orderBy(*order)) - 1)
    counts = dealt.groupBy("cloud", "_b").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy("cloud").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select("cloud", "_b", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"))
    return within.join(shuffled(before), ["cloud", "_b"]).withColumn(out, F.col("_r") + F.col("_before")).drop("_b", "_r", "_before")
