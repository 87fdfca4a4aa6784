"""Joins whose strategy follows counted rows.

Settled tables are compressed: ids that run on and repeated coordinates take about a byte a row there. The planner
compares that file size with its limit for broadcasts, takes no account of rows that a plan multiplies, and sends
millions of rows through the driver. So no join of the engine leaves the choice to file sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

#: Rows of a table with a row for each cloud, and their bytes, counted, up to which it is broadcast. The driver holds
#: a broadcast several times while it makes it, and all of a plan's at once.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 5_000_000


def shuffled(df: DataFrame) -> DataFrame:
    """df, which has rows for points or edges, as a side of a join that is never broadcast."""
    return df.hint("merge")


def _bytes(value: Column, kind: DataType) -> Column:
    """Bytes of a value in a row, to within a word for each text; arrays hold numbers."""
    if isinstance(kind, StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(16))
    if isinstance(kind, StringType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    return F.coalesce(F.size(value), F.lit(0)) * 8 + 24 if isinstance(kind, ArrayType) else F.lit(8)


def with_cloud(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined on the cloud with a settled table of a row for each cloud, which is broadcast if it is small."""
    size = sum((_bytes(F.col(f.name), f.dataType) for f in table.schema), F.lit(8))
    n, held = table.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    few = n <= BROADCAST_ROWS and held <= BROADCAST_BYTES
    return rows.join(F.broadcast(table) if few else shuffled(table), "cloud", how)
