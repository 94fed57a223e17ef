"""Positions and running sums over one global order, without a window that gathers all rows in a task.

Rows are dealt by ranges of the order and sorted inside; each range knows its count and sum, and what lies before it
follows from one row a range. The order should be total: rows that tie in it share a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

_SHIFT = 33  # monotonically_increasing_id: range number above, row in the range below


def running(rows: DataFrame, order: list[Column | str], value: Column | None = None, place: str = "place", total: str = "total") -> DataFrame:
    """``rows`` with ``place`` (long, from 0) and, where ``value`` is given, ``total``: the sum of values up to and with the row."""
    at, part = F.monotonically_increasing_id(), F.shiftright("_at", _SHIFT)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    amount = F.lit(0) if value is None else value
    dealt = stored(rows.withColumn("_value", F.coalesce(amount, F.lit(0)).cast("long")).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", at))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.sum("_value").alias("_sum"))
    ranges = ranges.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    out = dealt.withColumn("_part", part).join(F.broadcast(ranges), "_part")
    out = out.withColumn(place, F.col("_before") + F.col("_at") - F.shiftleft("_part", _SHIFT))
    if value is not None:
        inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(total, F.col("_base") + F.sum("_value").over(inside))
    return out.drop("_part", "_at", "_value", "_before", "_base")
